"""The pipeline of fourteen steps: what each gives, run in order over all documents at once, with an evaluation of any step.

A step is a function of the run so far (``Run``) that returns a DataFrame; ``configure`` puts other functions in its
place, or leaves a step out. Steps are lazy: only what a later step, an evaluation or the caller needs is computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.functions import text
from weftline.operators import features, linking, rating, spotting
from weftline.operators.kb import KnowledgeBase
from weftline.session import materialize


def create_documents(spark: SparkSession, texts: list[tuple[int, str]] | DataFrame, mime: str = "text/plain", language: str | None = None, template: str | None = None) -> DataFrame:
    """doc_id, text, mime, language, template: documents from pairs, or from a DataFrame of doc_id and text; markup is blanked."""
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame(texts, "doc_id long, text string")
    plain = text.blank_markup(F.col("text")) if "html" in mime else F.col("text")
    return rows.select("doc_id", plain.alias("text"), F.lit(mime).alias("mime"), F.lit(language).alias("language"), F.lit(template).alias("template"))


class Run:
    """The documents, the knowledge base and the results of the steps so far, by name."""

    def __init__(self, docs: DataFrame, kb: KnowledgeBase):
        self.docs, self.kb, self.done = docs, kb, {}

    def __getitem__(self, step: str) -> DataFrame:
        return self.done[step]


def _language(run: Run) -> DataFrame:
    """The language given, else the one that is detected."""
    found = text.detect_language(run.docs)
    if "language" not in run.docs.columns:
        return found
    return run.docs.select("doc_id", F.col("language").alias("given")).join(found, "doc_id").select("doc_id", F.coalesce("given", "language").alias("language"))


def _chunked(run: Run) -> DataFrame:
    return text.chunked(run["part of speech"])


def _regexes(run: Run) -> DataFrame:
    return spotting.regex_entities(run.docs, {"number": r"[0-9]+(?:[.,][0-9]+)*"})


def _classes(run: Run) -> DataFrame:
    """Clusters of spans whose candidates all agree."""
    return linking.unambiguous_types(linking.instances(run["literals"], run.kb), run.kb)


def _instances(run: Run) -> DataFrame:
    return linking.instances(run["literals"], run.kb)


def _resolved(run: Run) -> DataFrame:
    found = run["instances"]
    candidates = linking.components(linking.bipartite(found))
    edges = linking.staged_expansion(candidates, run.kb)
    chosen = linking.winners(candidates, linking.resolve(linking.scores(candidates, edges, "degree")))
    return found.join(chosen.select("doc_id", "subject"), ["doc_id", "subject"], "left_semi")


def _relevance(run: Run) -> DataFrame:
    found = run["disambiguation"]
    return rating.normalise(rating.long_form({"position": rating.by_position(found, run.docs), "frequency": rating.by_frequency(found, run.docs)}))


def _recommended(run: Run) -> DataFrame:
    return linking.predict_facts(run["disambiguation"], run.kb, run.kb.markov_top(run.kb.markov_chain(100), 1))


#: Names and functions in their order.
STEPS: dict[str, Callable[[Run], DataFrame]] = {
    "language": _language,
    "words": lambda run: text.tokens(run.docs),
    "sentences": lambda run: text.sentence_flags(run["words"]),
    "part of speech": lambda run: text.tagged(run["sentences"]),
    "noun phrases": _chunked,
    "suffixes": lambda run: spotting.suffixes(run.docs, 10),
    "literals": lambda run: spotting.exact_case(spotting.longest(spotting.spot(run.docs, run.kb.literals, run.kb.symbols))),
    "regular expressions": _regexes,
    "phrase classes": _classes,
    "instances": _instances,
    "disambiguation": _resolved,
    "known facts": lambda run: linking.known_facts(run["disambiguation"], run.kb),
    "relevance": _relevance,
    "recommended facts": _recommended,
}
#: Steps whose results others read more than once.
SHARED = frozenset({"words", "sentences", "noun phrases", "literals", "instances", "disambiguation"})


class Pipeline:
    def __init__(self, kb: KnowledgeBase):
        self.kb, self.steps = kb, dict(STEPS)

    def configure(self, **steps: Callable[[Run], DataFrame] | None) -> Pipeline:
        """Other functions for steps, by name with underscores for spaces; None leaves a step out."""
        for key, step in steps.items():
            name = key.replace("_", " ")
            if name not in self.steps:
                raise ValueError(f"there is no step {name!r}; steps are {', '.join(self.steps)}")
            self.steps[name] = step
        return self

    def run(self, docs: DataFrame, last: str = "recommended facts", evaluate: dict[str, Callable[[Run], DataFrame]] | None = None) -> Run:
        """All steps up to ``last``. ``evaluate``: for steps a function from the run to a DataFrame of figures, kept as
        ``report of <step>``."""
        run = Run(docs, self.kb)
        for name, step in self.steps.items():
            if step is not None:
                found = step(run)
                run.done[name] = materialize(found) if name in SHARED else found
                if evaluate and name in evaluate:
                    run.done[f"report of {name}"] = materialize(evaluate[name](run))
            if name == last:
                return run
        return run

    def report(self, run: Run) -> DataFrame:
        """step, measure, value of all evaluations of a run: the mean of each numeric column."""
        rows = None
        for name, df in run.done.items():
            if name.startswith("report of "):
                numbers = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float", "long", "integer") and f.name != "doc_id"]
                mean = df.agg(*[F.avg(c).alias(c) for c in numbers]).select(F.explode(F.array(*[F.struct(F.lit(name.removeprefix("report of ")).alias("step"), F.lit(c).alias("measure"), F.col(c).alias("value")) for c in numbers])).alias("r")).select("r.*")
                rows = mean if rows is None else rows.unionAll(mean)
        return rows
