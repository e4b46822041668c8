"""Token counts by counting pieces once per distinct pre-token.

1. Each input partition counts its pre-tokens; the counts are summed, so that each distinct pre-token is one row.
2. The number of pieces of each distinct pre-token is found once, by the tokenizer.
3. Per-document pre-token frequencies meet those numbers in a join. The most frequent pre-tokens, at most
   ``HEAD_TOKENS``, are looked up in a broadcast table (its size is bounded by that number and ``HEAD_BYTES``); the rare
   rest goes through a shuffled join of (document, pre-token, frequency). A frequent pre-token is hence never a hot key
   of the join, and the join's rows are few.
4. Sums per document. No ids are made.
"""

from __future__ import annotations

import pickle
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import map_batches, prepare
from weftline.llm.tokens import PreTokens, Vocabulary
from weftline.session import materialize

#: Bounds of the broadcast table; results do not depend on them.
HEAD_TOKENS, HEAD_BYTES = 250_000, 64
_KEPT = 150_000


def distinct_pretokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """pretoken, n: how often each pre-token occurs in all texts."""

    def make():
        split, counts = PreTokens(Vocabulary(path), pattern), Counter()

        def step(columns):
            if columns is not None:
                for text in columns["text"]:
                    if text:
                        counts.update(split(text)[0])
            if counts and (columns is None or len(counts) > _KEPT):
                yield {"pretoken": list(counts), "n": list(counts.values())}
                counts.clear()

        return step

    return map_batches(docs.select("text"), "pretoken string, n long", make).groupBy("pretoken").agg(F.sum("n").alias("n"))


def count_pieces(pretokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """pretoken, n, pieces: how many tokens each distinct pre-token has."""

    def make():
        encode = Vocabulary(path).encoding(pattern).encode_ordinary

        def step(columns):
            if columns is not None:
                yield {**columns, "pieces": [len(encode(x)) for x in columns["pretoken"]]}

        return step

    return map_batches(pretokens.select("pretoken", "n"), "pretoken string, n long, pieces int", make)


def _head(pieces: DataFrame):
    """A broadcast table of the most frequent pre-tokens: the least count is read off a histogram of quarter powers of two."""
    short = pieces.where(F.length("pretoken") <= HEAD_BYTES)
    level = F.floor(F.log2("n") * 4).cast("int")
    classes = {r["c"]: r["k"] for r in short.groupBy(level.alias("c")).agg(F.count("*").alias("k")).collect()}
    least, total = None, 0
    for c in sorted(classes, reverse=True):
        if total + classes[c] > HEAD_TOKENS:
            break
        least, total = c, total + classes[c]
    table = short.where(level >= least).select("pretoken", "pieces").toArrow() if total else None
    rows = dict(zip(table.column("pretoken").to_pylist(), table.column("pieces").to_pylist())) if total else {}
    return pieces.sparkSession.sparkContext.broadcast(pickle.dumps(rows))


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs`` (doc_id, text).

    Counts are those of the tokenizer that the JSON file describes, without added begin or end tokens; a special
    token's string inside a text counts one. A null text is empty and has no tokens. Each row of ``docs`` gives a row,
    also if ids or whole rows repeat.
    """
    prepare(docs.sparkSession)
    pieces = materialize(count_pieces(distinct_pretokens(docs, path, pattern), path, pattern))
    head = _head(pieces)

    def make():
        split, known = PreTokens(Vocabulary(path), pattern), pickle.loads(head.value)

        def step(columns):
            if columns is None:
                return
            out = {"doc_id": columns["doc_id"], "row": columns["row"], "n_bytes": [], "known": [], "rare": []}
            for text in columns["text"]:
                found, special = split(text or "")
                total, rare = special, []
                for pretoken, n in Counter(found).items():
                    if pretoken in known:
                        total += known[pretoken] * n
                    else:
                        rare.append((pretoken, n))
                out["n_bytes"].append(len((text or "").encode("utf-8", "surrogatepass")))
                out["known"].append(total)
                out["rare"].append([{"pretoken": p, "freq": n} for p, n in rare])
            yield out

        return step

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    rows = map_batches(rows, "doc_id long, row long, n_bytes long, known long, rare array<struct<pretoken string, freq long>>", make)
    # the first part of a document has its known tokens and bytes; one without rare pre-tokens has a key that joins nothing
    parts = rows.select("doc_id", "row", "n_bytes", "known", F.posexplode_outer("rare").alias("i", "r")).select(
        "doc_id",
        "row",
        F.when(F.coalesce("i", F.lit(0)) == 0, F.col("n_bytes")).otherwise(0).alias("n_bytes"),
        F.when(F.coalesce("i", F.lit(0)) == 0, F.col("known")).otherwise(0).alias("known"),
        F.coalesce("r.pretoken", F.concat(F.lit("\x00none\x00"), F.col("row").cast("string"))).alias("pretoken"),
        F.coalesce("r.freq", F.lit(0)).alias("freq"),
    )
    joined = parts.join(pieces.select("pretoken", "pieces"), "pretoken", "left")
    total = F.sum(F.col("known") + F.col("freq") * F.coalesce("pieces", F.lit(0)))
    sums = joined.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
