"""Relevance rating in long form: (doc_id, metric, subject, value), normalisation, fusion."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.functions.filters import likely
from weftline.functions.text import words
from weftline.operators import linking
from weftline.operators.kb import KnowledgeBase
from weftline.session import materialize

#: Value that stands for a normalised value of 0 or less.
FLOOR = 1e-5


def subjects(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "subject").distinct()


def by_position(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, subject, value: the most characters left from a mention's start to the end of its text, if positive."""
    sized = found.select("doc_id", "subject", "a").join(docs.select("doc_id", F.length("text").alias("chars")), "doc_id")
    return sized.groupBy("doc_id", "subject").agg(F.max(F.col("chars") - F.col("a")).cast("double").alias("value")).where("value > 0")


def by_frequency(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, subject, value: the mean term frequency of a mention's tokens, the largest over mentions."""
    spans = found.select("doc_id", "subject", "a", "surface").distinct()
    parts = materialize(spans.select("doc_id", "subject", "a", F.explode(F.transform(words(F.col("surface")), F.lower)).alias("token")))
    # only texts with mentions are cut, and only their words are dealt
    low = likely(docs, ["doc_id"], parts.select("doc_id")).select("doc_id", F.transform(words(F.col("text")), F.lower).alias("w"))
    sizes = low.select("doc_id", F.size("w").alias("n"))
    asked = likely(low.select("doc_id", F.explode("w").alias("token")), ["doc_id", "token"], parts.select("doc_id", "token"))
    counts = asked.groupBy("doc_id", "token").agg(F.count("*").alias("k"))
    rated = parts.join(counts, ["doc_id", "token"]).join(sizes, "doc_id").groupBy("doc_id", "subject", "a").agg(F.avg(F.col("k") / F.col("n")).alias("tf"))
    return rated.groupBy("doc_id", "subject").agg(F.max("tf").alias("value"))


def inverted_index(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf: terms are runs of characters other than white space."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def by_rarity(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, subject, value: ln(N / (df + 1)) of the surface as one white-space term; the largest over mentions."""
    wanted = found.select(F.col("surface").alias("term")).distinct()
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("term"))
    df = likely(terms, ["term"], wanted).groupBy("term").agg(F.count("*").alias("df")).join(wanted, "term", "left_semi")
    total = docs.agg(F.count("*").alias("total"))
    rows = found.select("doc_id", "subject", F.col("surface").alias("term")).distinct().join(df, "term", "left").crossJoin(F.broadcast(total))  # one row
    return rows.groupBy("doc_id", "subject").agg(F.max(F.log(F.col("total") / (F.coalesce("df", F.lit(0)) + 1))).alias("value"))


def by_degree(found: DataFrame, edges: DataFrame, capacity: bool = False) -> DataFrame:
    """doc_id, subject, value: in + out, or the lesser of both."""
    d = linking.degrees(edges).withColumnRenamed("node", "subject")
    value = F.least("indegree", "outdegree") if capacity else F.col("indegree") + F.col("outdegree")
    return subjects(found).join(d, ["doc_id", "subject"]).select("doc_id", "subject", value.cast("double").alias("value"))


def by_links(found: DataFrame, edges: DataFrame, score: str, links: DataFrame | None = None) -> DataFrame:
    """doc_id, subject, value by pagerank, hub or authority. ``links``: ``link_scores`` of the edges, if already made."""
    links = linking.link_scores(edges) if links is None else links
    return subjects(found).join(links.withColumnRenamed("node", "subject"), ["doc_id", "subject"]).select("doc_id", "subject", F.col(score).alias("value"))


def at_random(found: DataFrame, seed: int = 1) -> DataFrame:
    return subjects(found).select("doc_id", "subject", (linking.drawn("doc_id", "subject", seed=seed) / float(1 << 28)).alias("value"))


def long_form(metrics: dict[str, DataFrame]) -> DataFrame:
    rows = None
    for name, df in metrics.items():
        one = df.select("doc_id", F.lit(name).alias("metric"), "subject", "value")
        rows = one if rows is None else rows.unionAll(one)
    return rows


def normalise(ratings: DataFrame) -> DataFrame:
    """((value - mean) / sd) / 2 + 1 for each document and metric, at least FLOOR.

    Mean and sample deviation run over all subjects that a document has in any metric, missing values count 0; a
    deviation of 0 or of a single subject counts 1.
    """
    rows = ratings.groupBy("doc_id").agg(F.count_distinct("subject").alias("rows"))
    sums = ratings.groupBy("doc_id", "metric").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    stats = sums.join(rows, "doc_id").withColumn("mean", F.col("s") / F.col("rows"))
    variance = F.greatest((F.col("q") - F.col("rows") * F.col("mean") * F.col("mean")) / F.nullif(F.col("rows") - 1, F.lit(0)), F.lit(0.0))
    sd = F.when(F.coalesce(variance, F.lit(0.0)) < 1e-18, 1.0).otherwise(F.sqrt(variance))
    joined = ratings.join(stats.select("doc_id", "metric", "mean", sd.alias("sd")), ["doc_id", "metric"])
    value = (F.col("value") - F.col("mean")) / F.col("sd") / 2 + 1
    return joined.select("doc_id", "metric", "subject", F.when(value <= 0, FLOOR).otherwise(value).alias("value"))


def fuse(ratings: DataFrame, metrics: list[str], how: str = "product") -> DataFrame:
    """doc_id, subject, value over subjects that have all the metrics: product (zeros left out) or belief b + (1 - b) v."""
    few = ratings.where(F.col("metric").isin(metrics)).groupBy("doc_id", "subject").agg(F.collect_list("value").alias("v"), F.count("*").alias("n"))
    few = few.where(F.col("n") == len(metrics)).withColumn("v", F.array_sort("v"))
    if how == "product":
        value = F.aggregate(F.filter("v", lambda x: x != 0), F.lit(1.0), lambda a, x: a * x)
    else:
        value = F.aggregate("v", F.lit(0.0), lambda a, x: a + (1 - a) * x)
    return few.select("doc_id", "subject", value.alias("value"))


def all_fusions(ratings: DataFrame, metrics: list[str]) -> DataFrame:
    """metric (names joined by +), doc_id, subject, value for every subset of two or more metrics.

    One row for each subset is matched against each subject's map of values: no pass over the ratings for each subset.
    """
    subsets = [list(c) for k in range(2, len(metrics) + 1) for c in combinations(metrics, k)]
    table = ratings.sparkSession.createDataFrame([("+".join(s), s) for s in subsets], "metric string, parts array<string>")
    maps = ratings.where(F.col("metric").isin(metrics)).groupBy("doc_id", "subject").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
    joined = maps.crossJoin(F.broadcast(table)).where(F.forall("parts", lambda p: F.map_contains_key("m", p)))  # 2^metrics rows
    value = F.aggregate("parts", F.lit(1.0), lambda a, p: a * F.when(F.element_at("m", p) == 0, 1.0).otherwise(F.element_at("m", p)))
    return joined.select("metric", "doc_id", "subject", value.alias("value"))


def ranked(ratings: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc_id, rank, uri by value descending, ties by subject."""
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("value"), "subject"))
    names = kb.named(ratings.select(F.col("subject").alias("index"))).select(F.col("index").alias("subject"), "uri")
    return ratings.withColumn("rank", rank).join(names, "subject").select("doc_id", "rank", "uri")
