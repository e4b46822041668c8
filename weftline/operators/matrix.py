"""Matrices in coordinate form: (row, col, value), missing cells are 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def dense(m: DataFrame) -> DataFrame:
    """All cells; for matrices of the schema's size."""
    rows, cols = m.select("row").distinct(), m.select("col").distinct()
    return rows.crossJoin(F.broadcast(cols)).join(m, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def column_stats(m: DataFrame) -> DataFrame:
    """col, n (rows of the matrix), mean, sd (n - 1), s, q: from sums, without filling in zeros."""
    n = m.agg(F.count_distinct("row").cast("double").alias("n"))
    sums = m.groupBy("col").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(F.broadcast(n))  # one row
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("q") - F.col("n") * mean * mean, F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0.0))
    return sums.select("col", "n", mean.alias("mean"), F.sqrt(variance).alias("sd"), "s", "q")


def products(m: DataFrame, left: str = "col", by: str = "row") -> DataFrame:
    """c1, c2, dot over all pairs that share a non-zero row."""
    a = m.where("value <> 0").select(F.col(by).alias("k"), F.col(left).alias("c1"), F.col("value").alias("x"))
    b = m.where("value <> 0").select(F.col(by).alias("k"), F.col(left).alias("c2"), F.col("value").alias("y"))
    return a.join(b, "k").groupBy("c1", "c2").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


def _pairs(m: DataFrame) -> DataFrame:
    """All pairs of columns with their sums and dot product; of the size of the schema squared."""
    stats = column_stats(m)
    a = stats.select(F.col("col").alias("c1"), "n", F.col("mean").alias("m1"), F.col("q").alias("q1"))
    b = stats.select(F.col("col").alias("c2"), F.col("mean").alias("m2"), F.col("q").alias("q2"))
    return a.crossJoin(F.broadcast(b)).join(products(m), ["c1", "c2"], "left").withColumn("dot", F.coalesce("dot", F.lit(0.0)))


def covariance(m: DataFrame) -> DataFrame:
    """c1, c2, covariance (population)."""
    return _pairs(m).select("c1", "c2", (F.col("dot") / F.col("n") - F.col("m1") * F.col("m2")).alias("covariance"))


def pearson(m: DataFrame) -> DataFrame:
    """c1, c2, correlation; null where a column is constant."""
    p = _pairs(m)
    cov = F.col("dot") / F.col("n") - F.col("m1") * F.col("m2")
    v1, v2 = (F.col(f"q{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{i}") for i in (1, 2))
    return p.select("c1", "c2", F.when((v1 > 1e-15) & (v2 > 1e-15), cov / F.sqrt(v1 * v2)).alias("correlation"))


def spearman(m: DataFrame) -> DataFrame:
    """Pearson of ranks; equal values share the best rank."""
    from pyspark.sql import Window as W

    ranks = dense(m).select("row", "col", F.rank().over(W.partitionBy("col").orderBy(F.desc("value"))).cast("double").alias("value"))
    return pearson(ranks)


def cosine_rows(m: DataFrame) -> DataFrame:
    """c1, c2, cosine between rows that share a non-zero column, and 1 on the diagonal."""
    norms = m.groupBy("row").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = products(m, "row", "col")
    a, b = norms.select(F.col("row").alias("c1"), F.col("norm").alias("n1")), norms.select(F.col("row").alias("c2"), F.col("norm").alias("n2"))
    joined = dots.join(a, "c1").join(b, "c2")
    return joined.select("c1", "c2", F.when(F.col("c1") == F.col("c2"), 1.0).otherwise(F.col("dot") / (F.col("n1") * F.col("n2"))).alias("cosine"))


def cosine_restricted(m: DataFrame, cols: list) -> DataFrame:
    """Cosine of the pairs of rows that are both positive in one of ``cols``."""
    few = m.where(F.col("col").isin(cols) & (F.col("value") > 0))
    near = few.select("col", F.col("row").alias("c1")).join(few.select("col", F.col("row").alias("c2")), "col").select("c1", "c2").distinct()
    return cosine_rows(m).join(near, ["c1", "c2"], "left_semi")


def predict_by_similarity(m: DataFrame, similarity: DataFrame, name: str = "cosine") -> DataFrame:
    """row, col, value: non-zero cells as they are, zero cells the sum over other rows of similarity times value."""
    given = m.where("value <> 0").select("row", "col", "value")
    others = similarity.where("c1 <> c2").join(given.select(F.col("row").alias("c2"), "col", "value"), "c2")
    guessed = others.groupBy(F.col("c1").alias("row"), "col").agg(F.sum(F.col(name) * F.col("value")).alias("guess"))
    return given.join(guessed, ["row", "col"], "full").select("row", "col", F.coalesce("value", "guess").alias("value"))


def conditional(m: DataFrame, least: float = 0.0, lower: bool = False) -> DataFrame:
    """a, b, probability = m(b, a) / m(b, b) if both and m(a, a) reach ``least``, else 0, on a matrix of co-occurrences
    (row, col, value); only of a >= b if ``lower``."""
    m = m.where("row >= col") if lower else m
    own = m.where("row = col").select("row", F.col("value").alias("own"))
    joined = m.join(own.select(F.col("row").alias("col"), F.col("own").alias("cb")), "col").join(own.withColumnRenamed("own", "ca"), "row")
    fine = (F.col("value") >= least) & (F.col("ca") >= least) & (F.col("cb") >= least)
    return joined.select(F.col("row").alias("a"), F.col("col").alias("b"), F.when(fine, F.col("value") / F.col("cb")).otherwise(0.0).alias("probability"))


def significance(m: DataFrame, n: float) -> DataFrame:
    """a, b, significance = -ln P(X > k + 1) for X Poisson with mean c1 c2 / n and k co-occurrences.

    The probability is the sum of the terms behind the bound, in one aggregate over a sequence.
    """
    own = m.where("row = col").select("row", F.col("value").alias("own"))
    joined = m.join(own.select(F.col("row").alias("col"), F.col("own").alias("c2")), "col").join(own.withColumnRenamed("own", "c1"), "row")
    mean, k = F.col("c1") * F.col("c2") / n, F.floor("value") + 1
    # P(X > k) = e^-mean mean^(k+1) / (k+1)! (1 + mean/(k+2) + ...); logarithms keep the first factor in range
    tail = F.aggregate(F.sequence(F.lit(2), F.lit(400)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: F.struct((a["t"] * mean / (k + i)).alias("t"), (a["s"] + a["t"] * mean / (k + i)).alias("s")))["s"]
    first = -mean + (k + 1) * F.log(mean) - F.aggregate(F.sequence(F.lit(1), (k + 1).cast("int")), F.lit(0.0), lambda a, i: a + F.log(i))
    return joined.select(F.col("row").alias("a"), F.col("col").alias("b"), (-(first + F.log(tail))).alias("significance"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """item, value: the difference of two vectors (item, value); missing entries are 0."""
    both = a.select("item", F.col("value").alias("x")).join(b.select("item", F.col("value").alias("y")), "item", "full")
    return both.select("item", (F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("value"))


def hierarchical_cuts(m: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, item, cluster for several thresholds; items alone in a cluster stay."""
    parts = [hierarchical(m, t, keep_single=True).select(F.lit(t).alias("threshold"), "item", "cluster") for t in thresholds]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionAll(more)
    return rows


def cluster_distances(m: DataFrame, factor: float = 1.5) -> DataFrame:
    """cluster, col, value: the tree of ``hierarchical`` cut where a merge is further than ``factor`` times the mean merge,
    and for each cluster and column the mean distance 1 - correlation of its items to that column."""
    found = hierarchical(m, factor, keep_single=True, of_mean=True)
    joined = m.join(found, F.col("c1") == F.col("item"))
    return joined.groupBy("cluster", F.col("c2").alias("col")).agg(F.avg(1 - F.coalesce("correlation", F.lit(0.0))).alias("value"))


def hierarchical(m: DataFrame, threshold: float, keep_single: bool = False, of_mean: bool = False) -> DataFrame:
    """item, cluster: average linkage over distances between the columns of a correlation matrix (c1, c2, correlation).

    The tree is cut where a merge is further than ``threshold`` times the largest one (or the mean one). Items alone in a cluster are left
    out unless kept. One small matrix of the schema's size, so it runs in one task.
    """

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        items = np.unique(pdf["c1"].to_numpy())
        table = pdf.pivot(index="c1", columns="c2", values="correlation").reindex(index=items, columns=items).fillna(0.0).to_numpy()
        groups = {i: [i] for i in range(len(items))}
        squares = (table * table).sum(axis=1)
        gaps = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * table @ table.T, 0.0))
        gaps[gaps < 1e-7] = 0.0  # equal columns, but for rounding
        merges = []
        while len(groups) > 1:
            names = sorted(groups)
            best = None
            for i, a in enumerate(names):
                for b in names[:i]:
                    gap = gaps[np.ix_(groups[a], groups[b])].mean()
                    if best is None or gap < best[0] - 1e-12:
                        best = (gap, a, b)
            gap, a, b = best
            merges.append((gap, groups[a] + groups[b]))
            groups[max(names) + 1] = groups.pop(a) + groups.pop(b)
        limit = threshold * (np.mean([g for g, _ in merges]) if of_mean and merges else max((g for g, _ in merges), default=0.0))
        label = {i: (i,) for i in range(len(items))}
        for gap, members in merges:
            if gap <= limit:
                for i in members:
                    label[i] = tuple(sorted(members))
        rows = [(int(items[i]), int(items[own[0]])) for i, own in label.items() if keep_single or len(own) > 1]
        return pd.DataFrame(rows, columns=["item", "cluster"])

    return m.select(F.lit(1).alias("one"), "c1", "c2", "correlation").groupBy("one").applyInPandas(lambda pdf: cluster(pdf), "item int, cluster int")


def label_clusters(clusters: DataFrame, probability: DataFrame) -> DataFrame:
    """cluster, label: the item k, inside or outside, with the largest mean P(k|c) times mean P(c|k) over members c.

    ``clusters``: item, cluster; ``probability``: a, b, probability = P(a | b). An outsider holds only if it beats the
    best insider; ties go to insiders, then to the lesser id.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    pairs = clusters.join(probability, F.col("b") == F.col("item")).select("cluster", F.col("a").alias("k"), F.col("item").alias("c"), F.col("probability").alias("p1"))
    back = probability.select(F.col("a").alias("c"), F.col("b").alias("k"), F.col("probability").alias("p2"))
    scored = pairs.join(back, ["c", "k"], "left").groupBy("cluster", "k").agg(F.sum("p1").alias("s1"), F.sum(F.coalesce("p2", F.lit(0.0))).alias("s2")).join(sizes, "cluster")
    inside = clusters.select("cluster", F.col("item").alias("k"), F.lit(1).alias("inside"))
    marked = scored.join(inside, ["cluster", "k"], "left").select("cluster", "k", (-(F.col("s1") / F.col("size")) * (F.col("s2") / F.col("size"))).alias("score"), (-F.coalesce("inside", F.lit(0))).alias("outside"))
    return marked.groupBy("cluster").agg(F.min(F.struct("score", "outside", "k")).alias("best")).select("cluster", F.col("best.k").alias("label"))


def pca(m: DataFrame, share: float = 0.9) -> DataFrame:
    """row, component, value: rows projected on the components that hold ``share`` of the singular values, scaled by them."""

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        table = pdf.pivot(index="row", columns="col", values="value").fillna(0.0).sort_index()
        x = table.to_numpy() - table.to_numpy().mean(axis=0)
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        k = int(np.searchsorted(np.cumsum(s) / max(s.sum(), 1e-300), share) + 1)
        sign = np.sign(vt[:k][np.arange(min(k, len(vt))), np.abs(vt[:k]).argmax(axis=1)])
        y = (x @ vt[:k].T) * sign / np.sqrt(np.maximum(s[:k], 1e-300))
        return pd.DataFrame([(int(r), j, float(y[i, j])) for i, r in enumerate(table.index) for j in range(y.shape[1])], columns=["row", "component", "value"])

    return m.select(F.lit(1).alias("one"), "row", "col", "value").groupBy("one").applyInPandas(lambda pdf: project(pdf), "row int, component int, value double")
