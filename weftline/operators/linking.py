"""Linking: spans to instances, ambiguity components, resolvers, pruning, known facts. Everything is keyed by doc_id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.functions.filters import likely
from weftline.operators.kb import KnowledgeBase
from weftline.session import materialize


def instances(spans: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc_id, a, b, property, literal_index, surface, subject, uri: the subjects that have the literal as that property."""
    spans = spans.select("doc_id", "a", "b", "property", "literal_index", "surface").distinct()
    pairs = spans.select("property", "literal_index").distinct()
    facts = kb.symbols.select(F.col("predicate").alias("property"), F.col("object").alias("literal_index"), "subject")
    facts = materialize(likely(facts, ["property", "literal_index"], pairs).join(pairs, ["property", "literal_index"], "left_semi"))
    names = kb.named(facts.select(F.col("subject").alias("index"))).select(F.col("index").alias("subject"), "uri")
    found = spans.join(facts.join(names, "subject"), ["property", "literal_index"])
    return found.select("doc_id", "a", "b", "property", "literal_index", "surface", "subject", "uri")


def collapse_parts(spans: DataFrame) -> DataFrame:
    """Without single-token matches whose text is a token of a longer match in the same document."""
    several = spans.where(F.col("surface").rlike(r"\s"))
    parts = several.select("doc_id", F.explode(F.split(F.lower("surface"), r"\s+")).alias("part")).distinct()
    return spans.join(parts, (spans["doc_id"] == parts["doc_id"]) & (F.lower(spans["surface"]) == parts["part"]), "left_anti")


def typed(found: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc_id, subject, type, probability (1) for each resolved subject."""
    return found.select("doc_id", "subject").distinct().join(kb.types.distinct(), "subject").select("doc_id", "subject", "type", F.lit(1.0).alias("probability"))


def unambiguous_types(found: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc_id, a, cluster: starts whose candidates' types all belong to one cluster."""
    joined = found.select("doc_id", "a", "subject").distinct().join(kb.types.distinct(), "subject").join(F.broadcast(kb.type_clusters), "type")
    counted = joined.groupBy("doc_id", "a").agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("last"))
    return counted.where("cluster = last").select("doc_id", "a", "cluster")


def bipartite(found: DataFrame) -> DataFrame:
    """doc_id, phrase, literal_index, subject: literals and subjects of each lower-cased surface phrase."""
    low = found.withColumn("phrase", F.lower("surface"))
    return low.select("doc_id", "phrase", "literal_index", "subject").distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc_id, subject, component: weakly connected components of each document's literal-subject graph.

    The label of a component is its least literal. A document's graph has as many nodes as it has matches, so labels are
    spread by rounds over all documents at once; a round is two joins on (doc_id, node) and rounds end when no label
    falls, after at most as many as the longest path has literals.
    """
    from weftline.session import materialize

    pairs = materialize(edges.select("doc_id", "literal_index", "subject").distinct())
    labels = materialize(pairs.groupBy("doc_id", "literal_index").agg(F.min("literal_index").alias("component")))
    while True:
        by_subject = pairs.join(labels, ["doc_id", "literal_index"]).groupBy("doc_id", "subject").agg(F.min("component").alias("component"))
        lowered = pairs.join(by_subject, ["doc_id", "subject"]).groupBy("doc_id", "literal_index").agg(F.min("component").alias("new"))
        joined = materialize(labels.join(lowered, ["doc_id", "literal_index"]).select("doc_id", "literal_index", F.least("component", "new").alias("component"), (F.col("new") < F.col("component")).alias("moved")))
        labels = joined.select("doc_id", "literal_index", "component")
        if not joined.where("moved").take(1):
            break
    return pairs.join(labels, ["doc_id", "literal_index"]).groupBy("doc_id", "subject").agg(F.min("component").alias("component"))


def expansion(candidates: DataFrame, kb: KnowledgeBase, backward: bool = False) -> DataFrame:
    """doc_id, src, dst, predicate: edges out of (without rdf:type) or into the candidates of each document."""
    seeds = candidates.select("doc_id", "subject").distinct()
    ids = seeds.select(F.col("subject").alias("index"))
    if backward:
        joined = seeds.join(kb.incoming(ids).withColumnRenamed("subject", "src"), F.col("object") == F.col("subject"))
        return joined.select("doc_id", "src", F.col("object").alias("dst"), "predicate").distinct()
    edges = kb.outgoing(ids).where(F.col("predicate") != kb.rdf_type)
    return seeds.join(edges, "subject").select("doc_id", F.col("subject").alias("src"), F.col("object").alias("dst"), "predicate").distinct()


def simple(edges: DataFrame) -> DataFrame:
    """One edge for each (doc_id, src, dst), with the least predicate: what degrees count."""
    return edges.groupBy("doc_id", "src", "dst").agg(F.min("predicate").alias("predicate"))


def connected(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, component, connected: whether any candidate has a neighbour."""
    ends = edges.select("doc_id", F.col("src").alias("subject")).unionAll(edges.select("doc_id", "dst")).distinct().withColumn("hit", F.lit(1))
    joined = candidates.join(ends, ["doc_id", "subject"], "left")
    return joined.groupBy("doc_id", "component").agg((F.max(F.coalesce("hit", F.lit(0))) == 1).alias("connected"))


def staged_expansion(candidates: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc_id, src, dst, predicate: the components of a document expanded from the least ambiguous on, until none is
    disconnected; those that stay disconnected after all are expanded backward.

    A stage expands the components with one number of candidates. A component is connected from the first stage with an
    edge at one of its candidates, so the stage to stop at is the last of those: no loop over stages is needed.
    """
    sized = candidates.groupBy("doc_id", "component").agg(F.count("*").alias("size")).join(candidates, ["doc_id", "component"]).select("doc_id", "component", "subject", "size")
    forward = expansion(candidates, kb).join(sized.select("doc_id", F.col("subject").alias("src"), "size"), ["doc_id", "src"])
    forward = materialize(forward.select("doc_id", "src", "dst", "predicate", "size"))
    ends = forward.select("doc_id", F.col("src").alias("subject"), F.col("size").alias("stage")).unionAll(forward.select("doc_id", "dst", "size"))
    connected_at = sized.join(ends, ["doc_id", "subject"]).groupBy("doc_id", "component").agg(F.min("stage").alias("stage"))
    each = candidates.select("doc_id", "component").distinct().join(connected_at, ["doc_id", "component"], "left")
    last = each.groupBy("doc_id").agg(F.max("stage").alias("last"), F.sum(F.col("stage").isNull().cast("int")).alias("lonely"))
    kept = forward.join(last, "doc_id").where("lonely > 0 or size <= last").select("doc_id", "src", "dst", "predicate")
    lonely = candidates.join(each.where("stage is null"), ["doc_id", "component"], "left_semi")
    return kept.union(expansion(lonely, kb, backward=True)).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """doc_id, node, indegree, outdegree over distinct neighbours."""
    one = simple(edges)
    both = one.select("doc_id", F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(one.select("doc_id", F.col("dst"), F.lit(1), F.lit(0)))
    return both.groupBy("doc_id", "node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def prune_leaves(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges without those at a node that is no candidate and has at most one edge in and one out; one pass."""
    keep = candidates.select("doc_id", F.col("subject").alias("node"))
    weak = degrees(edges).where("indegree <= 1 and outdegree <= 1").join(keep, ["doc_id", "node"], "left_anti").select("doc_id", "node")
    rest = edges.join(weak.withColumnRenamed("node", "src"), ["doc_id", "src"], "left_anti")
    return rest.join(weak.withColumnRenamed("node", "dst"), ["doc_id", "dst"], "left_anti").select("doc_id", "src", "dst", "predicate")


#: Rounds of PageRank and HITS.
ROUNDS = 20


def _ranks(pdf: pd.DataFrame, rounds: int, jump: float) -> pd.DataFrame:
    """Scores of the nodes of whole documents, all documents at once."""
    import numpy as np

    docs, doc_of_edge = np.unique(pdf["doc_id"].to_numpy(), return_inverse=True)
    src, dst = ((doc_of_edge.astype(np.int64) << 32) | pdf[c].to_numpy().astype(np.int64) for c in ("src", "dst"))
    nodes = np.unique(np.concatenate([src, dst]))
    src, dst, doc, size = np.searchsorted(nodes, src), np.searchsorted(nodes, dst), nodes >> 32, len(nodes)
    n = np.bincount(doc)[doc]
    out = np.bincount(src, minlength=size).astype(float)
    rank = 1.0 / n
    for _ in range(rounds):
        given = np.bincount(dst, weights=rank[src] / out[src], minlength=size)
        lost = np.bincount(doc, weights=np.where(out == 0, rank, 0.0))[doc]
        rank = jump / n + (1 - jump) * (given + lost / n)
    norm = lambda x: x / np.maximum(np.sqrt(np.bincount(doc, weights=x * x)), 1e-300)[doc]
    hub = authority = np.full(size, 1.0)
    for _ in range(rounds):
        authority = norm(np.bincount(dst, weights=hub[src], minlength=size))
        hub = norm(np.bincount(src, weights=authority[dst], minlength=size))
    return pd.DataFrame({"doc_id": docs[doc], "node": nodes & 0xFFFFFFFF, "pagerank": rank, "hub": hub, "authority": authority})


def link_scores(edges: DataFrame, rounds: int = ROUNDS, jump: float = 0.1) -> DataFrame:
    """doc_id, node, pagerank, hub, authority: power iteration on each document's own graph, to nine digits.

    Rows are dealt by document and sorted, so a batch holds many whole documents; the last one of a batch waits for the
    next. Equal scores stay equal whatever the order of the sums, as ties are told by rounded values.
    """
    from weftline.session import ship_package

    ship_package(edges.sparkSession)

    def ranks(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            last = pdf["doc_id"] == pdf["doc_id"].iloc[-1]
            held = pdf[last]
            if not last.all():
                yield _ranks(pdf[~last], rounds, jump)
        if held is not None and len(held):
            yield _ranks(held, rounds, jump)

    dealt = simple(edges).select("doc_id", "src", "dst").repartition("doc_id").sortWithinPartitions("doc_id")
    found = dealt.mapInPandas(ranks, "doc_id long, node int, pagerank double, hub double, authority double")
    return found.withColumns({c: F.round(c, 9) for c in ("pagerank", "hub", "authority")})


def drawn(*key: str, seed: int = 1):
    """A number from 0 below 2^28 that depends on the key and the seed only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key, F.lit(str(seed)))), 1, 7), 16, 10).cast("double")


def scores(candidates: DataFrame, edges: DataFrame, resolver: str, seed: int = 1, links: DataFrame | None = None) -> DataFrame:
    """doc_id, component, subject, score by the named resolver. ``links``: ``link_scores`` of the edges, if already made."""
    if resolver == "random":
        return candidates.select("doc_id", "component", "subject", drawn("doc_id", "subject", seed=seed).alias("score"))
    if resolver in ("degree", "flow"):
        found = degrees(edges)
        value = F.col("indegree") + F.col("outdegree") if resolver == "degree" else F.least("indegree", "outdegree")
    else:
        found = link_scores(edges) if links is None else links
        value = {"pagerank": F.col("pagerank"), "hub": F.col("hub"), "authority": F.col("authority"), "hits": F.col("hub") * F.col("authority"), "hits+": F.col("hub") + F.col("authority")}[resolver]
    joined = candidates.join(found.select("doc_id", F.col("node").alias("subject"), F.round(value.cast("double"), 9).alias("value")), ["doc_id", "subject"], "left")
    return joined.select("doc_id", "component", "subject", F.coalesce("value", F.lit(0.0)).alias("score"))


RESOLVERS = ("degree", "flow", "pagerank", "hub", "authority", "hits", "hits+", "random")


def resolve(scored: DataFrame) -> DataFrame:
    """doc_id, component, subject, vote: 1 for the best of each component with several candidates (ties all), else -1."""
    w = W.partitionBy("doc_id", "component")
    several = scored.withColumn("n", F.count("*").over(w)).withColumn("best", F.max("score").over(w)).where("n > 1")
    return several.select("doc_id", "component", "subject", F.when(F.col("score") == F.col("best"), 1).otherwise(-1).alias("vote"))


def resolve_by_cluster(candidates: DataFrame, kb: KnowledgeBase, predicted: DataFrame) -> DataFrame:
    """Vote 1 for candidates whose cluster is among ``predicted`` (doc_id, cluster), else -1, in ambiguous components."""
    w = W.partitionBy("doc_id", "component")
    several = candidates.withColumn("n", F.count("*").over(w)).where("n > 1").join(kb.instance_clusters, "subject", "left")
    joined = several.join(predicted.select("doc_id", "cluster", F.lit(1).alias("hit")).distinct(), ["doc_id", "cluster"], "left")
    return joined.select("doc_id", "component", "subject", F.when(F.col("hit") == 1, 1).otherwise(-1).alias("vote"))


def winners(candidates: DataFrame, votes: DataFrame) -> DataFrame:
    """doc_id, component, subject: of each component the candidate with the best vote, of equals the least id."""
    joined = candidates.join(votes.select("doc_id", "subject", "vote"), ["doc_id", "subject"], "left").withColumn("v", -F.coalesce("vote", F.lit(0)))
    return joined.groupBy("doc_id", "component").agg(F.min(F.struct("v", "subject")).alias("w")).select("doc_id", "component", F.col("w.subject").alias("subject"))


def resolve_stack(candidates: DataFrame, edges: DataFrame, resolvers: list[str], links: DataFrame | None = None) -> DataFrame:
    """doc_id, component, subject, a column of votes for each resolver (0 where nothing is ambiguous), their sum as
    ``fused``, and ``winner``: the candidate with the largest vote of the last resolver, of equals the least id."""
    rows = candidates.select("doc_id", "component", "subject")
    for name in resolvers:
        votes = resolve(scores(candidates, edges, name, links=links)).select("doc_id", "subject", F.col("vote").alias(name))
        rows = rows.join(votes, ["doc_id", "subject"], "left")
    rows = rows.select("doc_id", "component", "subject", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in resolvers])
    place = F.row_number().over(W.partitionBy("doc_id", "component").orderBy(F.desc(resolvers[-1]), "subject"))
    return rows.withColumn("fused", sum((F.col(f"`{n}`") for n in resolvers), F.lit(0))).withColumn("winner", place == 1)


def known_facts(resolved: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc_id, subject, predicate, object: all out-edges of the resolved subjects."""
    subjects = resolved.select("doc_id", "subject").distinct()
    edges = kb.outgoing(subjects.select(F.col("subject").alias("index"))).distinct()
    return subjects.join(edges, "subject").select("doc_id", "subject", "predicate", "object")


def predict_facts(resolved: DataFrame, kb: KnowledgeBase, top: DataFrame) -> DataFrame:
    """doc_id, subject, predicate, object, weight: the likeliest properties between each ordered pair of a document's subjects.

    Pairs are made by cluster first: a subject meets only objects of clusters that its own cluster is linked with.
    """
    subjects = resolved.select("doc_id", "subject").distinct()
    clustered = subjects.join(kb.best_cluster_of(subjects.select(F.col("subject").alias("index"))), "subject")
    reach = clustered.join(F.broadcast(top.select(F.col("subject").alias("cluster"), F.col("object").alias("to"), "predicate", "weight")), "cluster")
    others = clustered.select("doc_id", F.col("subject").alias("object"), F.col("cluster").alias("to"))
    return reach.join(others, ["doc_id", "to"]).where("subject <> object").select("doc_id", "subject", "predicate", "object", "weight")


def _ends(facts: DataFrame) -> DataFrame:
    """index: subjects and objects of facts."""
    return facts.select(F.col("subject").alias("index")).unionAll(facts.select("object")).distinct()


def leave_one_out(facts: DataFrame, kb: KnowledgeBase, top: DataFrame) -> DataFrame:
    """accuracy, fallout and the counts behind them: is each triple between resolved subjects predicted without itself?

    Right is a prediction of the triple's own property while the subject has no more such edges than its cardinality
    allows; unknown counts triples between clusters that no property links.
    """
    clusters = materialize(kb.best_cluster_of(_ends(facts)))
    between = facts.join(clusters.withColumnRenamed("cluster", "sc"), "subject").join(clusters.select(F.col("subject").alias("object"), F.col("cluster").alias("oc")), "object")
    best = top.select(F.col("subject").alias("sc"), F.col("object").alias("oc"), F.col("predicate").alias("guess"))
    cards = kb.subject_ratio(between).select("predicate", F.ceil("ratio").alias("most"))
    outs = facts.groupBy("doc_id", "subject", "predicate").agg(F.count("*").alias("n"))
    judged = between.join(F.broadcast(best), ["sc", "oc"], "left").join(F.broadcast(cards), "predicate", "left").join(outs, ["doc_id", "subject", "predicate"])
    hit = F.coalesce((F.col("guess") == F.col("predicate")) & (F.col("n") <= F.col("most")), F.lit(False))
    each = judged.groupBy("doc_id", "subject", "predicate", "object").agg(F.max(hit).alias("hit"), F.max(F.col("guess").isNull()).alias("unknown"))
    counts = each.agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("correct"), F.sum(F.col("unknown").cast("long")).alias("unknown"))
    return counts.select("n", F.coalesce("correct", F.lit(0)).alias("correct"), F.coalesce("unknown", F.lit(0)).alias("unknown"), F.try_divide("correct", "n").alias("accuracy"), F.try_divide("unknown", "n").alias("fallout"))


def leave_one_out_similar(facts: DataFrame, kb: KnowledgeBase, chain: DataFrame, least: float = 1e-6) -> DataFrame:
    """accuracy and the counts behind it, by collaborative filtering: is each triple of a document found without itself?

    A document's matrix has its subjects as rows and (predicate, object) as columns; columns with one entry are left out.
    Without the triple's own cell, the correlation of its subject with each other subject of a common cluster is summed,
    where positive, over those that have the column; a triple is found if the sum is positive and the chain (subject,
    predicate, object, probability between clusters) gives the property at least ``least``.
    """
    cells = facts.select("doc_id", "subject", "predicate", "object").distinct()
    shared = cells.groupBy("doc_id", "predicate", "object").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "predicate", "object")
    cells = materialize(cells.join(shared, ["doc_id", "predicate", "object"]))
    width = shared.groupBy("doc_id").agg(F.count("*").alias("width"))
    size = cells.groupBy("doc_id", "subject").agg(F.count("*").alias("own"))
    other = lambda df, *names: df.select("doc_id", F.col("subject").alias("peer"), *names)
    both = cells.join(other(cells, "predicate", "object"), ["doc_id", "predicate", "object"]).where("subject <> peer")
    common = both.groupBy("doc_id", "subject", "peer").agg(F.count("*").alias("common"))
    clusters = materialize(kb.clusters_of(_ends(facts)))
    akin = common.select("doc_id", "subject", "peer").join(clusters, "subject").join(clusters.select(F.col("subject").alias("peer"), "cluster"), ["peer", "cluster"]).select("doc_id", "subject", "peer").distinct()
    pairs = common.join(akin, ["doc_id", "subject", "peer"]).join(size, ["doc_id", "subject"]).join(other(size, F.col("own").alias("theirs")), ["doc_id", "peer"]).join(width, "doc_id")
    # without the cell the subject has one entry less, and one less in common
    a, b, c, n = F.col("own") - 1, F.col("theirs"), F.col("common") - 1, F.col("width")
    spread = a * (n - a) * b * (n - b)
    similarity = F.when(spread > 0, (n * c - a * b) / F.sqrt(spread)).otherwise(0.0)
    scored = both.join(pairs.select("doc_id", "subject", "peer", F.greatest(similarity, F.lit(0.0)).alias("similarity")), ["doc_id", "subject", "peer"], "left")
    summed = scored.groupBy("doc_id", "subject", "predicate", "object").agg(F.sum(F.coalesce("similarity", F.lit(0.0))).alias("score"))
    gate = chain.select(F.col("subject").alias("cs"), "predicate", F.col("object").alias("co"), "probability")
    linked = summed.join(clusters.select("subject", F.col("cluster").alias("cs")), "subject").join(clusters.select(F.col("subject").alias("object"), F.col("cluster").alias("co")), "object").join(gate, ["cs", "predicate", "co"])
    open_ = linked.groupBy("doc_id", "subject", "predicate", "object").agg(F.max("probability").alias("probability"))
    judged = summed.join(open_, ["doc_id", "subject", "predicate", "object"], "left")
    hit = (F.col("score") > 1e-12) & (F.coalesce("probability", F.lit(0.0)) >= least)
    counts = judged.agg(F.count("*").alias("n"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("correct"))
    return counts.select("n", "correct", F.coalesce(F.try_divide("correct", "n"), F.lit(0.0)).alias("accuracy"))
