"""Queries on stacks of resolvers and ratings, evaluations of single steps, and the pipeline as a whole."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from weftline import workflow
from weftline.functions import text
from weftline.operators import evaluation, linking, matrix, rating
from weftline.plans.context import LINK_SQL, RANK_SQL, SPOT_SQL, TEXT_SQL
from weftline.plans.corpus import _DRAWN, _TRUTH, _round, ctx, truth
from weftline.plans.knowledge import kb, sql
from weftline.plans.learning import _COND, cooccurrence, correlations

STACK = ["degree", "flow", "pagerank"]


def resolve_stack(spark, folder) -> DataFrame:
    c = ctx(spark, folder)
    return linking.resolve_stack(c.candidates, c.edges, STACK, c.links)


def disambiguation_all(spark, folder) -> DataFrame:
    """Precision and recall of every resolver over ambiguous candidates."""
    c = ctx(spark, folder)
    rows = None
    for name in linking.RESOLVERS:
        chosen = linking.winners(c.candidates, linking.resolve(linking.scores(c.candidates, c.edges, name, links=c.links)))
        one = chosen.select(F.lit(name).alias("resolver"), "doc_id", "subject")
        rows = one if rows is None else rows.unionAll(one)
    several = c.candidates.join(c.candidates.groupBy("doc_id", "component").agg(F.count("*").alias("n")).where("n > 1"), ["doc_id", "component"], "left_semi").select("doc_id", "subject")
    few = truth(c).join(several, ["doc_id", "subject"], "left_semi")
    wanted = few.crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in linking.RESOLVERS], "resolver string")))  # eight rows
    return _round(evaluation.precision_recall(rows, wanted, ["doc_id", "subject"], ["resolver"]), "precision", "recall")


def spotting_pr(spark, folder) -> DataFrame:
    """Lines of property and surface that are spotted, against those spelled exactly as in the knowledge base."""
    c = ctx(spark, folder)
    name = c.kb.property_names.withColumnRenamed("predicate", "property")
    line = lambda df: df.join(name, "property").select("doc_id", F.concat_ws("\t", "uri", "surface").alias("line"))
    return _round(evaluation.precision_recall(line(c.kept), line(c.spans.where("literal = surface")), ["line"], ["doc_id"]), "precision", "recall")


def type_pr(spark, folder) -> DataFrame:
    """Lines of surface and cluster of all candidates, against those of the resolved ones."""
    c = ctx(spark, folder)
    name = c.kb.resources.select(F.col("index").alias("cluster"), F.col("uri").alias("name"))
    line = lambda df: df.select("doc_id", "surface", "subject").join(c.kb.instance_clusters, "subject").join(name, "cluster").select("doc_id", F.concat_ws("\t", "surface", "name").alias("line"))
    return _round(evaluation.precision_recall(line(c.instances), line(c.resolved), ["line"], ["doc_id"]), "precision", "recall")


def rate_fuse_normal(spark, folder) -> DataFrame:
    """The product of four metrics as a metric of its own, normalised again."""
    fused = rating.fuse(ctx(spark, folder).normal, ["position", "frequency", "rarity", "degree"], "product")
    return _round(rating.normalise(rating.long_form({"fused": fused})).select("doc_id", "subject", "value"), "value", digits=5)


NINE = ["authority", "capacity", "degree", "frequency", "hub", "pagerank", "position", "random", "rarity"]


def rate_nine_fusions(spark, folder) -> DataFrame:
    """All fusions of nine metrics."""
    c = ctx(spark, folder)
    more = {s: rating.by_links(c.instances, c.edges, s, c.links) for s in ("pagerank", "hub", "authority")}
    more |= {"capacity": rating.by_degree(c.instances, c.edges, capacity=True), "random": rating.at_random(c.instances)}
    fused = rating.all_fusions(c.ratings.unionByName(rating.long_form(more)), NINE)
    return fused.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.max("value") / (F.max("value") + 1), 5).alias("most"))


def entity_types(spark, folder) -> DataFrame:
    """Spans by property."""
    c = ctx(spark, folder)
    return c.kept.select("doc_id", "property", "a", "b", "surface").distinct().join(c.kb.property_names.withColumnRenamed("predicate", "property"), "property").groupBy("doc_id", "uri").agg(F.count("*").alias("n"), F.min("a").alias("first"), F.count_distinct(F.lower("surface")).alias("surfaces"))


def token_types(spark, folder) -> DataFrame:
    """Clusters of a span that are known (of the resolved subject) and predicted (of at least six tenths of its candidates)."""
    c = ctx(spark, folder)
    known = c.resolved.select("doc_id", "a", "subject").distinct().join(c.kb.instance_clusters, "subject").select("doc_id", "a", "cluster", F.lit("known").alias("kind"))
    votes = c.instances.select("doc_id", "a", "subject").distinct().join(c.kb.instance_clusters, "subject").groupBy("doc_id", "a", "cluster").agg(F.count("*").alias("n"))
    total = votes.groupBy("doc_id", "a").agg(F.sum("n").alias("all"))
    predicted = votes.join(total, ["doc_id", "a"]).where("n >= 0.6 * all").select("doc_id", "a", "cluster", F.lit("predicted").alias("kind"))
    return known.unionAll(predicted).distinct()


def token_ranges(spark, folder) -> DataFrame:
    c = ctx(spark, folder)
    return text.token_ranges(c.tokens, c.kept.select("doc_id", F.col("a").alias("start"), F.col("b").alias("end")))


def loo_similar(spark, folder) -> DataFrame:
    c = ctx(spark, folder)
    return linking.leave_one_out_similar(c.facts, c.kb, c.kb.markov_chain(100))


def workflow_report(spark, folder) -> DataFrame:
    """The fourteen steps over all documents, with figures of two of them."""
    c = ctx(spark, folder)
    counts = lambda step: lambda run: run[step].groupBy("doc_id").agg(F.count("*").alias("rows"))
    line = workflow.Pipeline(c.kb)
    return line.report(line.run(c.docs, evaluate={"instances": counts("instances"), "known facts": counts("known facts")}))


def vector_minus(spark, folder) -> DataFrame:
    """How many subjects each type has beyond the number of literals with that number: two vectors of unlike items."""
    k = kb(spark, folder)
    types = k.histogram_types.select(F.col("type").alias("item"), F.col("count").cast("double").alias("value"))
    return matrix.minus(types, k.histogram_symbols.select(F.col("predicate").alias("item"), F.col("count").cast("double").alias("value")))


_SCORES = {"degree": "degree", "flow": "flow", "pagerank": "pagerank", "hub": "hub", "authority": "authority", "hits": "hub * authority", "hits+": "hub + authority", "random": _DRAWN}
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS resolver, doc_id, component, subject, coalesce(round({e}, 9), 0.0) AS score FROM every" for n, e in _SCORES.items())
_CHOICE = f"""{RANK_SQL}, every AS (SELECT s.*, l.pagerank, l.hub, l.authority FROM scored s LEFT JOIN links l ON l.doc_id = s.doc_id AND l.node = s.subject), scores AS ({_LONG}),
voted AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 0 WHEN score = max(score) OVER w THEN 1 ELSE -1 END AS vote FROM scores WINDOW w AS (PARTITION BY resolver, doc_id, component))"""
_PR_OF = "SELECT {by}, count(f) AS found, count(t) AS truth, count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) AS hits, coalesce(round(count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) / nullif(count(f), 0), 9), 0.0) AS precision, coalesce(round(count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) / nullif(count(t), 0), 9), 0.0) AS recall FROM (SELECT DISTINCT {by}, {keys}, 1 AS f FROM {found}) FULL JOIN (SELECT DISTINCT {by}, {keys}, 1 AS t FROM {truth}) USING ({by}, {keys}) GROUP BY 1"
_PARTS = "[" + ", ".join(str(list(c)) for k in range(2, 10) for c in combinations(NINE, k)) + "]"
_NINE_SQL = f"""{RANK_SQL}, long AS (SELECT * FROM ratings UNION ALL SELECT i.doc_id, m.metric, i.subject, CASE m.metric WHEN 'pagerank' THEN l.pagerank WHEN 'hub' THEN l.hub ELSE l.authority END FROM (SELECT DISTINCT doc_id, subject FROM inst) i JOIN links l ON l.doc_id = i.doc_id AND l.node = i.subject, (VALUES ('pagerank'), ('hub'), ('authority')) m(metric)
 UNION ALL SELECT doc_id, 'capacity', subject, capacity FROM r_degree UNION ALL SELECT doc_id, 'random', subject, {_DRAWN} / 268435456 FROM (SELECT DISTINCT doc_id, subject FROM inst)),
maps AS (SELECT doc_id, subject, map_from_entries(list((metric, value))) AS m FROM long GROUP BY 1, 2),
subsets AS (SELECT unnest({_PARTS}) AS parts)
SELECT metric, count(*) AS n, round(max(v) / (max(v) + 1), 5) AS most FROM (SELECT array_to_string(parts, '+') AS metric, list_aggregate(list_transform(parts, lambda p: CASE WHEN m[p] = 0 THEN 1.0 ELSE m[p] END), 'product') AS v FROM maps, subsets WHERE list_has_all(map_keys(m), parts)) GROUP BY 1"""
_SIMILAR = f"""{LINK_SQL}, c0 AS (SELECT DISTINCT doc_id, subject, predicate, object FROM facts), shared AS (SELECT doc_id, predicate, object FROM c0 GROUP BY 1, 2, 3 HAVING count(*) > 1),
cells AS (SELECT c0.* FROM c0 JOIN shared USING (doc_id, predicate, object)), width AS (SELECT doc_id, count(*) AS n FROM shared GROUP BY 1), own AS (SELECT doc_id, subject, count(*) AS k FROM cells GROUP BY 1, 2),
pairs AS (SELECT x.doc_id, x.subject, y.subject AS peer, x.predicate, x.object FROM cells x JOIN cells y ON y.doc_id = x.doc_id AND y.predicate = x.predicate AND y.object = x.object AND y.subject <> x.subject),
common AS (SELECT doc_id, subject, peer, count(*) AS c FROM pairs GROUP BY 1, 2, 3),
akin AS (SELECT doc_id, subject, peer, greatest(CASE WHEN (a.k - 1) * (n - a.k + 1) * b.k * (n - b.k) > 0 THEN (n * (c - 1) - (a.k - 1) * b.k) / sqrt((a.k - 1) * (n - a.k + 1) * b.k * (n - b.k)) ELSE 0 END, 0) AS similarity FROM common JOIN own a USING (doc_id, subject) JOIN (SELECT doc_id, subject AS peer, k FROM own) b USING (doc_id, peer) JOIN width USING (doc_id) WHERE EXISTS (SELECT 1 FROM classifications p JOIN classifications q ON q.type = p.type WHERE p.instance = subject AND q.instance = peer)),
summed AS (SELECT doc_id, subject, predicate, object, sum(coalesce(similarity, 0)) AS score FROM pairs LEFT JOIN akin USING (doc_id, subject, peer) GROUP BY 1, 2, 3, 4)
SELECT count(*) AS n, count(*) FILTER (hit) AS correct, coalesce(count(*) FILTER (hit) / nullif(count(*), 0), 0.0) AS accuracy FROM (SELECT score > 1e-12 AND coalesce((SELECT max(probability) FROM markov_chain m JOIN classifications p ON p.type = m.subject JOIN classifications q ON q.type = m.object WHERE p.instance = s.subject AND q.instance = s.object AND m.predicate = s.predicate), 0) >= 1e-6 AS hit FROM summed s)"""
_NORMAL_AGAIN = f"""fused AS (SELECT doc_id, subject, product(value) FILTER (value <> 0) AS value FROM normal GROUP BY 1, 2 HAVING count(*) = 4),
again AS (SELECT doc_id, avg(value) AS mean, greatest((sum(value * value) - count(*) * avg(value) * avg(value)) / nullif(count(*) - 1, 0), 0) AS var FROM fused GROUP BY 1)
SELECT doc_id, subject, round(CASE WHEN v <= 0 THEN 1e-5 ELSE v END, 5) AS value FROM (SELECT doc_id, subject, (value - mean) / (CASE WHEN coalesce(var, 0) < 1e-18 THEN 1.0 ELSE sqrt(var) END) / 2 + 1 AS v FROM fused JOIN again USING (doc_id))"""

QUERIES = {
    "resolve_stack": (resolve_stack, f"{_CHOICE}, wide AS (SELECT doc_id, component, subject, {', '.join(f'max(vote) FILTER (resolver = {n!r}) AS {n}' for n in STACK)} FROM voted GROUP BY 1, 2, 3) SELECT *, {' + '.join(STACK)} AS fused, row_number() OVER (PARTITION BY doc_id, component ORDER BY {STACK[-1]} DESC, subject) = 1 AS winner FROM wide"),
    "disambiguation_all": (disambiguation_all, f"{_CHOICE}, truth AS {_TRUTH}, chosen AS (SELECT resolver, doc_id, subject FROM voted QUALIFY row_number() OVER (PARTITION BY resolver, doc_id, component ORDER BY vote DESC, subject) = 1), ambiguous AS (SELECT doc_id, subject FROM candidates QUALIFY count(*) OVER (PARTITION BY doc_id, component) > 1), few AS (SELECT resolver, doc_id, subject FROM truth JOIN ambiguous USING (doc_id, subject), (SELECT DISTINCT resolver FROM scores)) {_PR_OF.format(by='resolver', keys='doc_id, subject', found='chosen', truth='few')}"),
    "spotting_pr": (spotting_pr, f"{SPOT_SQL}, f1 AS (SELECT doc_id, uri || chr(9) || surface AS line FROM kept JOIN res_dict ON index = property), t1 AS (SELECT doc_id, uri || chr(9) || surface AS line FROM spans JOIN res_dict ON index = property WHERE literal = surface) {_PR_OF.format(by='doc_id', keys='line', found='f1', truth='t1')}"),
    "type_pr": (type_pr, f"{LINK_SQL}, f1 AS (SELECT doc_id, surface || chr(9) || r.uri AS line FROM inst JOIN instance_clusters USING (subject) JOIN res_dict r ON r.index = cluster), t1 AS (SELECT doc_id, surface || chr(9) || r.uri AS line FROM resolved JOIN instance_clusters USING (subject) JOIN res_dict r ON r.index = cluster) {_PR_OF.format(by='doc_id', keys='line', found='f1', truth='t1')}"),
    "rate_fuse_normal": (rate_fuse_normal, f"{RANK_SQL}, {_NORMAL_AGAIN}"),
    "rate_nine_fusions": (rate_nine_fusions, _NINE_SQL),
    "entity_types": (entity_types, f"{SPOT_SQL} SELECT doc_id, uri, count(*) AS n, min(a) AS first, count(DISTINCT lower(surface)) AS surfaces FROM (SELECT DISTINCT doc_id, property, a, b, surface FROM kept) JOIN res_dict ON index = property GROUP BY 1, 2"),
    "token_types": (token_types, f"{LINK_SQL}, votes2 AS (SELECT doc_id, a, cluster, count(*) AS n FROM (SELECT DISTINCT doc_id, a, subject FROM inst) JOIN instance_clusters USING (subject) GROUP BY 1, 2, 3) SELECT DISTINCT doc_id, a, cluster, 'known' AS kind FROM resolved JOIN instance_clusters USING (subject) UNION SELECT doc_id, a, cluster, 'predicted' FROM votes2 QUALIFY n >= 0.6 * sum(n) OVER (PARTITION BY doc_id, a)"),
    "token_ranges": (token_ranges, f'{SPOT_SQL}, asked AS (SELECT DISTINCT doc_id, a, b FROM kept) SELECT k.doc_id, k.a AS start, k.b AS "end", count(*) AS n FROM asked k JOIN tokens t ON t.doc_id = k.doc_id AND t.start >= k.a AND t."end" <= k.b GROUP BY 1, 2, 3 HAVING min(t.start) = k.a AND max(t."end") = k.b'),
    "loo_similar": (loo_similar, _SIMILAR),
    "workflow_report": (workflow_report, f"{LINK_SQL} SELECT step, 'rows' AS measure, avg(n) AS value FROM (SELECT 'instances' AS step, count(*) AS n FROM inst GROUP BY doc_id UNION ALL SELECT 'known facts', count(*) FROM facts GROUP BY doc_id) GROUP BY 1"),
    "vector_minus": (vector_minus, sql("SELECT coalesce(t.type, p.predicate) AS item, coalesce(t.count, 0)::DOUBLE - coalesce(p.n, 0) AS value FROM histogram_types t FULL JOIN (SELECT predicate, count(DISTINCT object) AS n FROM symbols GROUP BY 1) p ON p.predicate = t.type")),
    "conditional_lower": (lambda s, f: matrix.conditional(cooccurrence(s, f), lower=True), sql(f", {_COND} SELECT a, b, probability FROM cp WHERE a >= b").replace("\n, ", ",\n")),
    "hierarchical_cuts": (lambda s, f: matrix.hierarchical_cuts(correlations(s, f), [0.2, 0.5, 1.0]), None),
    "cluster_distances": (lambda s, f: _round(matrix.cluster_distances(correlations(s, f)), "value", digits=6), None),
}
