"""Filters of fixed size, and what is read and dealt through them."""

import pytest
from pyspark.sql import functions as F

from weftline.functions.filters import likely
from weftline.operators import linking, rating, sinks
from weftline.operators.kb import KnowledgeBase, table_of_type
from weftline.sources import triples

SF = "/root/testdata/sf0.001"


@pytest.fixture
def kb(spark):
    return KnowledgeBase(triples.ingest(triples.star_triples(spark, SF)), table_of_type, keep=False)


def test_likely_keeps_all_that_is_wanted(spark):
    df = spark.range(5000).select("id", F.col("id").cast("string").alias("name")).unionAll(spark.createDataFrame([(None, None)], "id long, name string"))
    wanted = spark.range(0, 5000, 7).select(F.col("id").cast("int").alias("x"), F.col("id").cast("string").alias("y"))
    kept = {r["id"] for r in likely(df, ["id", "name"], wanted).collect()}
    rest = {r["id"] for r in likely(df, ["id", "name"], wanted, keep=False).collect()}
    assert kept >= set(range(0, 5000, 7)) and len(kept) < 730
    assert not kept & rest and kept | rest == {None, *range(5000)}
    assert likely(df, ["id"], wanted.select("x").limit(0)).count() == 0


def test_edges_of_some_without_all_relations(kb):
    ids = kb.resources.where("uri like '%/nation/1%' or uri like '%/item/%'").select("index")
    subjects, objects = kb.outgoing(ids).collect(), kb.incoming(ids).collect()
    types, clusters, best = kb.types_of(ids).collect(), kb.clusters_of(ids).collect(), kb.best_cluster_of(ids).collect()
    assert not {"relations", "types", "classifications"} & set(kb.__dict__)
    wanted = {r["index"] for r in ids.collect()}
    every = sorted(kb.relations.collect())
    assert sorted(subjects) == [r for r in every if r["subject"] in wanted]
    assert sorted(objects) == [r for r in every if r["object"] in wanted]
    assert sorted(types) == sorted(r for r in kb.types.collect() if r["subject"] in wanted)
    assert sorted(map(tuple, clusters)) == sorted((r["instance"], r["type"]) for r in kb.classifications.collect() if r["instance"] in wanted)
    assert sorted(best) == sorted(r for r in kb.instance_clusters.collect() if r["subject"] in wanted)


def test_linking_and_chain_without_all_relations(spark, kb):
    ids = kb.resources.where("uri like '%/item/%' or uri like '%/nation/%'").select("index")
    found = ids.select(F.lit(1).cast("long").alias("doc_id"), F.col("index").alias("subject"), F.col("index").alias("component"))
    facts, edges = linking.known_facts(found, kb).collect(), linking.staged_expansion(found, kb).collect()
    chain = kb.markov_chain(100).collect()
    judged = linking.leave_one_out(linking.known_facts(found, kb), kb, kb.markov_top(kb.markov_chain(100), 1)).head()
    assert facts and edges and chain and judged["n"] == sum(1 for r in linking.known_facts(found, kb).join(kb.instance_clusters.select(F.col("subject").alias("object")), "object").collect())
    assert not {"relations"} & set(kb.__dict__)
    wanted = {r["index"] for r in ids.collect()}
    assert sorted(facts) == sorted((1, *r) for r in kb.relations.distinct().collect() if r["subject"] in wanted)
    ratio = {r["predicate"]: r["ratio"] for r in kb.cardinality("subject").collect()}
    assert {r["predicate"]: r["ratio"] for r in kb.subject_ratio(kb.relations).collect()} == ratio



def test_words_without_mentions_are_not_dealt(spark):
    docs = spark.createDataFrame([(1, "Berlin is big and Berlin is old"), (2, "no mention at all"), (3, "old Berlin")], "doc_id long, text string")
    found = spark.createDataFrame([(1, 7, 0, "Berlin"), (1, 7, 18, "Berlin is"), (3, 8, 0, "old Berlin")], "doc_id long, subject int, a int, surface string")
    rated = {(r["doc_id"], r["subject"]): r["value"] for r in rating.by_frequency(found, docs).collect()}
    assert rated == {(1, 7): pytest.approx(2 / 7), (3, 8): pytest.approx(1 / 2)}
    rare = {(r["doc_id"], r["subject"]): r["value"] for r in rating.by_rarity(found, docs).collect()}
    import math

    assert rare == {(1, 7): pytest.approx(math.log(3)), (3, 8): pytest.approx(math.log(3))}
    assert "BroadcastHashJoin" in rating.by_frequency(found, docs)._jdf.queryExecution().executedPlan().toString()


def test_texts_without_marks_are_not_dealt(spark):
    docs = spark.createDataFrame([(1, "a < b"), (2, "plain & simple"), (3, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 4, 5, "x:b", "p")], "doc_id long, start int, end int, about string, property string")
    found = {r["doc_id"]: r["xhtml"] for r in sinks.rdfa(docs, marks).collect()}
    assert set(found) == {1, 2, 3}
    assert '<span about="x:b" property="p">b</span>' in found[1] and "plain &amp; simple</body>" in found[2] and found[3] is None
    assert "LeftAnti" in sinks.rdfa(docs, marks)._jdf.queryExecution().executedPlan().toString()


def test_rating_one_metric_makes_no_other(spark):
    from weftline.plans import corpus

    c = corpus.ctx(spark, SF)
    c._rated.clear()
    assert corpus.rate("degree")(spark, SF).count() >= 0 and set(c._rated) == {"degree"}
