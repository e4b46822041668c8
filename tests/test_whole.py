"""Queries do the whole job, on small tables and against brute force."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import spotting
from weftline.operators.kb import KnowledgeBase, numbered, table_of_type
from weftline.plans import corpus, knowledge, learning
from weftline.sources import corpus as corpora, triples

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(tmp_path):
    """The smallest tables, with documents of one's own."""

    def make(spark, texts):
        for file in os.listdir(SF):
            if file != "documents.parquet":
                os.symlink(f"{SF}/{file}", tmp_path / file)
        rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return make


def test_ngrams_beyond_word_200(spark, folder):
    words = [f"w{i % 230}" for i in range(500)]
    found = {r["gram"]: r["n"] for r in corpus.word_ngrams(spark, folder(spark, [" ".join(words)])).collect()}
    want = Counter("g:" + ",".join(words[i : i + 3]) for i in range(498))
    assert found == {g: n for g, n in want.items() if n > 1}


def test_labels_of_every_sentence(spark, folder):
    at = folder(spark, [" ".join(f"Some of them saw Berlin and {i} cats." for i in range(30))])
    lines = [r for r in learning.labelled_corpus(spark, at).collect()]
    assert sorted(r["sent"] for r in lines) == list(range(30))
    assert all(f"{r['sent']} CD" in r["text"] for r in lines)
    words = [r["line"].split()[0] for r in learning.conll_lines(spark, at).orderBy("n").collect() if r["line"]]
    assert [int(w) for w in words if w.isdigit()] == list(range(30))


def test_every_shipment_is_in_the_matrix(spark):
    m = learning.shipments(spark, SF)
    assert m.agg(F.sum("value")).head()[0] == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_literal_candidates_of_every_prefix(spark):
    k = knowledge.kb(spark, SF)
    ids = [r["index"] for r in k.property_ids("brand", "title").collect()]
    literals = {r["index"]: r["literal"] for r in k.literals.collect()}
    want = {(r["predicate"], literals[r["object"]]) for r in k.symbols.where(F.col("predicate").isin(ids)).collect()}
    found = {(r["predicate"], r["literal"]) for r in knowledge.literal_candidates_filtered(spark, SF).collect()}
    assert found == want


def test_suffixes_of_100_characters(spark, folder):
    # the same three words, other words behind them, and then the same beyond 100 characters
    t = "the same words one. " + "the same words two. " + "z " * 80
    row = corpus.suffix_array(spark, folder(spark, [t])).head()
    want = [t[m.start() : m.start() + 100] for m in re.finditer("[a-z]+", t)]
    assert (row["n"], row["distinct"], row["least"]) == (len(want), len(set(want)), min(want))


def test_only_suffixes_that_may_match_are_dealt(spark):
    literals = ["New York City", "USA", "x", "Σίσυφος", "İzmir", "Customer#000000001"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(literals)], "index int, literal string")
    symbols = spark.createDataFrame([(9, 1, i, 1.0) for i in range(len(literals))], "subject int, predicate int, object int, belief double")
    long = "plain words " * 200 + "new york city, usa x Σίσυφος İzmir Customer#000000001 New York only"
    docs = spark.createDataFrame([(1, long)], "doc_id long, text string")
    found = spotting.spot(docs, rows, symbols)
    assert sorted(r["literal"] for r in found.collect()) == sorted(literals)
    wanted = spotting.literal_rows(rows, symbols).withColumn("head", F.substring("low", 1, 3))
    assert spotting.suffixes(docs, 9, spotting.beginnings(wanted, [1, 3])).count() < 20 < spotting.suffixes(docs, 9).count()


#: Plans of these give each text's rows in one pass: nothing is dealt.
@pytest.mark.parametrize("name", ["sentences", "pos_rules", "np_tags", "phrase_stats", "labelled_corpus", "suffix_array"])
def test_texts_are_not_dealt(spark, folder, name):
    from weftline import catalog

    df = catalog.queries()[name](spark, folder(spark, ["The old man sat. He saw the big Berlin and 3 cats.", "", "a b"]))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_annotations_are_those_of_the_windows(spark):
    texts = ["The the old man. The", "3.5 Häuser!And \"No\" … he sat . the big Der of", "quickly\u00a0running beautiful Berlin . . ? ok", "the.", "x", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = text.chunked(text.tagged(text.sentence_flags(text.tokens(docs))))
    names = ["doc_id", "start", "end", "token", "sent", "pos", "np"]
    assert sorted(text.annotated(docs).select(names).collect()) == sorted(want.select(names).collect())


def test_documents_of_a_long_conll_file(spark):
    lines = [(f, n, "-DOCSTART- -X- O O" if n % 7 == 0 else f"w{n} NN O O") for f in ("a", "b") for n in range(500)]
    df = spark.createDataFrame(lines, "file string, n long, line string").repartition(9)
    found = corpora.conll_documents(df).collect()
    assert sorted((r["file"], r["n"], r["doc"]) for r in found) == [(f, n, n // 7 + 1) for f, n, line in lines if n % 7]


def test_types_and_chain_without_all_relations(spark):
    k = KnowledgeBase(triples.ingest(triples.star_triples(spark, SF)), table_of_type, keep=False)
    assert k.types.count() and k.type_clusters.count() and k.markov_chain(5).count() and k.coverage_ambiguity.count()
    assert "relations" not in k.__dict__
    types, p = k.types.count(), k.uri_index(triples.RDF_TYPE)
    assert k.relations.where(F.col("predicate") == p).count() == types


def test_numbers_are_dealt_once(spark):
    df = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).cast("string").alias("k")).repartition(5), "k")
    found = [(r["k"], r["index"]) for r in df.collect()]
    assert sorted(found) == [(k, i + 1) for i, k in enumerate(sorted(str(i) for i in range(1000)))]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" not in plan.replace("broadcast", "").split("BroadcastExchange")[0]
