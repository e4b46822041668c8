"""Examples of one pass over a text, and classification that deals each feature once."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import features
from weftline.plans import learning

TEXTS = ["Yes, Berlin and 3 of 4.5 cats saw Old Paris. It is 12-14 km. He met Anna Maria, 5 ROMANS and IV kings!", "x", "", "we saw Rome 7", "A big Dog. The 9 lives of 10 Cats; they ate 1,000 mice in Bonn and Ulm.", "no examples here at all"] * 3


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_examples_in_one_pass(docs):
    words = text.annotated(docs).select("doc_id", "sent", "i", F.col("token").alias("word"), "pos", "np", learning._label().alias("label"))
    want = features.context_features(words, features.examples(words))
    found = features.text_examples(docs, learning._label_of)
    assert sorted(found.select(want.columns).collect()) == sorted(want.collect()) and found.count() > 30
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def _same(found, want):
    found, want = ({(r["doc_id"], r["sent"], r["lower"]): r for r in df.collect()} for df in (found, want))
    assert set(found) == set(want)
    for key, r in want.items():
        assert found[key]["best"] == r["best"] and found[key]["accepted"] == r["accepted"]
        assert (found[key]["p1"], found[key]["p2"]) == (pytest.approx(r["p1"]), pytest.approx(r["p2"]))


def test_judged_as_classified(docs):
    rows = features.text_examples(docs, learning._label_of)
    _same(features.judge(rows), features.classify(rows, features.train_weights(rows)))
    numbered = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    want = None
    for fold in range(3):
        one = features.classify(numbered.where(F.col("fold") == fold), features.train_weights(numbered.where(F.col("fold") != fold)), 0.0)
        want = one if want is None else want.unionAll(one)
    _same(features.judge(rows, 3, 0.0), want)


def test_labels_that_training_lacks(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, "A", ["i:x"]), (1, 0, 2, 2, "A", []), (2, 0, 0, 0, "B", ["i:x", "i:y"])], "doc_id long, sent int, lower int, upper int, label string, features array<string>")
    _same(features.judge(rows), features.classify(rows, features.train_weights(rows)))
    assert {r["best"] for r in features.judge(rows.where("label = 'A'")).collect()} == {"A"}
    assert features.judge(rows.limit(0)).count() == 0
