"""The join and the pipeline against brute force."""

import random
from collections import Counter

import pytest

from weftline.llm import jaccard_join

from llm_rows import SCHEMA, brute, prose

@pytest.mark.parametrize(("k", "t"), [(4, 85), (5, 80)])
def test_join(docs, clashing, rows, k, t):
    want = brute([(d, x) for d, x, *_ in rows], k, t)
    df = docs if k == 4 else clashing
    assert Counter(map(tuple, jaccard_join.jaccard_components(df, k, t).collect())) == want


def test_empty(empty):
    assert jaccard_join.jaccard_components(empty).collect() == []


@pytest.mark.parametrize("block", [60_000, 5])
def test_families(spark, monkeypatch, block):
    """Families with many edits, chains of copies of copies, a passage in all, tiny texts; with large and with tiny blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    r = random.Random(7)
    passage = prose(99, 30)
    texts = []
    for family in range(6):
        words = prose(family, r.randint(30, 120)).split()
        for _ in range(12):
            w = list(words)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
            texts.append(" ".join(w))
            if r.random() < 0.5:
                words = w  # a copy of the copy
    texts += [f"{prose(1000 + i, 20)} {passage} {prose(2000 + i, 20)}" for i in range(25)] + ["a b", "A B", "a", "c", "a b c d", ""] + [texts[0]] * 5
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(5)
    for k, t in ((4, 85), (3, 50)) if block > 5 else ((4, 80),):
        assert Counter(map(tuple, jaccard_join.jaccard_components(docs, k, t).collect())) == brute(rows, k, t)


def test_one_in_each_partition(spark):
    """A passage that stands once in each of many partitions is found, and so are copies that never share a partition."""
    passage = prose(99, 40)
    rows = [(i, f"{passage} {prose(500 + i, 6)}" if i % 2 else prose(i // 20, 50)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(60, "doc_id")
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs, 4, 85).collect())) == brute(rows, 4, 85)


def test_same_id(spark):
    """Rows that share a doc_id are documents of their own."""
    rows = [(1, prose(1, 30)), (1, prose(2, 30)), (2, prose(1, 30)), (3, prose(2, 30)), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs, 4, 85).collect())) == brute(rows, 4, 85)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (104, 103), (7, 7)]
    random.Random(1).shuffle(chain)
    found = {r["sid"]: r["comp"] for r in jaccard_join.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 41)} == {1} and {found[i] for i in (100, 101, 103, 104)} == {100}
