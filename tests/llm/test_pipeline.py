"""The stages of the pipeline take effect, each on its own input; the query names are there."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weftline.llm import kneser_ney, pii, quality_rules
from weftline.llm.queries import JSON, PII_KEY

from llm_rows import brute, brute_perplexity, brute_quality


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("data")
    docs.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    one = corpus_pipeline.rule_quality(spark, docs, folder)
    verdicts = quality_rules.judge(docs).where("kept")
    assert Counter(r["doc_id"] for r in one.collect()) == Counter(r["doc_id"] for r in verdicts.collect())
    two = corpus_pipeline.model_quality(spark, one, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert Counter(r["doc_id"] for r in two.collect()) == Counter(r["doc_id"] for r in kneser_ney.classify(one, labels).where("kept").collect())
    three = corpus_pipeline.deduplicate(spark, docs, folder)
    rows = docs.select("doc_id", "text").collect()
    want = {d for (d, _, c), _ in brute([tuple(r) for r in rows], 5, 80).items() if d is not None and d == c}
    assert sorted(r["doc_id"] for r in three.where("doc_id is not null").collect()) == sorted(want)
    assert three.where("doc_id is null").count() == 1
    four = corpus_pipeline.surrogates(spark, docs, folder)
    assert all(x.columns == docs.columns for x in (one, two, three, four))
    assert four.where(F.col("n_chars") != F.length("text")).count() == 0


def brute_pii(texts):
    """The texts with surrogates, entity after entity: of equal draws the least value holds, real values are none."""
    found, said = {m[2:] for t in texts if t for m in pii.mentions(t)}, [x for t in texts if t for x in pii.scan(t)[1]]

    def gender(kind, value):
        told = {g for k, v, g in said if (k, v) == (kind, value)}
        known = {"m": pii.MALE_NAMES, "f": pii.FEMALE_NAMES}
        return next((g for g, names in known.items() if value in {n.lower() for n in names}), told.pop() if len(told) == 1 else "n") if kind.startswith("given") else None

    chosen, pending, nonce = {}, found, 0
    while pending:
        drawn = {}
        for kind, value in sorted(pending):
            drawn.setdefault((kind, pii.surrogate(PII_KEY, kind, value, nonce, gender(kind, value))), []).append(value)
        taken = {(k, chosen[k, v]) for k, v in chosen}
        good = {(kind, values[0]): sub for (kind, sub), values in drawn.items() if (kind, sub) not in found and (kind, sub) not in taken}
        chosen |= good
        pending, nonce = pending - good.keys(), nonce + 1
    out = []
    for t in texts:
        new, at = [], 0
        for a, b, *entity in pii.mentions(t) if t else ():
            new += [t[at:a], pii.render(entity[0], t[a:b], chosen[tuple(entity)])]
            at = b
        out.append(None if t is None else "".join([*new, t[at:]]))
    return out


def brute_run(spark, rows, trusted):
    """doc_id and ids with an end mark of every document that the stages leave, one plain step after another."""
    from tokenizers import Tokenizer

    rows = [r for r, x in zip(rows, brute_quality([r[:3] for r in rows])) if x[2]]
    rows = [r for r, x in zip(rows, brute_perplexity(spark, [r[:3] for r in rows], trusted)) if x[3]]
    least = Counter(d for d, _, c in brute([r[:2] for r in rows], 5, 80).elements() if d == c and d is not None)
    one = {}
    for r in rows:
        if r[0] in least:
            one.setdefault(r[0], r)
    rows = [*one.values(), *(r for r in rows if r[0] is None)]
    library = Tokenizer.from_file(JSON)
    return Counter((r[0], tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)) for r, t in zip(rows, brute_pii([r[1] for r in rows])))


def check_run(spark, path, rows, trusted):
    found = [r.asDict() for r in corpus_pipeline.run(spark, str(path)).collect()]
    want = brute_run(spark, rows, trusted)
    whole = {}
    for r in found:
        whole.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert whole.keys() == {d for d, _ in want}
    for d, ids in want:
        pieces = sorted(whole[d])
        assert [p for p, *_ in pieces] == list(range(len(pieces))) and sum(n for _, _, n, _ in pieces) == len(ids)
        for _, start, n, crc in pieces:
            assert crc == zlib.crc32(np.array(ids[start : start + n], dtype="<u4").tobytes())
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    return found


def test_run(spark, folder, rows):
    """The whole pipeline against brute force."""
    distinct = [(d, t, lang) for d, t, lang, *_ in rows]
    assert check_run(spark, folder, distinct, set(range(20)))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "n-gram Jaccard join", "PII surrogates", "best-fit packing"]


@pytest.mark.parametrize("case", ["empty", "nothing trusted", "clashing"])
def test_run_on_odd_tables(spark, tmp_path, rows, docs, clashing, empty, case):
    labels = [(i, int(case != "nothing trusted"), 0) for i in range(20)]
    {"empty": empty, "nothing trusted": docs, "clashing": clashing}[case].write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = check_run(spark, tmp_path, [] if case == "empty" else [(d, t, lang) for d, t, lang, *_ in rows], set() if case == "nothing trusted" else set(range(20)))
    assert bool(found) == (case != "empty")


def test_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
