"""Quality rules, classifier, language, fingerprints, PII and licenses on small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import fingerprints, kneser_ney, language_id, licenses, pii, quality_rules

from llm_rows import SCHEMA, base, brute_kneser_ney, brute_perplexity, brute_quality, prose

def test_base_rules(docs, clashing, empty, rows):
    want = Counter((d, *base(t)) for d, t, *_ in rows)
    for df in (docs, clashing):
        found = quality_rules.judge(df).collect()
        assert Counter(tuple(r)[:7] for r in found) == want
        assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality_rules.judge(empty).collect() == []


@pytest.mark.parametrize("kinds", [3, 40, 9000])
def test_repeats_with_many_words(kinds):
    r = np.random.default_rng(kinds)
    ids = np.concatenate([r.integers(0, kinds, 3000), np.arange(50) % kinds, np.arange(50) % kinds])
    text = " ".join(f"w{i}" for i in ids)
    assert quality_rules.repeated_words(ids, kinds) == base(text)[4]


def test_junk_is_far_and_prose_is_kept(spark):
    rows = [(i, prose(i, 300), "en", "s", 0) for i in range(40)]
    rows += [(100, " ".join(w.upper() + "!!" for w in prose(1, 300).split()), "en", "s", 0), (101, " ".join(w + "###" for w in prose(2, 300).split()), "en", "s", 0), (102, prose(77, 300), None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()}
    assert all(kept[i] for i in range(40)) and kept[102] and not kept[100] and not kept[101]
    left = quality_rules.keep(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, v in kept.items() if v)


def test_verdicts_against_brute_force(spark):
    """Both distances and the verdict of each document, by histograms over dictionaries."""
    texts = [(i, prose(i, 20 + 30 * i), "en" if i % 4 else "xx") for i in range(14)]
    texts += [(50, " ".join(w.upper() for w in prose(3, 90).split()), "en"), (51, "#$% " * 80 + prose(4, 40), "en"), (52, "1234 5678 " * 60, None), (53, " ".join(f"q{i}z" for i in range(500)), "en"), (54, None, "en"), (55, prose(2, 300), None)]
    found = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame([(*t, "s", 0) for t in texts], SCHEMA)).collect()}
    assert {r["kept"] for r in found.values()} == {True, False}
    for (d, *_), (chars, told, kept) in zip(texts, brute_quality(texts)):
        r = found[d]
        assert r["char_distance"] == (None if chars is None else pytest.approx(chars, abs=1e-9)) and r["word_distance"] == (None if told is None else pytest.approx(told, abs=1e-9))
        assert r["kept"] == kept


def test_distance():
    assert quality_rules.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality_rules.distance(np.array([1.0, 1]), np.array([2.0, 2])) == 0
    assert quality_rules.distance(np.zeros(2), np.zeros(2)) == 0 and quality_rules.distance(np.zeros(2), np.ones(2)) == 1


def test_kneser_ney(spark, docs, empty):
    texts = [prose(i, 40) for i in range(6)] + [None, ""]
    table = kneser_ney.log_probabilities(kneser_ney.count_grams(spark.createDataFrame([(t,) for t in texts], "text string")))
    brute = brute_kneser_ney(texts)
    for g in kneser_ney.Symbols().grams([*prose(50, 30).split(), "Ünseen", "#1", ""]):
        assert table[g] == pytest.approx(brute(int(g)), rel=1e-4)
    # the probabilities after a context sum to one
    for context in (0, 5, 1 << 6 | 3, 20 << 12 | 8 << 6 | 5):
        assert np.exp(table[context << 6 : (context << 6) + 64].astype(float)).sum() == pytest.approx(1, rel=1e-4)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in kneser_ney.classify(docs, none).collect())
    assert kneser_ney.classify(empty, none).collect() == []


def test_classifier_rejects_junk(spark, clashing):
    rows = [(i, prose(i, 120), "en", "s", 0) for i in range(60)] + [(100, " ".join(w.upper() + "!!" for w in prose(1, 120).split()), "en", "s", 0), (101, "|".join("#$" for _ in range(200)), "xx", "s", 0), (102, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(0, 1, 0), (100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r["kept"] for r in kneser_ney.classify(docs, labels).collect()}
    assert not found[100] and not found[101] and sum(found[i] for i in range(60)) >= 58 and found[102]
    left = kneser_ney.keep(docs, labels)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(k for k, v in found.items() if v)
    assert kneser_ney.keep(clashing, labels).columns == clashing.columns


def test_language(spark, docs, clashing, empty, rows):
    said = {"en": "the of and that with this from there where which have been", "de": "der die das und nicht mit von ist sich auch werden wurde", "fr": "le la les des et est dans pour avec qui que une nous"}
    import random

    r = random.Random(2)
    table = [(i, " ".join(r.choices(said[lang].split(), k=20)), lang, "s", 0) for i, lang in enumerate(r.choices(list(said), k=300))]
    docs2 = spark.createDataFrame([*table, (900, None, "en", "s", 0), (901, "123 !? ...", "en", "s", 0), (902, "der die das und", None, "s", 0)], SCHEMA)
    found = {x["doc_id"]: x for x in language_id.identify(docs2).collect()}
    assert all(found[i]["lang_pred"] == lang and 0 < found[i]["score"] <= 1 for i, _, lang, *_ in table)
    assert found[900]["lang_pred"] == "und" and found[901]["lang_pred"] == "und" and found[902]["lang_pred"] == "de"
    assert {i: x["held_out"] for i, x in found.items()} == {i: language_id.held_out(i) for i in found}
    assert Counter(x["doc_id"] for x in language_id.identify(clashing).collect()) == Counter(d for d, *_ in rows)
    assert language_id.identify(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "some text", None, "s", 0)], SCHEMA)
    assert language_id.identify(unlabelled).head()["lang_pred"] == "und"


def test_language_against_sets(spark, monkeypatch):
    """Predictions and scores against plain sets of n-grams of whole texts, with n-grams seen once, and with tiny chunks."""
    texts = [(i, prose(i, 12) if i % 3 else prose(i, 12)[::-1].upper(), "la" if i % 3 else "al") for i in range(40)] + [(50, "unseen words entirely", None), (51, "Ünïcode straße", "de"), (52, prose(1, 400), None)]
    docs = spark.createDataFrame([(*t, "s", 0) for t in texts], SCHEMA)

    def grams(text):
        w = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        w = f" {' '.join(w)} "
        return [w[i : i + k] for k in (3, 4) for i in range(len(w) - k + 1)]

    counts = {}
    for d, text, lang in texts:
        if lang and not language_id.held_out(d):
            counts.setdefault(lang, Counter()).update(grams(text))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    best = Counter()
    for own in share.values():
        for g, x in own.items():
            best[g] = max(best[g], x)
    known = {lang: {g for g, x in own.items() if x >= language_id.MIN_SHARE and x >= language_id.NEAR_BEST * best[g]} for lang, own in share.items()}
    for chunk in (200_000, 7):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        arrays = list(language_id.ngrams(texts[0][1]))
        assert sorted(np.concatenate(arrays).tolist()) == sorted(np.concatenate(list(language_id.ngrams(texts[0][1] + "!"))).tolist()) and sum(map(len, arrays)) == len(grams(texts[0][1]))
    for r in language_id.identify(docs).collect():
        text = next(t for d, t, _ in texts if d == r["doc_id"])
        scores = {lang: sum(g in own for g in grams(text)) / len(grams(text)) for lang, own in known.items()}
        assert r["score"] == pytest.approx(max(scores.values()), abs=2e-3)
        assert scores[r["lang_pred"]] == pytest.approx(max(scores.values()), abs=2e-3)


def test_language_tie(spark):
    """Of languages with equal scores the one with more training n-grams holds, then the name that sorts first."""
    rows = [(i, "same words here", lang, "s", 0) for i, lang in ((1, "b"), (3, "a"), (4, "c"), (6, "c"))]
    rows = [r for r in rows if not language_id.held_out(r[0])]
    found = language_id.identify(spark.createDataFrame([*rows, (100, "same words", None, "s", 0)], SCHEMA)).collect()
    sizes = Counter(r[2] for r in rows)
    assert {r["lang_pred"] for r in found} == {min(sizes, key=lambda x: (-sizes[x], x))}


def test_bit_slices_answer_all_languages():
    grams = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    model = language_id.Model([f"l{i:02d}" for i in range(70)], grams, [np.isin(np.arange(1000), np.arange(i, 1000, 70)) for i in range(70)], [1] * 70)
    hits = model.counts(grams)
    assert all(hits[i] >= len(range(i, 1000, 70)) for i in range(70)) and hits.sum() < 1.1 * 1000


@pytest.mark.parametrize("size", [2_000, 4])
def test_fingerprints(docs, clashing, empty, rows, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", size)  # small buckets: many borders
    ordered = sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    for df in (docs, clashing):
        found = fingerprints.fingerprint_documents(df).collect()
        got = Counter((r["doc_id"], r["n_chars"], r["fingerprint"]) for r in found)
        assert got == Counter((d, len(t), str(fingerprints.Fingerprint.of(t))) for d, t in ordered)
        shas = {r["doc_id"]: r["edited_sha256"] for r in found}
        ids = Counter(d for d, _ in ordered)
        for i, (d, t) in enumerate(ordered):
            follow = ordered[(i + 1) % len(ordered)]
            if ids[d] == 1 and ids[follow[0]] == 1:
                assert shas[d] == hashlib.sha256(fingerprints.edited(t, follow[1]).encode()).hexdigest()
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert fingerprints.fingerprint_documents(empty).collect() == []


def test_fingerprints_are_sums(spark):
    """Fingerprints and both likenesses against sums of the paragraphs' hash vectors in plain numbers."""

    def vectors(text):
        lanes, signs = [0] * fingerprints.LANES, [0] * fingerprints.SIGNS
        for line in text.split("\n"):
            for p in re.split(r"(?<=[.!?|]) +", line) if len(line) > 200 else [line]:
                if p:
                    data = hashlib.shake_128(p.encode()).digest(2 * fingerprints.LANES + fingerprints.SIGNS // 8)
                    for i in range(fingerprints.LANES):
                        lanes[i] = (lanes[i] + int.from_bytes(data[2 * i : 2 * i + 2], "little")) % 65536
                    for i in range(fingerprints.SIGNS):
                        signs[i] += 1 if data[2 * fingerprints.LANES + i // 8] >> (7 - i % 8) & 1 else -1
        return lanes, signs

    def name(v):
        return "".join(f"{x % 65536:04x}" for x in v[0] + v[1])

    def near(a, b):
        if a == b:
            return 1.0
        dot, size = sum(x * y for x, y in zip(a[1], b[1])), sum(x * x for x in a[1]) * sum(x * x for x in b[1])
        return min(1.0, max(0.0, dot / size**0.5)) if size else 0.0

    texts = ["one\ntwo\none", "two\none\none", "", "one", prose(1, 90), prose(1, 90) + "\nmore", "x\n" * 300]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, t, "en", "s", 0) for t in ("a", "b", None)], SCHEMA)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect() if r["doc_id"] is not None}
    for i, text in enumerate(texts):
        r, own = found[i], vectors(text)
        assert r["fingerprint"] == name(own)
        if i:  # after the last come the rows without an id
            other = texts[i - 1]
            half = len(text) // 2
            changed = vectors(text[: len(text) - half] + other[:half])
            assert r["edited_fingerprint"] == name(changed)
            assert (r["near_edited"], r["near_next"]) == pytest.approx((near(own, changed), near(own, vectors(other))))


def test_fingerprint_algebra():
    a, b, c = "first line", "second line", "third"
    whole = fingerprints.Fingerprint.of("\n".join([a, b, c, a]))
    assert str(whole) == str(fingerprints.Fingerprint.of("\n".join([c, a, a, b]))) != str(fingerprints.Fingerprint.of("\n".join([a, b, c])))
    assert str(whole.delete(a)) == str(fingerprints.Fingerprint.of(f"{a}\n{b}").insert(c))
    many = [f"paragraph {i}" for i in range(200)]
    near = fingerprints.Fingerprint.of("\n".join(many)).likeness(fingerprints.Fingerprint.of("\n".join(many[:100] + [f"other {i}" for i in range(100)])))
    assert 0.3 < near < 0.7
    assert fingerprints.Fingerprint.of("").likeness(fingerprints.Fingerprint.of(None)) == 1.0


def test_pii_consistency(spark, clashing, empty, rows):
    texts = [
        "Write to Ann.Lee@Mail.example.com or ann.lee@mail.example.com, not bob@x.org.",
        "Call +1 (017) 555-7713 or (017) 555-7713; card 4111 1111 1111 1111, 4111111111111111; at 10.0.0.17.",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and again 24be64439e3e49cf46b2d7c90f3602a3d0b907ff',
        "Mr. John Smith met Dr. Smith; MARY SMITH did not. госпожа Анна Петрова. GB82 WEST 1234 5698 7654 32. 123-45-6789",
        "Nothing here, on 3.14 and 2,000 words.",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    out = {r["doc_id"]: r for r in pii.pseudonymize(docs, b"key").collect()}
    assert out[4]["text"] == texts[4] and out[4]["n_entities"] == 0
    mails = re.findall(r"\S+@[\w.]+\w", out[0]["text"])
    assert mails[0].lower() == mails[1] != mails[2] and "ann.lee" not in out[0]["text"].lower()
    phones = re.findall(r"\(\d{3}\) \d{3}-\d{4}", out[1]["text"])
    assert len(phones) == 2 and phones[0] == phones[1] and "7713" not in out[1]["text"]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[1]["text"])
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111" and pii.luhn(cards[1])
    secrets = re.findall(r"[0-9a-f]{40}", out[2]["text"])
    assert len(secrets) == 2 and secrets[0] == secrets[1] and "24be64" not in out[2]["text"]
    names = re.match(r"Mr\. (\w+) (\w+) met Dr\. (\w+);", out[3]["text"])
    assert names[2] == names[3] != "Smith" and re.search(r"госпожа [А-Я][а-я]+ [А-Я][а-я]+\.", out[3]["text"])
    assert pii.iban_ok(re.search(r"GB\d\d [A-Z\d ]+", out[3]["text"])[0].replace(" ", "")) and "123-45-6789" not in out[3]["text"]
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs, b"key").collect()}
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs, b"another").collect()}
    assert again == {k: r["text"] for k, r in out.items()} and other[0] != again[0]
    found = pii.pseudonymize(clashing, b"key")
    assert Counter(r["doc_id"] for r in found.collect()) == Counter(d for d, *_ in rows) and set(clashing.columns) <= set(found.columns)
    assert pii.pseudonymize(empty, b"key").collect() == []


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_pii_people(spark, monkeypatch, broadcast):
    """One person keeps one name at every mention in every document; no mention stays in clear."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", broadcast)
    texts = [
        "Dr. Alex Smith spoke. Mr. Alex Smith left. Later Smith left, too; ALEX stayed.",
        "Mr. James Smith; James left; JAMES SMITH came back. A smith is no Smith.",
        "Priya Raman met Wei Zhang. Zhang said that Raman knew.",
        "Mrs. Robin Hale and Robin. Contact: Tomas Novak <t@x.org>. MR. JAMES HALE",
        "The New York Times met in March. Smith without a title stays.",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymize(docs, b"key").collect()}
    one = re.fullmatch(r"Dr\. (\w+) (\w+) spoke\. Mr\. (\w+) (\w+) left\. Later (\w+) left, too; (\w+) stayed\.", out[0])
    assert one[1] == one[3] == one[6].capitalize() != "Alex" and one[2] == one[4] == one[5] != "Smith" and one[6].isupper()
    assert one[1].lower() == pii.surrogate(b"key", "given latin", "alex", gender="m")
    two = re.fullmatch(r"Mr\. (\w+) (\w+); (\w+) left; ([A-Z]+) ([A-Z]+) came back\. A smith is no (\w+)\.", out[1])
    assert two[1] == two[3] == two[4].capitalize() != "James" and two[2] == two[5].capitalize() == two[6] == one[2]
    three = re.fullmatch(r"(\w+) (\w+) met (\w+) (\w+)\. (\w+) said that (\w+) knew\.", out[2])
    assert three[4] == three[5] and three[2] == three[6] and not {*three.groups()} & {"Priya", "Raman", "Wei", "Zhang"} and len({*three.groups()}) == 4
    four = re.fullmatch(r"Mrs\. (\w+) (\w+) and (\w+)\. Contact: (\w+) (\w+) <\S+>\. MR\. ([A-Z]+) ([A-Z]+)", out[3])
    assert four[1] == four[3] != "Robin" and four[2] == four[7].capitalize() and four[6].capitalize() == two[1] and four[5] != "Novak"
    assert four[1].lower() == pii.surrogate(b"key", "given latin", "robin", gender="f")
    assert out[4] == texts[4]


def test_pii_never_runs_out():
    """Beyond some nonce surrogates grow, so no two of a long row of draws are equal for ever."""
    for kind, value in (("ip", "1.2.3.4"), ("mac", "001122334455"), ("ssn", "123456789"), ("given latin", "al"), ("email", "a@b.org"), ("secret", "abcdefgh"), ("iban", "GB82WEST12345698765432")):
        drawn = [pii.surrogate(b"k", kind, value, n) for n in range(pii.LONGER, pii.LONGER + 40)]
        assert len(set(drawn)) == 40 and value not in drawn
    assert pii.render("ssn", "123-45-6789", "9876543210") == "987-65-43210"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_pii_collisions(spark, monkeypatch, broadcast):
    """With few surrogates nearly all collide at first; all end distinct, and none is a real value."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", broadcast)
    real = [f"1.2.3.{i}" for i in range(1, 10)] + [f"9.{i}.1.1" for i in range(1, 10)]
    plain = pii.surrogate
    squeezed = lambda key, kind, value, nonce=0, gender=None: plain(key, kind, value, nonce) if nonce > 2 else "5.5.5.5"
    found = spark.createDataFrame([("ip", v, None) for v in real], "kind string, value string, gender string")
    monkeypatch.setattr(pii, "surrogate", squeezed)
    try:
        rows = pii.assign(found, b"k").collect()
    finally:
        monkeypatch.setattr(pii, "surrogate", plain)
    subs = [r["sub"] for r in rows]
    assert len(rows) == len(real) and len(set(subs)) == len(real) and not set(subs) & set(real)
    docs = spark.createDataFrame([(i, f"host {v} up", "en", "s", 0) for i, v in enumerate(real)], SCHEMA)
    out = [r["text"].split()[1] for r in pii.pseudonymize(docs, b"k").collect()]
    assert len(set(out)) == len(real) and not set(out) & set(real)


def test_licenses(spark, docs, clashing, empty, rows):
    import duckdb

    mit = "\n".join(licenses.SENTENCES[i] + "." for i in (9, 10, 11, 12))
    wrapped = mit.replace(" the ", " the\n")
    table = [(1, f"x\n{mit}\ny"), (2, wrapped), (3, "Licensed under the Apache License, Version 2.0."), (4, "Permission is hereby granted."), (5, None), (6, ""), (7, "Released under the MIT License\nLicensed under CC BY-NC 4.0."), (8, "no license here"), (9, "SPDX-License-Identifier: MIT")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert found == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "", 5: "", 6: "", 7: "CC-BY-NC-4.0,MIT", 8: "", 9: found[9]}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in [*table, *((d, t) for d, t, *_ in rows)]])
    both = df.unionAll(docs.select("doc_id", "text"))
    assert Counter(map(tuple, licenses.scan(both).collect())) == Counter(con.execute(licenses.scan_sql()).fetchall())
    assert licenses.scan(clashing).count() == len(rows) and licenses.scan(empty).collect() == []
    assert not any("Python" in line or "Arrow" in line for line in licenses.scan(df)._jdf.queryExecution().toString().splitlines())


def test_license_sentences_of_several_parts(spark):
    gpl = lambda *i: ". ".join(licenses.SENTENCES[k] for k in i) + "."
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0'
    table = [
        (1, "SPDX-License-Identifier: MIT", "MIT"), (2, "// SPDX-License-Identifier: Apache-2.0\nint x;", "Apache-2.0"),
        (3, "SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), (4, "SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"),
        (5, "SPDX-License-Identifier: Zlib", ""), (6, "SPDX-License-Identifier: Zlib\nMIT", ""),
        (7, gpl(15, 16, 17), "GPL-2.0-or-later"), (8, gpl(14, 16, 17).replace(" the ", "\n * the "), "GPL-3.0-or-later"),
        (9, gpl(27), "MPL-2.0"), (10, gpl(27).replace("2.0", "1.1"), ""), (11, apache, "Apache-2.0"), (12, gpl(15, 16), ""),
    ]
    found = licenses.scan(spark.createDataFrame([r[:2] for r in table], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == {i: want for i, _, want in table}


def test_license_variable_parts(spark):
    """Holders' names, list marks, comment marks and addresses vary; versions do not; SQL gives the same."""
    import duckdb

    bsd = "Copyright (c) 2019, {w}. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n{three}\nTHIS SOFTWARE IS PROVIDED BY {w} ''AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    third = "3. Neither the name of {w} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    lesser = ". ".join(licenses.SENTENCES[k] for k in (34, 35, 36)) + "."
    mit = ".\n".join(licenses.SENTENCES[i] for i in (9, 10, 11, 12)).replace("THE AUTHORS OR COPYRIGHT HOLDERS", "EXAMPLE CORP") + "."
    table = [
        (1, bsd.format(w="The Example Foundation", three=""), "BSD-2-Clause"), (2, bsd.format(w="Some Body", three=third.format(w="Some Body")), "BSD-3-Clause"),
        (3, "\n".join(f" * {x}" for x in bsd.format(w="X", three=third.format(w="the University of Nowhere")).split("\n")), "BSD-3-Clause"),
        (4, lesser, "LGPL-2.1-or-later"), (5, lesser.replace("2.1", "4.0"), ""), (6, mit, "MIT"), (7, "# SPDX-License-Identifier: EPL-2.0\n", "EPL-2.0"),
        (8, licenses.SENTENCES[40].replace("http:", "https:") + "/.", "EPL-2.0"), (9, "SPDX-License-Identifier: EPL-1.0", ""),
    ]
    df = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string")
    found = licenses.scan(df).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == {i: want for i, _, want in table}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r[:2]) for r in table])
    assert Counter(map(tuple, found)) == Counter(con.execute(licenses.scan_sql()).fetchall())


@pytest.mark.parametrize("block", [60_000, 2])
def test_word_model_is_the_recursion(spark, monkeypatch, block):
    """Perplexity of each document, the limits by language and the verdicts, against brute force over dictionaries; with
    many small blocks too. Null, empty and repeated rows, a null id and a language with two trusted documents are among them."""
    from weftline.llm import word_model

    monkeypatch.setattr(word_model, "BLOCK_DOCS", block)
    texts = [(i, prose(i, 30 + i)) for i in range(24)] + [(50, "quite other words here"), (51, "the the the the"), (52, None), (53, ""), (None, "no id at all"), (54, prose(3, 40)), (54, prose(3, 40))]
    trusted = set(range(16))
    lang = lambda d: "de" if d in (3, 4, 54) else None if d == 5 else "en"
    docs = spark.createDataFrame([(d, t, lang(d), "s", 0) for d, t in texts], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(20, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    want = sorted((d if d is not None else -1, *x) for (d, _), x in zip(texts, brute_perplexity(spark, [(d, t, lang(d)) for d, t in texts], trusted)))
    found = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *tuple(r)[1:]) for r in kneser_ney.classify(docs, labels).collect())
    assert len(found) == len(want)
    for x, y in zip(found, want):
        assert x[:2] == y[:2] and x[4] == y[4]
        assert x[2:4] == pytest.approx(y[2:4], rel=2e-3)


def test_flags(spark, monkeypatch):
    """Ids that only the Bloom filter lets pass are not trusted, whether they go as a set or by a join."""
    from weftline.llm import bloom, word_model

    monkeypatch.setattr(bloom, "BLOOM_BITS", 1 << 12)
    docs = spark.range(3000).selectExpr("nullif(id, 7) as doc_id", "'x' as text")
    labels = spark.range(0, 3000, 3).selectExpr("id as doc_id", "cast(1 + id % 2 as int) as quality")
    for few in (100_000, 0):
        monkeypatch.setattr(word_model, "FEW_IDS", few)
        rows, make = word_model.flagged(docs, labels)
        rows = rows.collect()
        flags = make()({"doc_id": [r["doc_id"] for r in rows], "mark": [r["mark"] for r in rows]})
        assert len(rows) == 3000 and {r["doc_id"] for r, f in zip(rows, flags) if f} == set(range(0, 3000, 6))


def test_classifier_sees_word_order(spark):
    import random

    r = random.Random(4)
    follows = {w: r.sample(sorted({*"abcdefghij"}), 2) for w in "abcdefghij"}

    def chain(n):
        w = [r.choice("abcdefghij")]
        while len(w) < n:
            w.append(r.choice(follows[w[-1]]))
        return " ".join(f"w{x}o{x}" for x in w)

    good = [(i, chain(400), "en", "s", 0) for i in range(60)]
    mixed = [(100 + i, " ".join(r.sample(good[i][1].split(), 400)), "en", "s", 0) for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["kept"] for x in kneser_ney.classify(spark.createDataFrame(good + mixed, SCHEMA), labels).collect()}
    assert sum(kept[i] for i in range(60)) >= 58 and not any(kept[100 + i] for i in range(5))
