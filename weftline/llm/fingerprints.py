"""Document fingerprints by a homomorphic multiset hash.

Each paragraph of a text is hashed to a wide vector; the fingerprint of a text is the sum of its paragraphs' vectors.
So equal multisets of paragraphs have equal fingerprints, in any order, and a paragraph is inserted or deleted by one
addition or subtraction. A vector has two parts:

* ``LANES`` lanes of 16 hash bits, summed modulo 2^16: equality (as in LtHash; 1024 bits by default);
* ``SIGNS`` lanes of +1 or -1, summed modulo 2^16: likeness. The expected product of two different paragraphs' signs is
  0, so the cosine of two sums estimates how much two multisets share.

Paragraphs are the lines of a text; a line longer than ``LONG`` characters counts as one paragraph for each sentence, so
that likeness has a finer grain.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import map_batches, prepare

LANES, SIGNS, LONG = 64, 256, 200
_SENTENCE = re.compile(r"(?<=[.!?|]) +")
#: Rows between two boundaries of the order by doc_id, about.
BUCKET_ROWS = 10_000
#: Bounds what the driver holds of the order; buckets grow beyond it.
MOST_BUCKETS = 100_000


def paragraphs(text: str) -> list[str]:
    found: list[str] = []
    for line in text.split("\n"):
        if len(line) > LONG:
            found += _SENTENCE.split(line)
        else:
            found.append(line)
    return [p for p in found if p]


class Fingerprint:
    """A sum of paragraph vectors."""

    def __init__(self, lanes: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.lanes = np.zeros(LANES, dtype=np.uint16) if lanes is None else lanes
        self.signs = np.zeros(SIGNS, dtype=np.uint16) if signs is None else signs

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        return cls().update(Counter(paragraphs(text or "")))

    def update(self, counts: dict[str, int]) -> Fingerprint:
        """Add each paragraph as often as counts say; negative counts delete."""
        if counts:
            data = b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(LANES * 2 + SIGNS // 8) for p in counts)
            table = np.frombuffer(data, dtype=np.uint8).reshape(len(counts), -1)
            times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts)).astype(np.uint16)
            self.lanes += (np.ascontiguousarray(table[:, : LANES * 2]).view("<u2") * times[:, None]).sum(axis=0, dtype=np.uint16)
            ones = np.unpackbits(table[:, LANES * 2 :], axis=1).astype(np.uint16)
            self.signs += ((2 * ones - np.uint16(1)) * times[:, None]).sum(axis=0, dtype=np.uint16)
        return self

    def insert(self, paragraph: str) -> Fingerprint:
        return self.update({paragraph: 1})

    def delete(self, paragraph: str) -> Fingerprint:
        return self.update({paragraph: -1})

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.lanes + other.lanes, self.signs + other.signs)

    def __str__(self) -> str:
        return self.lanes.astype(">u2").tobytes().hex() + self.signs.astype(">u2").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal fingerprints, else the cosine of the sign sums, between 0 and 1."""
        if np.array_equal(self.lanes, other.lanes) and np.array_equal(self.signs, other.signs):
            return 1.0
        a, b = self.signs.view(np.int16).astype(np.float64), other.signs.view(np.int16).astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters from the start of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The fingerprints of every row of ``docs`` (doc_id, text) and of its text edited with the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Next is by descending
    doc_id, after the last the first; rows with equal ids follow each other by text hash, a null id comes last. A null
    text is empty. A single row is its own next.

    The order is cut at approximate quantiles of doc_id, one for about BUCKET_ROWS rows; only these bounds are on the
    driver. Each row goes to its bucket once, the first row of each bucket also to the bucket before it, so each
    bucket finds all its neighbours in itself and texts are shuffled once.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # descending ids as ascending keys; nulls last
    key = F.coalesce(F.bitwise_not("doc_id"), F.lit(2**63 - 1))
    keys = docs.select(key.alias("key"), F.xxhash64("text").alias("mark"))
    n = keys.count()
    buckets = max(1, min(n // BUCKET_ROWS, MOST_BUCKETS))
    bounds = sorted({int(x) for x in keys.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 10 * buckets)).head()[0]}) if buckets > 1 else []
    cuts = np.array(bounds, dtype=np.int64)
    # the first key of each bucket, in order: one row for each bucket
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(cuts.tobytes())

    def place():
        own = np.frombuffer(shared.value, dtype=np.int64)

        def step(columns):
            if columns is not None:
                yield {**columns, "bucket": np.searchsorted(own, np.array(columns["key"], dtype=np.int64), side="left")}

        return step

    firsts = map_batches(keys, "key long, mark long, bucket long", place).groupBy("bucket").agg(F.min(F.struct("key", "mark")).alias("f")).collect()
    order = sorted((r["bucket"], tuple(r["f"])) for r in firsts)
    # the bucket before each, for its first row; the first bucket's first row also follows the very last row
    ahead = {k: order[i - 1][0] for i, (_, k) in enumerate(order)}
    lead = session.sparkContext.broadcast(ahead)

    def deal():
        own, before = np.frombuffer(shared.value, dtype=np.int64), lead.value

        def step(columns):
            if columns is None:
                return
            home = np.searchsorted(own, np.array(columns["key"], dtype=np.int64), side="left").tolist()
            out: dict[str, list] = {"bucket": [], "guest": [], "key": [], "doc_id": [], "text": []}
            for bucket, k, mark, doc, text in zip(home, columns["key"], columns["mark"], columns["doc_id"], columns["text"]):
                for where, guest in ((bucket, False), *(((before[k, mark], True),) if (k, mark) in before else ())):
                    out["bucket"].append(where)
                    out["guest"].append(guest)
                    out["key"].append(k)
                    out["doc_id"].append(doc)
                    out["text"].append(text)
            yield out

        return step

    dealt = map_batches(docs.select(key.alias("key"), F.xxhash64("text").alias("mark"), "doc_id", "text"), "bucket long, guest boolean, key long, doc_id long, text string", deal)
    # each bucket is a task of its own, of about BUCKET_ROWS rows
    spread = dealt.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", "key", F.xxhash64("text"), "text")
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def pairs():
        held: list = [None]  # the row whose next is not known yet: bucket, doc_id, text, fingerprint
        done: list = [None]  # the bucket whose last row has met its guest

        def result(out, row, text, mark):
            changed = edited(row[2], text)
            other = Fingerprint.of(changed)
            out["doc_id"].append(row[1])
            out["n_chars"].append(len(row[2]))
            out["edited_sha256"].append(hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest())
            out["fingerprint"].append(str(row[3]))
            out["edited_fingerprint"].append(str(other))
            out["near_edited"].append(row[3].likeness(other))
            out["near_next"].append(row[3].likeness(mark))

        def step(columns_):
            if columns_ is None:
                return
            out: dict[str, list] = {c.split()[0]: [] for c in columns.split(", ")}
            for bucket, guest, doc, text in zip(*(columns_[c] for c in ("bucket", "guest", "doc_id", "text"))):
                if guest and done[0] == bucket:
                    continue  # of several first rows with one key only the first follows
                mark = Fingerprint.of(text)
                if held[0] is not None and held[0][0] == bucket:
                    result(out, held[0], text, mark)
                held[0] = None if guest else (bucket, doc, text, mark)
                if guest:
                    done[0] = bucket
            yield out

        return step

    return map_batches(spread.select("bucket", "guest", "doc_id", "text"), columns, pairs)
