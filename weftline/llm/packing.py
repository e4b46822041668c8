"""Best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

Only lengths decide how many sequences are needed, and there are as many different lengths as tokens fit a sequence, so
the whole instance is a histogram. It is summed on the executors; its bounded number of classes goes to the driver.

There the reduction fixes sets of up to three lengths that dominate all others that their longest member could be packed
with, for as many documents at a time as the histogram has of them, until none is left. Best-fit decreasing packs the rest, also by classes: equal sequences are one pattern
with a multiplicity. The number of patterns is bounded by the number of lengths, not by the number of documents.

Back on the executors, each piece gets its rank among the pieces of its length, from counts by (length, bucket) and its
rank within its bucket; buckets are of bounded size. Rank and length say which pattern, copy and offset it gets.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.llm.common import map_batches, prepare
from weftline.llm.tokens import Vocabulary
from weftline.session import materialize

#: Pieces in a bucket, on average.
BUCKET_ROWS = 4_000


class Lengths:
    """A multiset of lengths as counts, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.order[bisect_left(self.order, length)]

    def largest(self, limit: int, used: tuple[int, ...] = ()) -> int | None:
        """The largest length of at most ``limit`` of which more than ``used`` has are left."""
        at = bisect_right(self.order, limit) - 1
        while at >= 0:
            length = self.order[at]
            if self.counts[length] > used.count(length):
                return length
            at -= 1
        return None

    def smallest(self, n: int, used: tuple[int, ...] = ()) -> list[int]:
        """The ``n`` smallest lengths (with repeats) besides those in ``used``."""
        found: list[int] = []
        for length in self.order:
            found += [length] * min(n - len(found), self.counts[length] - used.count(length))
            if len(found) >= n:
                break
        return found

    def times(self, pattern: tuple[int, ...]) -> int:
        """How often the whole pattern can be taken."""
        return min(self.counts[x] // pattern.count(x) for x in set(pattern))


def dominating(left: Lengths, capacity: int, length: int) -> tuple[int, ...] | None:
    """A set with one ``length`` that dominates every other set with it, or None if no set of up to three is known to.

    A set dominates another if the other's members can be dealt out so that each member of the first takes over a part
    that is no longer than itself; then some best packing has the first. With r the room left beside ``length``:
    nothing fits r; or one other length fills r wholly; or no two fit r, and then the longest that fits; or no three fit
    r, and then a pair whose longer member is the longest that fits and whose shorter one is at least the shorter member
    of any pair that fits.
    """
    room, used = capacity - length, (length,)
    one = left.largest(room, used)
    if one is None:
        return (length,)
    if one == room:
        return (length, one)
    least = left.smallest(3, used)
    if len(least) < 2 or least[0] + least[1] > room:
        return (length, one)
    if len(least) < 3 or sum(least) > room:
        two = left.largest(room - one, (length, one))
        half = left.largest(room // 2, used)
        if two is not None and half is not None and two >= half:
            return (length, one, two)
    return None


def pack(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in descending order) with multiplicities that hold all ``counts`` of lengths."""
    left, patterns = Lengths(counts), []
    changed = True
    while changed:
        changed = False
        for length in reversed(list(left.order)):
            while length in left.counts and (found := dominating(left, capacity, length)):
                n = left.times(found)
                # fixing all at once is the same as one after another while the reason for it still holds
                if len(found) > 1 and found[1] != capacity - length:
                    n = 1 if len(set(found)) < len(found) else max(1, min(left.counts[x] for x in set(found)) - 1)
                for x in found:
                    left.take(x, n)
                patterns.append((tuple(sorted(found, reverse=True)), n))
                changed = True
            if length not in left.counts:
                continue
    # best fit decreasing: open sequences by room
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def add(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_:
            open_[room] = {}
            insort(rooms, room)
        open_[room][pattern] = open_[room].get(pattern, 0) + n

    for length in reversed(list(left.order)):
        n = left.counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fits = capacity // length
                whole, rest = divmod(n, fits)
                if whole:
                    add(capacity - fits * length, (length,) * fits, whole)
                if rest:
                    add(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[at]
            pattern, m = next(iter(open_[room].items()))
            k = min(n, m)
            if k == m:
                del open_[room][pattern]
                if not open_[room]:
                    del open_[room]
                    del rooms[at]
            else:
                open_[room][pattern] = m - k
            add(room - length, (*pattern, length), k)
            n -= k
    patterns += [(pattern, n) for found in open_.values() for pattern, n in found.items()]
    return patterns


def plan(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks, offsets in the sequence and first sequence numbers of runs of equal treatment."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((ranks.get(length, 0), offset, sequence))
            ranks[length] = ranks.get(length, 0) + n
            offset += length
        sequence += n
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*found)) for length, found in runs.items()}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: pieces of ``capacity``, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def document_pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of all pieces of all documents, each with ``end`` after its ids."""

    def make():
        encode = Vocabulary(path).encoding(pattern).encode_to_numpy

        def step(columns):
            if columns is None:
                return
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(columns["doc_id"], columns["text"]):
                ids = np.append(encode(text or "", allowed_special="all"), end).astype("<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    out["doc_id"].append(doc)
                    out["piece"].append(i)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(ids[start : start + length].tobytes()))
            yield out

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, piece int, start long, length long, ids_crc32 long", make)


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row of ``docs``.

    A document's tokens are its ids and ``end``; a null text is empty, so it has one token. Documents longer than
    ``capacity`` are cut, no others. Rows with equal ids or texts are separate documents. Pieces of equal length are
    interchangeable: which of them shares a sequence with which is not stated, the lengths in each sequence are.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = materialize(document_pieces(docs, path, pattern, capacity, end).withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    found = spark.sparkContext.broadcast(pickle.dumps(plan(pack(counts, capacity))))
    buckets = max(1, total // BUCKET_ROWS)

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def make():
        runs = pickle.loads(found.value)

        def step(columns):
            if columns is None:
                return
            length, rank = (np.array(columns[c], dtype=np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                firsts, offsets, sequences = runs[int(x)]
                at = np.searchsorted(firsts, rank[own], side="right") - 1
                offset[own] = offsets[at]
                sequence[own] = sequences[at] + rank[own] - firsts[at]
            yield {**{c: columns[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": sequence, "offset": offset}

        return step

    return map_batches(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make)
