"""Interpolated modified Kneser-Ney model of word bigrams over a spelling model, scored by sharded count joins.

Words are what lies between white space, by 64-bit hashes of their bytes, not folded; a border stands before the first
and after the last. Below the bigrams stands the spelling of a word (the bounded model of characters in ``kneser_ney``),
so every word has a probability. Counts of bigrams are of all trusted text and grow with it.

Two halves. Trusted documents are counted in one of two models, by their id; a document is scored by the other half's
model. So no document is scored by its own words, and limits from trusted documents hold for all.

Shards. All bigrams of a context lie in one shard. A block of documents sends each of its distinct bigrams there once,
with the documents that have it and how often, sorted and as differences, so that a bigram costs 2 or 3 bytes; blocks of
trusted documents add the spelling's probability of the word. A shard adds up the trusted blocks, which gives c(v, w),
c(v), the discounts D1 to D3+ of the shard and the weight of the spelling after each context. With those,

    log P(w | v) = log P0(w) + log weight(v) + log(1 + (c(v, w) - D) / (c(v) weight(v) P0(w)))

where the last part is 0 for bigrams that were not counted and the middle one for contexts that were not. So the log
probability of a text is the sum of the spelling's, known in its block, and of one value for each of its bigrams, from
their shards. A worker adds up the values by document over the shards that it meets, and the sums go back to the block.

Keys of bigrams have 48 bits, 27 of the context and 21 of the word: bigrams that fall together are counted together.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_digest

from weftline.llm import kneser_ney
from weftline.llm.bloom import Bloom, bloom_of
from weftline.llm.common import map_batches
from weftline.session import materialize

#: The half whose model scores a document; documents without an id are scored by the first.
HALF = "cast(pmod(xxhash64(coalesce(doc_id, 0L)), 2) as int)"
CONTEXT_BITS, WORD_BITS = 27, 21
#: A block ends with this number of words or documents; a shard holds the bigrams of about so many characters of text.
BLOCK_WORDS, BLOCK_DOCS, SHARD_CHARS, MOST_SHARDS = 1_500_000, 60_000, 8_000_000, 1 << 16
#: Sums that a worker keeps until it sends them (4 bytes each).
KEPT_SUMS = 8_000_000
#: Characters of the texts whose sums one task adds up, about, and the fewest tasks.
TASK_CHARS, LEAST_TASKS = 100_000_000, 6
#: Ids that pass the Bloom filter without the label: more than that are found by a join in place of a broadcast set.
FEW_IDS = 100_000
_BORDER = np.uint64(0x9E3779B97F4A7C15)
#: Steps of the spelling's log probabilities, and of a document's sums, as they are sent.
_STEPS, _SUM_STEPS = 64, 256
#: Characters that a worker scores at a time.
_CHUNK = 1_000_000


def word_ids(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(xxh3_64_digest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=">u8").astype(np.uint64)


def keys_of(ids: np.ndarray) -> np.ndarray:
    """Keys of the bigrams of a text with these words; none without words."""
    if not len(ids):
        return ids
    border = np.array([_BORDER])
    before, word = np.concatenate([border, ids]), np.concatenate([ids, border])
    return (before >> np.uint64(64 - CONTEXT_BITS)) << np.uint64(WORD_BITS) | (word & np.uint64((1 << WORD_BITS) - 1))


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def flagged(docs: DataFrame, labels: DataFrame):
    """``docs`` (doc_id long and others) with a column mark, and what makes a function, in a worker, from columns doc_id
    and mark to whether a label calls each id good.

    A Bloom filter of the trusted ids goes to the executors; the few ids that pass it without being trusted go there as a
    set, or, if they are many, a join finds the trusted rows. Both give the same.
    """
    trusted = materialize(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    bloom = bloom_of(trusted.select(F.xxhash64("doc_id").alias("mark")), "mark")

    def passes(but: frozenset):
        def make():
            wanted = Bloom(np.frombuffer(bloom.value, dtype=np.uint8))

            def test(columns):
                found = wanted.has(np.array(columns["mark"], dtype=np.int64).view(np.uint64))
                return [bool(f) and d is not None and d not in but for f, d in zip(found, columns["doc_id"])]

            return test

        return make

    def near():
        test = passes(frozenset())()

        def step(columns):
            if columns is not None:
                yield {"doc_id": [d for d, t in zip(columns["doc_id"], test(columns)) if t]}

        return step

    marked = docs.withColumn("mark", F.xxhash64("doc_id"))
    false = materialize(map_batches(marked.select("doc_id", "mark"), "doc_id long", near).distinct().join(trusted.hint("merge"), "doc_id", "left_anti"))
    some = [r["doc_id"] for r in false.limit(FEW_IDS + 1).collect()]
    if len(some) <= FEW_IDS:
        return marked, passes(frozenset(some))
    known = trusted.withColumn("mark", F.lit(1).cast("long")).hint("merge")
    return docs.join(known, "doc_id", "left").select(*docs.columns, F.coalesce("mark", F.lit(0).cast("long")).alias("mark")), lambda: lambda columns: [m == 1 for m in columns["mark"]]


class _Block:
    """Documents of one kind: the trusted ones of a half (0, 1), or all others (2)."""

    def __init__(self, kind: int):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.keys, self.low, self.docs, self.halves, self.words = [], [], [], [], 0

    def add(self, doc: tuple, half: int, keys: np.ndarray, low: np.ndarray) -> None:
        self.docs.append(doc)
        self.halves.append(half)
        self.keys.append(keys)
        self.words += len(keys)
        if self.kind < 2:
            self.low.append(np.minimum(np.rint(low * -_STEPS), 65535).astype(np.uint16))

    def rows(self, block: int, shards: int):
        sizes = [len(k) for k in self.keys]
        yield -1, 0, block, len(sizes), zlib.compress(pickle.dumps((self.kind < 2, self.docs)), 1)
        if not sum(sizes):
            return
        packed = np.concatenate(self.keys) << np.uint64(16) | np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
        self.keys = []
        if self.kind < 2:
            order = np.argsort(packed)
            packed, low = packed[order], np.concatenate(self.low)[order]
        else:
            packed.sort()
        at = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
        times = np.diff(np.r_[at, len(packed)]).astype(np.uint32)
        packed = packed[at]
        keys, docs = packed >> np.uint64(16), (packed & np.uint64(0xFFFF)).astype(np.uint16)
        first = np.r_[True, keys[1:] != keys[:-1]]
        halves = np.packbits(np.array(self.halves, dtype=np.uint8)).tobytes()
        ends = np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << np.uint64(CONTEXT_BITS + WORD_BITS - (shards.bit_length() - 1)))
        for s in range(shards):
            a, b = int(ends[s]), int(ends[s + 1])
            if a < b:
                own = keys[a:b][first[a:b]]
                sent = [_pack(np.diff(own, prepend=np.uint64(0))), zlib.compress(np.packbits(first[a:b]).tobytes(), 1), _pack(docs[a:b]), _pack(times[a:b])]
                sent.append(halves if self.kind == 2 else _pack(low[at[a:b]][first[a:b]]))
                yield s, self.kind, block, len(sizes), pickle.dumps(sent)


_ROW = ("shard", "kind", "block", "n", "x")
_SCHEMA = "shard int, kind int, block long, n int, x binary"


class Counts:
    """The trusted bigrams of a shard for one of the models, and what follows from them."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.keys = self.contexts = np.zeros(0, dtype=np.uint64)
        self.values = self.weights = np.zeros(0)

    def add(self, keys: np.ndarray, n: np.ndarray, low: np.ndarray) -> None:
        self.parts.append((keys, n, low))

    def finish(self) -> None:
        if not self.parts:
            return
        keys, n, low = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        # of words that fall together the likelier spelling counts, whatever the order of the blocks
        n, low = np.add.reduceat(n[order], at).astype(np.float64), np.maximum.reduceat(low[order], at)
        self.keys = keys[order][at]
        d = np.array(kneser_ney.discounts({i: int(k) for i, k in enumerate(np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6))}))
        cut = d[np.minimum(n, 3).astype(np.int64) - 1]
        context = self.keys >> np.uint64(WORD_BITS)
        starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        self.contexts = context[starts]
        total, freed = np.add.reduceat(n, starts), np.maximum(np.add.reduceat(cut, starts), 1e-9)
        self.weights = np.log(freed / total)
        sizes = np.diff(np.r_[starts, len(n)])
        with np.errstate(divide="ignore"):
            self.values = np.repeat(self.weights, sizes) + np.logaddexp(0, np.log(np.maximum(n - cut, 0)) - np.log(np.repeat(freed, sizes)) - low)

    @staticmethod
    def _look(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        hit = table[at] == keys
        return np.where(hit, values[at], 0.0), hit

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log P(w | v) - log P0(w) of each bigram."""
        value, hit = self._look(self.keys, self.values, keys)
        weight, _ = self._look(self.contexts, self.weights, keys >> np.uint64(WORD_BITS))
        return np.where(hit, value, weight)


class _Shards:
    """One shard after another: counts of both models from trusted blocks first, then sums for documents."""

    def __init__(self):
        self.sums: dict[int, np.ndarray] = {}
        self.kept = 0
        self.begin(None)

    def begin(self, shard) -> None:
        # models by the half that they score: the first is made of the trusted documents of half 1, the second of half 0
        self.shard, self.kind, self.models, self.held = shard, 0, (Counts(), Counts()), []

    def advance(self, kind: int) -> None:
        if self.kind == 0 and kind > 0:
            self.models[1].finish()
        if self.kind < 2 and kind > 1:
            self.models[0].finish()
            for row in self.held:
                self.score(0, *row)
            self.held = []
        self.kind = kind

    def score(self, kind: int, block: int, n: int, sent: list) -> None:
        keys = np.cumsum(_unpack(sent[0], np.uint64), dtype=np.uint64)
        docs, times = _unpack(sent[2], np.uint16), _unpack(sent[3], np.uint32)
        place = np.cumsum(np.unpackbits(np.frombuffer(zlib.decompress(sent[1]), dtype=np.uint8), count=len(docs))) - 1
        if kind < 2:
            value = self.models[kind].score(keys)[place]
        else:
            half = np.unpackbits(np.frombuffer(sent[4], dtype=np.uint8), count=n)[docs]
            value = np.where(half, self.models[1].score(keys)[place], self.models[0].score(keys)[place])
        if block not in self.sums:
            self.sums[block] = np.zeros(n)
            self.kept += n
        self.sums[block] += np.bincount(docs, value * times, n)

    def count(self, half: int, sent: list) -> None:
        keys = np.cumsum(_unpack(sent[0], np.uint64), dtype=np.uint64)
        times = _unpack(sent[3], np.uint32).astype(np.int64)
        first = np.unpackbits(np.frombuffer(zlib.decompress(sent[1]), dtype=np.uint8), count=len(times))
        self.models[1 - half].add(keys, np.add.reduceat(times, np.flatnonzero(first)), _unpack(sent[4], np.uint16) / -_STEPS)

    def take(self, shard, kind, block, n, x) -> None:
        if shard != self.shard:
            self.advance(2)
            self.begin(shard)
        self.advance(kind)
        sent = pickle.loads(x)
        if kind < 2:
            self.count(kind, sent)
        if kind == 0:
            self.held.append((block, n, sent))
        else:
            self.score(kind, block, n, sent)

    def flush(self):
        rows = [(-2, 0, block, len(v), _pack(np.rint(v * _SUM_STEPS).astype(np.int64))) for block, v in self.sums.items()]
        self.sums, self.kept = {}, 0
        return rows


def _columns(rows: list[tuple]) -> dict:
    return {c: [r[i] for r in rows] for i, c in enumerate(_ROW)}


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, _key, trusted, n_symbols, total for every row of ``docs`` (doc_id long, lang, text, _key): total is
    the log probability of the text."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    rows, trusting = flagged(docs.select("doc_id", "lang", "text", "_key", F.expr(HALF).alias("half")), labels)
    table = kneser_ney.spelling(rows.select("text", "doc_id", "mark"), trusting)
    shared = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
    chars = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    shards = 1
    while shards < MOST_SHARDS and shards * SHARD_CHARS < chars:
        shards *= 2

    def deal():
        scorer, context = kneser_ney.Scorer(shared.value), TaskContext.get()
        test, blocks = trusting(), [_Block(kind) for kind in range(3)]
        turn = [(context.partitionId() if context else 0) << 24]

        def flush(block):
            turn[0] += 1
            yield _columns(list(block.rows(turn[0], shards)))
            block.clear()

        def some(columns, trusted, at):
            split = [(columns["text"][i] or "").split() for i in at]
            for i, words, low in zip(at, split, scorer.words(split)):
                half, text = columns["half"][i], columns["text"][i] or ""
                block = blocks[half if trusted[i] else 2]
                block.add((columns["doc_id"][i], columns["lang"][i], columns["_key"][i], len(text) + 1, float(low.sum(dtype=np.float64))), half, keys_of(word_ids(words)), low)
                if block.words >= BLOCK_WORDS or len(block.docs) >= BLOCK_DOCS:
                    yield from flush(block)

        def step(columns):
            if columns is None:
                for block in blocks:
                    if block.docs:
                        yield from flush(block)
                return
            trusted, at, size = test(columns), [], 0
            for i, text in enumerate(columns["text"]):
                at.append(i)
                size += len(text or "")
                if size > _CHUNK:
                    yield from some(columns, trusted, at)
                    at, size = [], 0
            yield from some(columns, trusted, at)

        return step

    def add():
        state = _Shards()

        def step(columns):
            out = []
            if columns is None:
                state.advance(2)
                out = state.flush()
            else:
                for row in zip(*(columns[c] for c in _ROW)):
                    if row[0] < 0:
                        out.append(row)
                        continue
                    state.take(*row)
                    if state.kept > KEPT_SUMS:
                        out += state.flush()
            if out:
                yield _columns(out)

        return step

    def join():
        held: dict = {"block": None, "head": None, "sums": None}

        def finish():
            if held["head"] is not None:
                trusted, docs = held["head"]
                ids, lang, key, n, base = (list(x) for x in zip(*docs))
                total = np.array(base) + (0 if held["sums"] is None else held["sums"])
                yield {"doc_id": ids, "lang": lang, "_key": key, "trusted": [trusted] * len(ids), "n_symbols": n, "total": total}
            held.update(head=None, sums=None)

        def step(columns):
            if columns is None:
                yield from finish()
                return
            for shard, block, x in zip(columns["shard"], columns["block"], columns["x"]):
                if block != held["block"]:
                    yield from finish()
                    held["block"] = block
                if shard == -1:
                    held["head"] = pickle.loads(zlib.decompress(x))
                else:
                    sums = _unpack(x, np.int64) / _SUM_STEPS
                    held["sums"] = sums if held["sums"] is None else held["sums"] + sums

        return step

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 256)
    sent = map_batches(rows, _SCHEMA, deal)
    place = F.when(F.col("shard") < 0, F.col("block")).otherwise(F.col("shard"))
    dealt = sent.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int")).sortWithinPartitions("shard", "kind")
    back = map_batches(dealt, _SCHEMA, add).select("shard", "block", "x")
    tasks = max(LEAST_TASKS, chars // TASK_CHARS)
    back = back.repartitionById(tasks, F.pmod(F.hash("block"), F.lit(tasks))).sortWithinPartitions("block")
    return map_batches(back, "doc_id long, lang string, _key long, trusted boolean, n_symbols long, total double", join)
