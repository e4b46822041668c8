"""N-gram Jaccard join by a token-group matrix.

Documents become sets of word shingles, named by 128-bit digests; equal sets are one set from there on. All sets put
their tokens (shingles) in one common order: rarest first, by the number of sets that have a token in the whole table.
Two sets with a Jaccard similarity of t or more then share a token within the first n - ceil(t n) + 1 of either, and
what follows the first token that they share bounds the overlap.

1. Frequencies. A block of documents sends each of its distinct tokens once, with its count in that block, to the shard
   of the token; a shard adds up the counts and answers each block with the tokens that stand in several sets. So a
   token that all documents share sends one entry for each block, whatever its number of sets. The answers meet the
   block's incidence list (which set has which token), which gives every set its prefix, of which tokens of one set
   alone are left out. Sets left without a token are linked with nothing.
2. Groups. In each token's list all sets are compared with the list's leader, the set with the fewest rarer tokens: of
   copies with edits of their own it is the one with the fewest, next to which most others are similar. Sets that are
   similar to a leader are linked; connected sets are a group, any other set is a group of its own. So copies, near or
   not, fall into one group with as many comparisons as they have tokens in lists, never with each other.
3. The token-group matrix. Tokens whose sets are all in one group are done with. For the others, each group has the
   union of the sets that share the token: a map of 1024 bits, one for each class of tokens that some member has, with
   the sizes and the positions. A query set has as many tokens outside of the union as it has classes outside of it, at
   least. That, its size and what follows the shared token bound its overlap with any member; the group is opened only
   if the bound reaches the overlap that similarity t needs.
4. Members of an opened group are compared with the query by sizes, positions and parity maps (``shingles.parity``: a
   lower bound of the number of elements that two sets do not share); then, for pairs that pass, by their whole sets.
5. Components of the links, by contracting labels; labels are joined back to all documents.

No step collects a posting list, a group or a component: lists meet in sort-merge joins, which AQE splits when skewed.
Sets of a list that are neither similar to its leader nor bounded away by the maps meet each other, as exactness needs:
for a group of sets a little below the threshold that is quadratic in comparisons of maps within the join, not in rows.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weftline.llm.bloom import Bloom, bloom_of
from weftline.llm.common import map_batches, prepare
from weftline.llm.shingles import Shingler, fold, name_of, parity, presence
from weftline.session import materialize

#: A block ends with this number of tokens or sets; bounds a worker's memory. Results do not depend on it.
BLOCK_TOKENS, BLOCK_SETS = 500_000, 60_000
#: Shards of tokens: one for about so many characters of text, between the bounds; a shard is held by one worker.
SHARD_CHARS, LEAST_SHARDS, MOST_SHARDS = 8_000_000, 256, 1 << 18
#: Characters of the texts whose blocks one task turns into prefixes, about, and the fewest tasks.
TASK_CHARS, LEAST_TASKS = 100_000_000, 6
#: Frequencies are kept by the first 48 bits of a token: tokens that fall together get one list, which only adds candidates.
KEY_BITS = 48
_WORDS = 16
_PARITY, _PRESENCE = [f"p{i}" for i in range(_WORDS)], [f"u{i}" for i in range(_WORDS)]


def needed(t_num: int, n):
    """The least overlap of a set of n with any set as similar as t_num percent."""
    return -(-t_num * n // 100)


def similar(a: np.ndarray, b: np.ndarray, t_num: int) -> bool:
    """Whether 100 |a & b| >= t_num |a | b|, for sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < t_num * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    shared = int(np.count_nonzero(b[at] == a))
    return 100 * shared >= t_num * (len(a) + len(b) - shared)


def _low(keys: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes of each key, byte by byte."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unlow(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def _blocks(docs: DataFrame, size: int, shards: int) -> DataFrame:
    """Rows of two kinds: for each block and shard the block's tokens there, and for each block its documents and sets.

    Tokens: shard, block, first (the number of the block's distinct tokens before these), keys (low bytes), x (counts).
    Documents: shard -1, and in x, y, keys what ``_Block`` reads.
    """
    bits = shards.bit_length() - 1
    width = -(-(KEY_BITS - bits) // 8)

    def make():
        shingle, held, context = Shingler(size), _Block(), TaskContext.get()
        turn = [(context.partitionId() if context else 0) << 24]

        def flush():
            block = turn[0]
            turn[0] += 1
            rows = []
            if held.sets:
                lengths = [len(s) for s in held.sets]
                keys = np.concatenate(held.sets) >> np.uint64(64 - KEY_BITS)
                packed = (keys << np.uint64(16)) | np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
                packed.sort()
                keys = packed >> np.uint64(16)
                fresh = np.r_[True, keys[1:] != keys[:-1]]
                starts = np.flatnonzero(fresh)
                counts = np.minimum(np.diff(np.r_[starts, len(keys)]), 65535).astype(np.uint16)
                keys = keys[starts]
                ends = np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << np.uint64(KEY_BITS - bits))
                for s in range(shards):
                    a, b = int(ends[s]), int(ends[s + 1])
                    if a < b:
                        rows.append((s, block, a, _low(keys[a:b], width), counts[a:b].tobytes(), b""))
                incidence = (packed & np.uint64(0xFFFF)).astype(np.uint16).tobytes() + np.packbits(fresh).tobytes()
            else:
                incidence = b""
            rows.append((-1, block, 0, held.documents(), held.names(), incidence))
            held.clear()
            yield {c: [r[i] for r in rows] for i, c in enumerate(("shard", "block", "first", "keys", "x", "y"))}

        def step(columns):
            if columns is None:
                if held.ids:
                    yield from flush()
                return
            for doc_id, mark, text in zip(columns["doc_id"], columns["mark"], columns["text"]):
                held.add(doc_id, mark, shingle(text))
                if held.tokens >= BLOCK_TOKENS or len(held.sets) >= BLOCK_SETS or len(held.ids) >= 4 * BLOCK_SETS:
                    yield from flush()

        return step

    return map_batches(docs.select("doc_id", "mark", "text"), "shard int, block long, first long, keys binary, x binary, y binary", make)


class _Block:
    """The documents of a block and their distinct sets."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids, self.marks, self.own, self.sets, self.known, self.tokens = [], [], [], [], {}, 0

    def add(self, doc_id: int | None, mark: int, tokens: np.ndarray) -> None:
        at = -1
        if len(tokens):
            name = name_of(tokens)
            if (at := self.known.get(name, -1)) < 0:
                at = self.known[name] = len(self.sets)
                self.sets.append(tokens)
                self.tokens += len(tokens)
        self.ids.append(doc_id)
        self.marks.append(mark)
        self.own.append(at)

    def documents(self) -> bytes:
        missing = np.array([i is None for i in self.ids], dtype=np.int64)
        return np.array([[i or 0 for i in self.ids], missing, self.marks, self.own], dtype=np.int64).tobytes()

    def names(self) -> bytes:
        return b"".join(self.known) + np.array([len(s) for s in self.sets], dtype=np.int64).tobytes()


def _frequencies(blocks: DataFrame, shards: int) -> DataFrame:
    """For each block and shard the block's tokens that stand in several sets: first, y (their places), keys, x (their
    frequencies, at most 65535). The rows of documents pass."""
    bits = shards.bit_length() - 1
    width = -(-(KEY_BITS - bits) // 8)

    def make():
        held: dict = {"shard": None, "rows": []}

        def answer():
            rows = held["rows"]
            if not rows:
                return
            keys = np.concatenate([_unlow(r[2], width) for r in rows])
            counts = np.concatenate([np.frombuffer(r[3], dtype=np.uint16) for r in rows]).astype(np.int64)
            ends = np.cumsum([len(r[3]) // 2 for r in rows])
            order = np.argsort(keys)
            at = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            total = np.add.reduceat(counts[order], at)
            sums = np.empty(len(keys), dtype=np.int64)
            sums[order] = np.repeat(total, np.diff(np.r_[at, len(keys)]))
            several = sums > 1
            sums = np.minimum(sums, 65535).astype(np.uint16)
            begin = 0
            for (block, first, data, _), end in zip(rows, ends):
                found = np.flatnonzero(several[begin:end])
                if len(found):
                    yield (held["shard"], block, first, _low(keys[begin + found], width), sums[begin + found].tobytes(), found.astype(np.uint32).tobytes())
                begin = end
            held["rows"] = []

        def step(columns):
            out = []
            if columns is None:
                out += answer()
            else:
                for row in zip(*(columns[c] for c in ("shard", "block", "first", "keys", "x", "y"))):
                    if row[0] != held["shard"]:
                        out += answer()
                        held["shard"] = row[0]
                    if row[0] < 0:
                        out.append(row)
                    else:
                        held["rows"].append(row[1:5])
            if out:
                yield {c: [r[i] for r in out] for i, c in enumerate(("shard", "block", "first", "keys", "x", "y"))}

        return step

    spark = blocks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 256)
    place = F.when(F.col("shard") < 0, F.col("block")).otherwise(F.col("shard"))
    dealt = blocks.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int")).sortWithinPartitions("shard")
    return map_batches(dealt, "shard int, block long, first long, keys binary, x binary, y binary", make)


def _prefixes(answers: DataFrame, t_num: int, shards: int, tasks: int = LEAST_TASKS) -> DataFrame:
    """A row for each document: doc_id, mark, sid (null: no words), n. And a row for each token of a set's prefix that
    stands in several sets: token, sid, n, pos."""
    bits = shards.bit_length() - 1
    width = -(-(KEY_BITS - bits) // 8)
    high = np.uint64(KEY_BITS - bits)

    def make():
        held: dict = {"block": None, "rows": []}

        def flush():
            rows, held["rows"] = held["rows"], []
            for shard, _, keys, x, y in rows:
                if shard >= 0:
                    continue
                ids, missing, marks, own = np.frombuffer(keys, dtype=np.int64).reshape(4, -1)
                count = len(x) // 24
                names = [x[16 * i : 16 * i + 16] for i in range(count)]
                n = np.frombuffer(x[16 * count :], dtype=np.int64)
                null = [None] * len(ids)
                yield {"doc_id": [None if m else i for i, m in zip(ids.tolist(), missing.tolist())], "mark": marks, "sid": [names[i] if i >= 0 else None for i in own], "n": [int(n[i]) if i >= 0 else 0 for i in own], "token": null, "pos": null}
                if count and len(rows) > 1:
                    yield from prefixes(rows, y, names, n)

        def prefixes(rows, y, names, n):
            total = int(n.sum())
            owner = np.frombuffer(y[: 2 * total], dtype=np.uint16)
            starts = np.flatnonzero(np.unpackbits(np.frombuffer(y[2 * total :], dtype=np.uint8), count=total))
            lengths = np.diff(np.r_[starts, total])
            some = [r for r in rows if r[0] >= 0]
            run = np.concatenate([np.frombuffer(r[4], dtype=np.uint32).astype(np.int64) + r[1] for r in some])
            token = np.concatenate([_unlow(r[2], width) | (np.uint64(r[0]) << high) for r in some])
            times = np.concatenate([np.frombuffer(r[3], dtype=np.uint16) for r in some])
            many = lengths[run]
            before = np.cumsum(many) - many
            at = np.repeat(starts[run] - before, many) + np.arange(many.sum())
            sets, token, times = owner[at].astype(np.int64), np.repeat(token, many), np.repeat(times, many)
            order = np.lexsort((token, times, sets))
            sets, token = sets[order], token[order]
            count = np.bincount(sets, minlength=len(n))
            pos = np.arange(len(sets)) - np.repeat(np.cumsum(count) - count, count) + (n - count)[sets]
            # tokens that fall together in one set have the place of the first of them, once
            fresh = np.r_[True, (token[1:] != token[:-1]) | (sets[1:] != sets[:-1])]
            keep = fresh & (pos <= (n - needed(t_num, n))[sets])
            sets, token, pos = sets[keep], token[keep].view(np.int64), pos[keep]
            for a in range(0, len(sets), 100_000):
                some_sets = sets[a : a + 100_000]
                null = [None] * len(some_sets)
                yield {"doc_id": null, "mark": null, "sid": [names[i] for i in some_sets], "n": n[some_sets], "token": token[a : a + 100_000], "pos": pos[a : a + 100_000]}

        def step(columns):
            if columns is None:
                yield from flush()
                return
            for block, *row in zip(*(columns[c] for c in ("block", "shard", "first", "keys", "x", "y"))):
                if block != held["block"]:
                    yield from flush()
                    held["block"] = block
                held["rows"].append(row)

        return step

    dealt = answers.repartitionById(tasks, F.pmod(F.hash("block"), F.lit(tasks))).sortWithinPartitions("block")
    return map_batches(dealt, "doc_id long, mark long, sid binary, n long, token long, pos long", make)


def _sets(docs: DataFrame, size: int, rows: DataFrame, names: DataFrame) -> DataFrame:
    """(sid, n, tokens, bits, parity and presence maps) of the named sets, from one text of each: a Bloom filter of the
    texts' hashes leaves few others, a semi join removes those."""
    marks = materialize(rows.join(_merge(names), "sid").groupBy("sid").agg(F.min("mark").alias("mark")))
    bloom = bloom_of(marks, "mark")

    def make():
        shingle, wanted = Shingler(size), Bloom(np.frombuffer(bloom.value, dtype=np.uint8))

        def step(columns):
            if columns is None:
                return
            keep = np.flatnonzero(wanted.has(np.array(columns["mark"], dtype=np.int64).view(np.uint64)))
            sets = [s for i in keep if len(s := shingle(columns["text"][i]))]
            if not sets:
                return
            maps = [parity(s) for s in sets]
            brief = np.concatenate([fold(np.frombuffer(m, dtype=np.uint8)[None, :], 8 * _WORDS) for m in maps]).view(np.int64)
            whole = np.stack([presence(s) for s in sets]).view(np.int64)
            yield {"sid": [name_of(s) for s in sets], "n": [len(s) for s in sets], "tokens": [s.tobytes() for s in sets], "bits": maps} | {c: brief[:, i] for i, c in enumerate(_PARITY)} | {c: whole[:, i] for i, c in enumerate(_PRESENCE)}

        return step

    longs = ", ".join(f"{c} long" for c in _PARITY + _PRESENCE)
    found = map_batches(docs.select("mark", "text"), f"sid binary, n long, tokens binary, bits binary, {longs}", make)
    return materialize(found.join(_merge(marks.select("sid")), "sid", "left_semi").dropDuplicates(["sid"]))


def _merge(df: DataFrame) -> DataFrame:
    """df, in a sort-merge join: what grows with the data is never broadcast on an estimate."""
    return df.hint("merge")


def _near(pairs: DataFrame, sets: DataFrame, t_num: int) -> DataFrame:
    """The pairs (a, b) whose whole parity maps allow the similarity."""
    maps = pairs.join(_merge(sets.select(F.col("sid").alias("a"), "n", F.col("bits").alias("x"))), "a").join(_merge(sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))), "b")

    def make():
        def step(columns):
            if columns is None:
                return
            n, m = (np.array(columns[c], dtype=np.int64) for c in "nm")
            sizes = np.array([min(len(x), len(y)) for x, y in zip(columns["x"], columns["y"])])
            apart = np.zeros(len(n), dtype=np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x, y = (np.concatenate([fold(np.frombuffer(columns[c][i], dtype=np.uint8)[None, :], size) for i in own]) for c in "xy")
                apart[own] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            overlap = -(-t_num * (n + m) // (100 + t_num))
            near = np.flatnonzero(apart <= n + m - 2 * overlap)
            yield {c: [columns[c][i] for i in near] for c in ("a", "b")}

        return step

    return map_batches(maps.select("a", "b", "n", "m", "x", "y"), "a binary, b binary", make)


def _links(pairs: DataFrame, sets: DataFrame, t_num: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets."""
    near = _near(pairs, sets, t_num)
    both = near.join(_merge(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))), "a").join(_merge(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))), "b")

    def make():
        def step(columns):
            if columns is None:
                return
            linked = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), t_num) for x, y in zip(columns["x"], columns["y"])]
            yield {c: [v for v, k in zip(columns[c], linked) if k] for c in ("a", "b")}

        return step

    return materialize(map_batches(both.select("a", "b", "x", "y"), "a binary, b binary", make))


def components(edges: DataFrame) -> DataFrame:
    """(sid, comp): comp is the least sid that can be reached. ``edges``: a, b.

    Each round contracts the graph: a node points to its least neighbour or itself, pointers are followed once more,
    and the edges are renamed by them. Rounds end when no edge joins two names; their number grows with the logarithm
    of the longest path. Edges are aggregated by partial minima first, so a hub's edges never meet in one list. A round
    writes two tables, of pointers and of edges.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while edges.take(1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
        hop = materialize(point.join(_merge(point.select(F.col("a").alias("to"), F.col("to").alias("far"))), "to").select("a", F.least("to", "far").alias("to")))
        if labels is None:
            labels = hop.select(F.col("a").alias("sid"), F.col("to").alias("comp"))
        else:
            labels = labels.join(_merge(hop.withColumnRenamed("a", "comp")), "comp", "left").select("sid", F.coalesce("to", "comp").alias("comp"))
        renamed = edges.join(_merge(hop.withColumnRenamed("to", "a2")), "a").join(_merge(hop.select(F.col("a").alias("b"), F.col("to").alias("b2"))), "b")
        edges = materialize(renamed.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("sid"), F.col("b").alias("comp"))
    return materialize(labels)


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs`` (doc_id long, text string; other columns unused).

    Two documents link when 100 |A & B| >= percent |A | B| for their sets of ``size``-word shingles; component_id is the
    least doc_id that links reach. Nulls and texts without words have no shingles and are linked with nothing. Rows are
    documents: rows that share a doc_id link only if their texts do, so they may have different components. A null
    doc_id keeps its row, its component_id is the least doc_id of its component or null.
    """
    spark = docs.sparkSession
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    chars = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    shards = LEAST_SHARDS
    while shards < MOST_SHARDS and shards * SHARD_CHARS < chars:
        shards *= 2
    tasks = max(LEAST_TASKS, chars // TASK_CHARS)
    both = materialize(_prefixes(_frequencies(_blocks(docs, size, shards), shards), percent, shards, tasks))
    rows = both.where("token is null").select("doc_id", "mark", "sid", "n")
    # equal sets of several blocks have equal rows
    lists = both.where("token is not null").groupBy("token", "sid").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    lists = materialize(lists)
    leader = lists.groupBy("token").agg(F.min(F.struct("pos", "sid", "n")).alias("l"), F.count("*").alias("k")).where("k > 1").select("token", F.col("l.sid").alias("b"), F.col("l.n").alias("m"), F.col("l.pos").alias("q"))
    lists = materialize(lists.join(_merge(leader), "token"))
    sets = _sets(docs, size, rows, lists.select("sid").distinct())

    stars = lists.where("sid <> b").where(_may("n", "pos", "m", "q", percent)).select(F.col("sid").alias("a"), "b").distinct()
    stars = _links(stars, sets, percent)
    comp = components(stars)

    # the token-group matrix: groups are connected sets; a single set is a group
    member = lists.select("token", "sid", "n", "pos").join(_merge(comp.withColumnRenamed("comp", "grp")), "sid", "left").select("token", "sid", "n", "pos", F.coalesce("grp", "sid").alias("grp"))
    several = member.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("token")
    member = member.join(_merge(several), "token").join(_merge(sets.select("sid", *_PARITY, *_PRESENCE)), "sid")
    member = materialize(member)
    union = [F.bit_or(c).alias(f"g{i}") for i, c in enumerate(_PRESENCE)]
    matrix = member.groupBy("token", "grp").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max(F.col("n") - F.col("pos")).alias("rest"), *union)
    query = member.select("token", F.col("sid").alias("a"), "n", "pos", F.col("grp").alias("own"), *_PARITY, *_PRESENCE)
    least = F.greatest("least_n", F.ceil(F.col("n") * percent / 100.0 - 1e-9))
    need = F.ceil(F.lit(percent) * (F.col("n") + least) / (100 + percent) - 1e-9)
    outside = sum((F.bit_count(F.col(c).bitwiseAND(F.bitwise_not(f"g{i}"))) for i, c in enumerate(_PRESENCE)), F.lit(0))
    may_open = (F.col("own") < F.col("grp")) & (F.least(F.col("n") - F.col("pos"), F.col("rest")) >= need) & (F.col("most_n") * 100 >= F.col("n") * percent) & (F.col("least_n") * percent <= F.col("n") * 100) & (F.col("n") - outside >= need)
    # a query and a group that share several tokens open each other for each of them, with the members that share it
    opened = query.join(_merge(matrix), "token").where(may_open).select("a", "grp", "token", "n", "pos", *_PARITY)
    other = member.select("token", "grp", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(_PARITY)])
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"q{i}"))) for i, c in enumerate(_PARITY)), F.lit(0))
    pairs = opened.join(_merge(other), ["token", "grp"]).where(_may("n", "pos", "m", "q", percent) & (apart <= _room("n", "m", percent)))
    cross = _links(pairs.select("a", "b").distinct(), sets, percent)
    comp = components(stars.union(cross))

    names = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least")).join(_merge(comp), "sid", "left").select("sid", "least", F.coalesce("comp", "sid").alias("comp"))
    names = materialize(names)
    lowest = names.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = names.join(_merge(lowest), "comp").select("sid", "component_id")
    with_words = rows.where("sid is not null").join(_merge(named), "sid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    without = rows.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.union(without)


def _need(n: str, m: str, percent: int):
    return F.ceil(F.lit(percent) * (F.col(n) + F.col(m)) / (100 + percent) - 1e-9)


def _room(n: str, m: str, percent: int):
    """The number of elements that two similar sets of these sizes have apart, at most."""
    return F.col(n) + F.col(m) - 2 * _need(n, m, percent)


def _may(n: str, pos: str, m: str, q: str, percent: int):
    """Whether sizes n, m and the positions pos, q of a shared token leave room for the overlap needed."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(F.col(n) - F.col(pos), F.col(m) - F.col(q)) >= _need(n, m, percent))
