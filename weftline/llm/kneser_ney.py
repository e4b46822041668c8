"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text.

Words. The model of ``word_model`` counts word bigrams of all trusted text and scores documents by sharded count joins.
This file has the model of characters below it, which gives words their spelling, and the verdicts.

Spelling. Characters are folded to 64 symbols (letters, one symbol for capitals, one for digits, punctuation, classes of
other letters), so a spelling n-gram of order 4 has 24 bits: its table has at most 2^24 rows whatever the input, and is
broadcast (64 MB). It is made of the words of all trusted text; each word begins and ends at a border. Orders below the
highest have continuation counts (the number of distinct symbols seen before), each order has its discounts D1, D2, D3+.

Scores. A document's perplexity is exp of its negative log probability for each character. It is rejected if the log
perplexity lies above the limit of its language by more than a margin that shrinks with its length (``SLACK`` /
sqrt(symbols): a short text's mean is noisy). The limit of a language is the quantile ``QUANTILE`` of its n trusted
documents, drawn to that of all trusted documents: (n own + PRIOR all) / (n + PRIOR). Without any trusted document
nothing is rejected.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import map_batches, prepare
from weftline.session import materialize

ORDER, BITS = 4, 6
QUANTILE, SLACK, PRIOR = 0.99, 4.0, 20
_SLICES = 64
_BLOCK = 4_000_000
_PUNCTUATION = {"\n": 30, ".": 31, ",": 32, ";": 33, ":": 33, "!": 34, "?": 35, '"': 36, "'": 36, "-": 37, "(": 38, ")": 38, "[": 38, "]": 38, "{": 38, "}": 38, "@": 39, "/": 40, "\\": 40, "#": 41, "*": 42, "$": 43, "%": 44, "&": 45, "|": 46, "<": 47, ">": 47}


def symbol_table() -> np.ndarray:
    """Code points of the basic plane to symbols 1 to 63; 0 is the border of a text."""
    table = np.full(0x10000, 63, dtype=np.uint32)
    for code in range(0x10000):
        c = chr(code)
        kind = unicodedata.category(c)
        if "a" <= c <= "z":
            table[code] = 1 + code - ord("a")
        elif kind in ("Lu", "Lt"):
            table[code] = 27
        elif kind == "Ll":
            table[code] = 49 + code % 12
        elif kind[0] == "L" or kind[0] == "M":
            table[code] = 61 + code % 2
        elif kind[0] == "N":
            table[code] = 28
        elif c.isspace():
            table[code] = 29
        elif kind[0] in "PS":
            table[code] = 48
    for c, symbol in _PUNCTUATION.items():
        table[ord(c)] = symbol
    return table


class Symbols:
    def __init__(self):
        self.table = symbol_table()
        self.table[ord("\n")] = 0  # no word has it

    def grams(self, words: list[str]) -> np.ndarray:
        """The n-grams of order 4 that end at each character and at the end of each word, word after word."""
        if not words:
            return np.zeros(0, dtype=np.uint32)
        gap = "\n" * (ORDER - 1)
        codes = np.frombuffer((gap + gap.join(words) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.table[np.minimum(codes, 0xFFFF)]
        count = len(codes) - ORDER + 1
        grams = symbols[:count].copy()
        for i in range(1, ORDER):
            grams <<= np.uint32(BITS)
            grams |= symbols[i : count + i]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        begin = np.cumsum(lengths + ORDER - 2) - (lengths + ORDER - 2)
        return grams[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


def count_grams(texts: DataFrame, wanted=lambda: None) -> np.ndarray:
    """Counts of all 2^24 n-grams of the words, and of the ends, of all rows of ``texts``, or of those that are wanted:
    ``wanted`` makes a function from a batch to a flag for each row.

    Each partition's counts go in slices of the range to the worker that adds that slice up; the sums, of bounded size,
    come to the driver.
    """
    width = (1 << BITS * ORDER) // _SLICES

    def make():
        symbols, test, held, size = Symbols(), wanted(), [], [0]

        def flush():
            if held:
                grams, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                size[0] = 0
                ends = np.searchsorted(grams, np.arange(_SLICES + 1) * width)
                rows = [(i, zlib.compress(np.array([grams[a:b], n[a:b]], dtype=np.int64).tobytes(), 1)) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]
                yield {"slice": [r[0] for r in rows], "counts": [r[1] for r in rows]}

        def step(columns):
            if columns is None:
                yield from flush()
                return
            flags = test(columns) if test else [True] * len(columns["text"])
            for text, flag in zip(columns["text"], flags):
                if flag and text and (split := text.split()):
                    held.append(symbols.grams([*split, ""]))
                    size[0] += len(held[-1])
                    if size[0] > _BLOCK:
                        yield from flush()

        return step

    def join():
        held: dict = {"slice": None, "sum": None}

        def finish():
            if held["sum"] is not None:
                yield {"slice": [held["slice"]], "counts": [zlib.compress(held["sum"].tobytes(), 1)]}

        def step(columns):
            if columns is None:
                yield from finish()
                return
            for k, x in zip(columns["slice"], columns["counts"]):
                if k != held["slice"]:
                    yield from finish()
                    held.update(slice=k, sum=np.zeros(width, dtype=np.int64))
                grams, n = np.frombuffer(zlib.decompress(x), dtype=np.int64).reshape(2, -1)
                held["sum"][grams - k * width] += n

        return step

    parts = map_batches(texts, "slice int, counts binary", make)
    whole = map_batches(parts.repartition(_SLICES, "slice").sortWithinPartitions("slice"), "slice int, counts binary", join)
    counts = np.zeros(1 << BITS * ORDER, dtype=np.int64)
    for row in whole.toLocalIterator():
        counts[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return counts


def discounts(of_count: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams with counts 1 to 4."""
    n = [of_count.get(i, 0) for i in range(1, 5)]
    if min(n[:3]) == 0:
        return [0.5, 0.75, 0.9]  # too little text for the estimate
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [min(max(d, 0.0), k) for d, k in zip(found, (1, 2, 3))]


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P of each of the 2^24 n-grams of order 4 (natural logarithm, float32)."""
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = (levels[order + 1] > 0).reshape(1 << BITS, -1).sum(axis=0)
    below = np.full(1 << BITS, 1 / (1 << BITS), dtype=np.float32)  # order 0: all symbols alike
    for order in range(1, ORDER + 1):
        # rows are contexts; a context without its first symbol is the row of the order below
        n = levels.pop(order).reshape(-1, 1 << BITS)
        lower = below.reshape(-1, 1 << BITS)
        parts = [slice(a, a + len(lower)) for a in range(0, len(n), len(lower))]
        of_count = sum(np.bincount(np.minimum(n[x], 5).ravel(), minlength=6) for x in parts)
        d = np.array([0.0, *discounts({i: int(k) for i, k in enumerate(of_count)})])
        below = np.empty(n.size, dtype=np.float32).reshape(n.shape)
        for x in parts:
            cut, total = d[np.minimum(n[x], 3)], n[x].sum(axis=1, keepdims=True)
            weight = np.where(total > 0, cut.sum(axis=1, keepdims=True) / np.maximum(total, 1), 1.0)
            # P(w | h) = (n - d) / total + weight(h) * P(w | shorter h)
            below[x] = (n[x] - cut) / np.maximum(total, 1) + weight * lower
        below = below.ravel()
    # with little text a discount, and so a probability, can be 0
    return np.log(np.maximum(below, np.float32(2.0 ** (-BITS * ORDER))))


def spelling(texts: DataFrame, wanted) -> np.ndarray:
    return log_probabilities(count_grams(texts, wanted))


class Scorer:
    def __init__(self, table: bytes):
        self.symbols, self.table = Symbols(), np.frombuffer(zlib.decompress(table), dtype=np.float32)

    def words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words the log probabilities of their characters and ends, and of the end of the text; of an
        empty list none."""
        flat = [w for words in texts if words for w in (*words, "")]
        low = np.zeros(0)
        if flat:
            lengths = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat)) + 1
            low = np.add.reduceat(self.table[self.symbols.grams(flat)].astype(np.float64), np.cumsum(lengths) - lengths)
        return np.split(low, np.cumsum([len(words) + bool(words) for words in texts])[:-1])


class Model:
    """The scores of all documents and the limits by language."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        from weftline.llm import word_model

        prepare(docs.sparkSession)
        rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"))
        scored = word_model.scores(rows, labels).select("doc_id", "lang", "_key", "trusted", "n_symbols", (-F.col("total") / F.col("n_symbols")).alias("log_perplexity"))
        scored = self.scored = materialize(scored)
        at = F.percentile_approx("log_perplexity", F.lit(QUANTILE), F.lit(10_000)).alias("limit")
        known = scored.where("trusted")
        self.other = known.agg(at).head()["limit"]
        found = known.where("lang is not null").groupBy("lang").agg(at, F.count("*").alias("n")).collect()
        self.limits = {r["lang"]: (r["n"] * r["limit"] + PRIOR * self.other) / (r["n"] + PRIOR) for r in found}

    def judged(self) -> DataFrame:
        """The scores with the columns most (limit of the log perplexity) and kept."""
        limit = F.lit(self.other).cast("double")
        for lang, value in sorted(self.limits.items()):
            limit = F.when(F.col("lang") == lang, F.lit(value)).otherwise(limit)
        most = limit + F.lit(SLACK) / F.sqrt("n_symbols")
        return self.scored.select("*", most.alias("most"), F.coalesce(F.col("log_perplexity") <= most, F.lit(True)).alias("kept"))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with _key, the same for rows with the same id, language and text only."""
    return docs.withColumn("_key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), F.coalesce("lang", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_symbols, perplexity, threshold and kept for every row of ``docs`` (doc_id, text, lang).

    ``labels``: doc_id, quality; trusted are the documents with quality 1. A null text is empty; a text without words has
    perplexity 1. Repeated rows are judged alike, each trusted one counts; repeated rows of ``labels`` are as good as one. The threshold is null, and all are kept, if nothing is trusted.
    """
    judged = Model(docs, labels).judged()
    return judged.select("doc_id", "n_symbols", F.exp("log_perplexity").alias("perplexity"), F.exp("most").alias("threshold"), "kept")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    gone = Model(docs, labels).judged().where("not kept").select(F.col("_key").alias("_gone_key")).distinct()
    left = keyed(docs).join(gone.hint("merge"), F.col("_key") == F.col("_gone_key"), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
