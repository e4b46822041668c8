"""Language identification by a Bloom filter of character n-grams whose slots hold a bit for each language.

Training. Letter n-grams (3 and 4 characters, words padded by a space) are counted by language on the executors. An
n-gram belongs to a language if its share of that language's n-grams is at least ``MIN_SHARE`` and at least
``NEAR_BEST`` of its largest share in any language. At most 1 / MIN_SHARE n-grams can reach that share in a language,
which bounds the filter for any input. The filter is bit-sliced: slot s holds one bit for each language, and the bits of
a language over all slots are its Bloom filter. An n-gram sets its languages' bits in ``HASHES`` slots.

Prediction. The bits of an n-gram's slots, and-ed, are all languages that contain it, with false positives. A language's
count over a text is corrected by its false-positive rate f (the share of its bits set, to the power of HASHES): the
estimate is (hits / n - f) / (1 - f). The language with the largest estimate is predicted; ties go to the language with
more training n-grams, then to the name that sorts first.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import map_batches, mix64, prepare
from weftline.session import materialize

MIN_SHARE = 1e-5
NEAR_BEST = 0.3
HASHES = 3
SLOTS = 1 << 21
#: N-grams of a text handled at a time; those of a text do not depend on it.
CHUNK = 200_000
_KEPT = 2_000_000


def letters(text: str) -> str:
    """Lower-cased letters, with one space for each run of anything else."""
    if text.isascii():
        text = text.translate(_ASCII)
    else:
        text = "".join(c if c.isalpha() else " " for c in text.lower())
    return " ".join(text.split())


_ASCII = {i: chr(i).lower() if chr(i).isalpha() else " " for i in range(128)}


def ngrams(text: str | None):
    """Arrays of hashes of the text's n-grams, a chunk of their places at a time; none for a text without letters."""
    words = letters(text or "")
    if not words:
        return
    words = f" {words} "
    for start in range(0, len(words) - 2, CHUNK):
        codes = np.frombuffer(words[start : start + CHUNK + 3].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        three = (codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:])[:CHUNK]
        found = [mix64(three)]
        if len(codes) > 3:
            four = codes[3:][:CHUNK]
            found.append(mix64(mix64(three[: len(four)]) ^ four))
        yield np.concatenate(found)


def slots(grams: np.ndarray):
    """HASHES slots for each n-gram."""
    for i in range(HASHES):
        yield (grams >> np.uint64(i * 20) & np.uint64(SLOTS - 1)).astype(np.int64)


class Model:
    """The filter: languages in order, mask words for each slot, false-positive rates."""

    def __init__(self, languages: list[str], grams: np.ndarray, members: list[np.ndarray], weights: list[int]):
        self.languages = languages
        self.order = sorted(range(len(languages)), key=lambda i: (-weights[i], languages[i]))
        self.bits = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), dtype=np.uint64)
        self.rates = np.zeros(len(languages))
        for i, own in enumerate(members):
            word, bit = self.bits[i // 64], np.uint64(1 << (i % 64))
            for at in slots(grams[own]):
                word[at] |= bit
            self.rates[i] = (np.count_nonzero(word & bit) / SLOTS) ** HASHES
        # the fewest bytes that hold the mask
        for kind in (np.uint8, np.uint16, np.uint32):
            if len(languages) <= np.iinfo(kind).bits:
                self.bits = self.bits.astype(kind)
                break

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language has, by its bits."""
        hits = np.zeros(len(self.languages), dtype=np.int64)
        at = list(slots(grams))
        for k, word in enumerate(self.bits):
            masks = word[at[0]]
            for more in at[1:]:
                masks = masks & word[more]
            for i in range(64 * k, min(len(self.languages), 64 * k + 64)):
                hits[i] = np.count_nonzero(masks & masks.dtype.type(1 << (i % 64)))
        return hits

    def predict(self, text: str | None) -> tuple[str, float]:
        hits, n = np.zeros(len(self.languages), dtype=np.int64), 0
        for grams in ngrams(text):
            hits += self.counts(grams)
            n += len(grams)
        if not n or not self.languages:
            return "und", 0.0
        shares = np.clip((hits / n - self.rates) / (1 - self.rates), 0, 1)
        best = max(self.order, key=lambda i: shares[i])
        return self.languages[best], float(shares[best])


def train(docs: DataFrame) -> Model:
    """A model of the rows of ``docs`` (text, lang); rows with a null in either are left out."""

    def make():
        held: dict[str, list[np.ndarray]] = {}
        size = [0]

        def flush():
            for lang, arrays in held.items():
                grams, n = np.unique(np.concatenate(arrays), return_counts=True)
                yield {"lang": [lang] * len(grams), "gram": grams.view(np.int64), "n": n.astype(np.int64)}
            held.clear()
            size[0] = 0

        def step(columns):
            if columns is not None:
                for lang, text in zip(columns["lang"], columns["text"]):
                    for grams in ngrams(text):
                        held.setdefault(lang, []).append(grams)
                        size[0] += len(grams)
                        if size[0] > _KEPT:
                            yield from flush()
            else:
                yield from flush()

        return step

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    grams = map_batches(known, "lang string, gram long, n long", make).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams)
    totals = {r["lang"]: r["n"] for r in grams.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(0, dtype=np.uint64), [], [])
    sizes = grams.sparkSession.createDataFrame(sorted(totals.items()), "lang string, total long")
    shares = grams.join(F.broadcast(sizes), "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best")).where(F.col("best") >= MIN_SHARE)
    kept = shares.where(F.col("share") >= MIN_SHARE).join(best, "gram").where(F.col("share") >= NEAR_BEST * F.col("best"))
    rows = kept.select("gram", "lang").toArrow()  # at most 1 / MIN_SHARE rows for each language
    codes = rows.column("gram").to_numpy().view(np.uint64)
    names = np.array(rows.column("lang").to_pylist(), dtype=object)
    return Model(languages, codes, [names == lang for lang in languages], [totals[lang] for lang in languages])


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept out of training: crc32 of its id as text has the remainder 2 by 4."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs`` (doc_id, text, lang).

    Learns from the rows that are not held out and have a language (a null id is not held out). A text that is null or
    has no letters gets ``und`` and 0; so do all if nothing can be learned. Repeated rows get equal results.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    apart = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = train(docs.where(~apart))
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1))

    def make():
        own = pickle.loads(zlib.decompress(shared.value))

        def step(columns):
            if columns is None:
                return
            found = [own.predict(text) for text in columns["text"]]
            yield {"doc_id": columns["doc_id"], "held_out": [held_out(d) for d in columns["doc_id"]], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return step

    return map_batches(docs.select("doc_id", "text"), "doc_id long, held_out boolean, lang_pred string, score double", make)
