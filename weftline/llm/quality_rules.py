"""Quality rules: divergence of a document's distributions from language references.

A document has two histograms: its characters by class (``CLASSES``) and its words by common word. The common words are
those most frequent in each language, ``COMMON`` of each; all other words share one further class. The reference of a
language holds both histograms summed over all its documents that pass the base rules and are mostly plain (``plain``); it is made of the whole table.

A document is compared with every reference by the Jensen-Shannon distance (base 2, 0 to 1), and its distance is that to
the nearest: a document with a wrong or no language label is judged by what it is written in. It is rejected if the
character distance exceeds ``MOST_CHARS`` or the word distance ``MOST_WORDS``. Both have guards: shorter documents have
noisy histograms, so the distance is not used for fewer than ``LEAST_CHARS`` characters or ``LEAST_WORDS`` words.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.llm.common import map_batches, prepare

CLASSES = ("lower", "upper", "other letter", "mark", "digit", "space", "line end", "stop", "quote or hyphen", "symbol", "other")
COMMON = 100
CHAR_LIMITS = ((200, 0.3), (1200, 0.17))
WORD_LIMITS = ((60, 0.6), (400, 0.5))
#: Of characters, in texts that count for references.
MOST_SYMBOLS, MOST_UPPER = 0.01, 0.2
_SYMBOLS = "#*$%&|<>"
_KEPT = 200_000
#: Words in lower case and trimmed, kept by a worker process from task to task.
_NORMAL: dict[bytes, str] = {}
_TRIM = ".,;:!?\"'()[]{}#*$%&|<>"


def class_table() -> np.ndarray:
    """For each code point of the basic plane its class; others count as other letters or by the last entry."""
    number = {name: i for i, name in enumerate(CLASSES)}
    by_category = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "other letter", "Lo": "other letter", "Mn": "mark", "Mc": "mark", "Me": "mark", "Nd": "digit", "Nl": "digit", "No": "digit", "Zs": "space", "Pd": "quote or hyphen", "Pi": "quote or hyphen", "Pf": "quote or hyphen", "Sc": "symbol", "Sk": "symbol", "Sm": "symbol", "So": "symbol", "Pc": "symbol", "Po": "symbol", "Ps": "symbol", "Pe": "symbol"}
    table = np.full(0x10000, number["other"], dtype=np.uint8)
    for code in range(0x10000):
        name = by_category.get(unicodedata.category(chr(code)))
        if name:
            table[code] = number[name]
    for chars, name in ((".,;:!?", "stop"), ("\"'", "quote or hyphen"), ("\t", "space"), ("\n\r\v\f", "line end")):
        for c in chars:
            table[ord(c)] = number[name]
    return table


def repeated_words(ids: np.ndarray, kinds: int, window: int = 5) -> int:
    """Words that lie in a window of ``window`` words which occurs twice or more. ids: word numbers below kinds."""
    count = len(ids) - window + 1
    if count < 2:
        return 0
    codes, size = ids[:count].astype(np.uint64), kinds
    for i in range(1, window):
        if size * kinds >= 1 << 63:
            values, codes = np.unique(codes, return_inverse=True)
            codes, size = codes.astype(np.uint64), len(values)
        codes = codes * np.uint64(kinds) + ids[i : count + i].astype(np.uint64)
        size *= kinds
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    again = np.zeros(count, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:count] += again
    edge[window : window + count] -= again
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


class Reader:
    """The counts of one text. ``wanted``: the only words to be told apart, or None for all."""

    def __init__(self, wanted: set[str] | None = None):
        self.wanted = wanted
        self.normal = _NORMAL
        self.table = class_table()
        self.is_symbol = np.zeros(128, dtype=bool)
        self.is_symbol[[ord(c) for c in _SYMBOLS]] = True

    def __call__(self, text: str | None) -> dict:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()  # at space and tab to carriage return
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        plane = codes[codes < 0x10000]
        histogram = np.bincount(self.table[plane], minlength=len(CLASSES))
        histogram[-1] += len(codes) - len(plane)
        low = np.bincount(codes[codes < 128], minlength=128)
        spaces = int(low[0x20] + low[0x09:0x0E].sum())
        lines = [line for line in data.split(b"\n") if line.strip()]
        frequent: dict[str, int] = {}
        normal, wanted, known = self.normal, self.wanted, 0
        if len(normal) > _KEPT:
            normal.clear()
        for word, n in zip(numbers, np.bincount(ids, minlength=len(numbers)).tolist()):
            plain_word = normal.get(word)
            if plain_word is None:
                plain_word = normal[word] = word.decode("utf-8", "surrogatepass").lower().strip(_TRIM)
            if plain_word:
                known += n
                if wanted is None or plain_word in wanted:
                    frequent[plain_word] = frequent.get(plain_word, 0) + n
        n_words, repeats = len(words), repeated_words(ids, max(1, len(numbers)))
        return {
            "n_words": n_words,
            "word_chars": len(codes) - spaces,
            "n_symbols": int(low[self.is_symbol].sum()),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": repeats,
            "base_failed": n_words < 10 or 100 * repeats > 20 * n_words,
            "classes": histogram,
            "words": frequent,
            "known": known,
        }


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance, base 2, of two histograms; 1 if exactly one is empty, 0 if both are."""
    if not p.sum() or not q.sum():
        return float(bool(p.sum()) != bool(q.sum()))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, parts / 2)))


def plain(classes: np.ndarray) -> bool:
    """Whether a text may count for a reference: few symbols and capitals, so that junk does not move it."""
    total = classes.sum()
    return bool(classes[CLASSES.index("symbol")] <= MOST_SYMBOLS * total and classes[CLASSES.index("upper")] <= MOST_UPPER * total)


def beyond(value: float | None, size: int, limits: tuple) -> bool:
    """Whether a distance exceeds the limit for a text of this size."""
    return value is not None and value > min(limit for least, limit in limits if size >= least)


class References:
    """Of each language: the class histogram, and the histogram of its own common words and one class for others."""

    def __init__(self, classes: dict[str, np.ndarray], words: dict[str, list[tuple[str, int]]], totals: dict[str, int]):
        self.languages = sorted(classes)
        self.classes = classes
        self.index = {lang: {w: i for i, (w, _) in enumerate(words.get(lang, []))} for lang in self.languages}
        self.words = {}
        for lang in self.languages:
            counts = [n for _, n in words.get(lang, [])]
            self.words[lang] = np.array([*counts, totals.get(lang, 0) - sum(counts)], dtype=np.float64)

    def distances(self, found: dict) -> tuple[float | None, float | None]:
        """Character and word distance to the nearest reference; None for what the guards or no reference exclude."""
        chars = words = None
        n = found["known"]
        if self.languages and found["classes"].sum() >= CHAR_LIMITS[0][0]:
            chars = min(distance(found["classes"], self.classes[lang]) for lang in self.languages)
        if self.languages and n >= WORD_LIMITS[0][0]:
            best = 1.0
            for lang in self.languages:
                own, index = np.zeros(len(self.words[lang])), self.index[lang]
                for word, count in found["words"].items():
                    if word in index:
                        own[index[word]] = count
                own[-1] = n - own.sum()
                best = min(best, distance(own, self.words[lang]))
            words = best
        return chars, words


def references(docs: DataFrame) -> References:
    """The references of all languages in ``docs`` (text, lang), from all rows that pass the base rules."""

    def make():
        read, classes, words, total = Reader(), {}, Counter(), Counter()

        def flush():
            rows = [(lang, "word", w, n) for (lang, w), n in words.items()]
            rows += [(lang, "class", str(i), int(n)) for lang, h in classes.items() for i, n in enumerate(h) if n]
            rows += [(lang, "total", "", n) for lang, n in total.items()]
            for table in (classes, words, total):
                table.clear()
            if rows:
                yield {name: list(x) for name, x in zip(("lang", "kind", "item", "n"), zip(*rows))}

        def step(columns):
            if columns is not None:
                for lang, text in zip(columns["lang"], columns["text"]):
                    found = read(text)
                    if found["base_failed"] or not plain(found["classes"]):
                        continue
                    classes[lang] = classes.get(lang, 0) + found["classes"]
                    for w, n in found["words"].items():
                        words[lang, w] += n
                    total[lang] += found["known"]
                if len(words) > _KEPT:
                    yield from flush()
            else:
                yield from flush()

        return step

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    sums = map_batches(known, "lang string, kind string, item string, n long", make).groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= COMMON).select("lang", "kind", "item", "n").collect()  # at most 3 * COMMON rows of each language
    classes: dict[str, np.ndarray] = {}
    words: dict[str, list[tuple[str, int]]] = {}
    totals: dict[str, int] = {}
    for lang, kind, item, n in sorted(map(tuple, top), key=lambda r: (r[0], -r[3], r[2])):
        if kind == "class":
            classes.setdefault(lang, np.zeros(len(CLASSES)))[int(item)] = n
        elif kind == "word":
            words.setdefault(lang, []).append((item, n))
        else:
            totals[lang] = n
    return References(classes, words, totals)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame) -> DataFrame:
    """A row of counts and the verdict for every row of ``docs`` (doc_id, text, lang).

    A null text is none: all counts 0, base_failed, not kept. Rows are judged one by one, so repeated rows repeat. With
    no reference at all (no row has a language) only the base rules decide.
    """
    return _judged(docs, ["doc_id"])


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return _judged(docs, docs.columns, only=True).select(*docs.columns)


def _judged(docs: DataFrame, carried: list[str], only: bool = False) -> DataFrame:
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(references(docs)))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    # carried columns keep their own names in the output, our inputs get names that cannot clash
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)], F.col("text").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"_c{i} {kinds[c]}" for i, c in enumerate(carried)), "_kept boolean" if only else COLUMNS])

    def make():
        refs = pickle.loads(shared.value)
        read = Reader({w for index in refs.index.values() for w in index})

        def step(columns):
            if columns is None:
                return
            rows = []
            for text in columns["_text"]:
                found = read(text)
                chars, words = refs.distances(found)
                far = beyond(chars, found["classes"].sum(), CHAR_LIMITS) or beyond(words, found["known"], WORD_LIMITS)
                rows.append({**found, "kept": not found["base_failed"] and not far, "char_distance": chars, "word_distance": words})
            out = {f"_c{i}": columns[f"_c{i}"] for i in range(len(carried))}
            if only:
                at = [i for i, r in enumerate(rows) if r["kept"]]
                yield {c: [v[i] for i in at] for c, v in out.items()} | {"_kept": [True] * len(at)}
            else:
                yield out | {n: [r[n] for r in rows] for n in names}

        return step

    done = map_batches(inner, schema, make)
    return done.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)], *([] if only else names))
