"""Small tables and brute-force versions that the tests of this folder share."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import kneser_ney, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def make_rows() -> list[tuple]:
    """Ordinary texts, copies, near copies, and what must not crash: nulls, empty, very long, repeated rows, odd characters."""
    rows = [(i, prose(i, 60 + 7 * i), "en" if i % 2 else "de", "s") for i in range(20)]
    rows += [(100 + i, prose(3, 81), "en", "s") for i in range(4)]  # exact copies of document 3
    words = prose(5, 200).split()
    for i in range(6):
        w = list(words)
        for j in range(i):
            w[17 * j + 3] = f"edit{i}{j}"
        rows.append((200 + i, " ".join(w), "en", "s"))
    rows += [(300, None, "en", "s"), (301, "", None, None), (302, " \n\t ", "en", "s"), (303, "word " * 30_000, "en", "s"), (304, "x", "en", "s")]
    rows += [(305, "é漢字😀 <|endoftext|> don't  stop\n\n\nA.B.C 3.14   ½²\r\n", "fr", "s")]
    rows += [(306, "same row twice, with an id of its own", "en", "s")] * 2 + [(307, "one id", "en", "s"), (307, "one id, two texts", "de", "s")]
    rows += [(None, "a document without an id but with a few words in it", "en", "s")]
    return [(*r, len(r[1]) if r[1] else 0) for r in rows]


UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k, t):
    """(doc_id, n, least doc_id of the component) of every row, over all pairs."""
    sets = [(d, shingles(x, k)) for d, x in rows]
    name = list(range(len(sets)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= t * len(a | b):
                name[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        known = [x for x in (d, least.get(find(i))) if x is not None]
        least[find(i)] = min(known, default=None)
    return Counter((d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(sets))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def brute_quality(texts):
    """Character distance, word distance and verdict of the quality rules for each (doc_id, text, lang)."""
    kinds = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "other letter", "Lo": "other letter", "Nd": "digit", "Nl": "digit", "No": "digit", "Zs": "space", "Pd": "quote or hyphen", "Pi": "quote or hyphen", "Pf": "quote or hyphen"}

    def kind(c):
        if ord(c) > 0xFFFF:
            return "other"
        k = unicodedata.category(c)
        return "stop" if c in ".,;:!?" else "quote or hyphen" if c in "\"'" else "space" if c == "\t" else "line end" if c in "\n\r\v\f" else kinds.get(k) or ("mark" if k[0] == "M" else "symbol" if k[0] in "SP" else "other")

    def words(text):
        return Counter(x for w in WORD.findall(text or "") if (x := w.lower().strip(".,;:!?\"'()[]{}#*$%&|<>")))

    def js(p, q):
        if not sum(p.values()) or not sum(q.values()):
            return float(bool(sum(p.values())) != bool(sum(q.values())))
        p, q = ({k: n / sum(x.values()) for k, n in x.items()} for x in (p, q))
        part = lambda a, b: sum(x * np.log2(2 * x / (x + b.get(k, 0))) for k, x in a.items() if x)
        return np.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))

    classes, common = {}, {}
    for _, text, lang in texts:
        h = Counter(map(kind, text or ""))
        if lang and text is not None and not base(text)[5] and h["symbol"] <= 0.01 * sum(h.values()) and h["upper"] <= 0.2 * sum(h.values()):
            classes.setdefault(lang, Counter()).update(h)
            common.setdefault(lang, Counter()).update(words(text))
    references = {}
    for lang, c in common.items():
        top = dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON])
        references[lang] = {**top, None: sum(c.values()) - sum(top.values())}
    out = []
    for _, text, _ in texts:
        h, w = Counter(map(kind, text or "")), words(text)
        chars = min((js(h, c) for c in classes.values()), default=None) if sum(h.values()) >= 200 else None
        own = [({k: n for k, n in w.items() if k in ref} | {None: sum(n for k, n in w.items() if k not in ref)}, ref) for ref in references.values()]
        told = min((js(x, ref) for x, ref in own), default=None) if sum(w.values()) >= 60 else None
        limit = lambda size, steps: min(x for least, x in steps if size >= least)
        far = (chars is not None and chars > limit(sum(h.values()), ((200, 0.3), (1200, 0.17)))) or (told is not None and told > limit(sum(w.values()), ((60, 0.6), (400, 0.5))))
        out.append((chars, told, not base(text)[5] and not far))
    return out


def brute_kneser_ney(texts):
    """log P of n-grams by the textbook recursion over dictionaries."""
    symbols = kneser_ney.Symbols()
    counts = {4: Counter(int(g) for t in texts if t and t.split() for g in symbols.grams([*t.split(), ""]))}
    for k in (3, 2, 1):
        counts[k] = Counter(g & (1 << 6 * k) - 1 for g in counts[k + 1])
    d = {k: kneser_ney.discounts(Counter(c.values())) for k, c in counts.items()}
    cut = lambda k, n: 0 if n == 0 else d[k][min(n, 3) - 1]

    def p(g, k):
        if k == 0:
            return 1 / 64
        g &= (1 << 6 * k) - 1
        same = [counts[k][g >> 6 << 6 | s] for s in range(64)]
        lower = p(g, k - 1)
        if not sum(same):
            return lower
        n = counts[k][g]
        return (n - cut(k, n)) / sum(same) + sum(cut(k, x) for x in same) / sum(same) * lower

    return lambda g: np.log(p(g, 4))


def brute_words(spark, texts, trusted):
    """log P of each text by the textbook recursion over words and their spelling, under the other half's model."""
    from weftline.llm import word_model

    halves = {r["doc_id"]: r["half"] for r in spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", F.expr(word_model.HALF).alias("half")).collect()}
    symbols, spell = kneser_ney.Symbols(), brute_kneser_ney([t for d, t in texts if d in trusted])
    pairs = lambda t: list(zip([None, *t.split()], [*t.split(), None])) if t.split() else []
    found = []
    for d, text in texts:
        counts = Counter(g for e, t in texts if e in trusted and halves[e] != halves[d] for g in pairs(t or ""))
        cuts = kneser_ney.discounts(Counter(counts.values()))
        total = 0.0
        for v, w in pairs(text or ""):
            p = np.exp(sum(max(spell(int(g)), -24 * np.log(2)) for g in symbols.grams([w or ""])))
            same = {x: n for x, n in counts.items() if x[0] == v}
            if same:
                cut = lambda n: cuts[min(n, 3) - 1] if n else 0
                n = counts[v, w]
                p = (n - cut(n)) / sum(same.values()) + sum(map(cut, same.values())) / sum(same.values()) * p
            total += np.log(p)
        found.append(total)
    return found


def brute_perplexity(spark, texts, trusted):
    """Size, perplexity, limit and verdict of the quality classifier for each (doc_id, text, lang)."""
    total = brute_words(spark, [(d, t) for d, t, _ in texts], trusted)
    size = [len(t or "") + 1 for _, t, _ in texts]
    score = [-x / n for x, n in zip(total, size)]
    quantile = lambda x: sorted(x)[int(np.ceil(0.99 * len(x))) - 1]
    good = [(x, lang) for (d, _, lang), x in zip(texts, score) if d in trusted]
    if not good:
        return [(n, np.exp(x), None, True) for n, x in zip(size, score)]
    every = quantile([x for x, _ in good])
    limits = {k: (len(own) * quantile(own) + 20 * every) / (len(own) + 20) for k in {lang for _, lang in good if lang} if (own := [x for x, lang in good if lang == k])}
    most = [limits.get(lang, every) + 4 / np.sqrt(n) for (_, _, lang), n in zip(texts, size)]
    return [(n, np.exp(x), np.exp(m), x <= m) for n, x, m in zip(size, score, most)]
