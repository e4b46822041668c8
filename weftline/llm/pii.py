"""PII: detected entities get keyed, type-consistent surrogates.

Detection finds e-mail addresses, secrets, IBANs, card and account numbers, social security numbers, phone numbers, IPv4
and MAC addresses and person names. Names are found by titles, by known given names, by what is said around them (``my
name is``, ``met``, an address behind them), and, once some mention shows that a word is a name in a document, at every
other place of that word in it, in capitals too.

A mention has a kind and a canonical value, so that spellings of one entity corefer: letter case and separators do not
count, nor does a phone's country code; given names and surnames are entities of their own, so "Dr. Smith", "Mary Smith"
and a later "Smith" share a surname. Gender is a property of a given name and no part of its identity: it comes from the
name, if known, else from the titles that stand before it anywhere in the table, if they agree.

A surrogate is drawn from HMAC-SHA256 under a secret key, the kind, the canonical value and a nonce, in the format of the
value: digits for digits, letters of the same case and script for letters, octets of the same width, the same Luhn or
IBAN check status, given names of the same gender and script. It is put into the mention with the mention's own case
and separators.

Collision checks run over the distinct entities of the whole table: no two entities of a kind may share a surrogate and
no surrogate may be a value that really occurs. Whoever fails is drawn again with the next nonce; from ``LONGER`` on
surrogates grow with the nonce, so a format with few values never runs out. So surrogates keep entities apart and the
same entity gets the same surrogate in all documents. Only entities with a nonce above 0, or with a gender that the name
alone does not show, need to be looked up when texts are rewritten; all others are computed on the spot.
"""

from __future__ import annotations

import hashlib
import hmac
import pickle
import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from weftline.llm.common import map_batches, prepare
from weftline.session import materialize

#: From this nonce on surrogates have more characters than their values.
LONGER = 32
#: More redrawn entities than that are joined to their documents rather than broadcast.
BROADCAST_ROWS = 100_000
_KEPT = 100_000

# Titles and given names that show a person and a gender.
MALE_TITLES = "Mr Mister Herr Monsieur Señor господин".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Señorita госпожа".split()
OTHER_TITLES = "Dr Prof Professor Doctor доктор профессор".split()
MALE_NAMES = "James John Robert Michael William David Richard Thomas Charles Peter Hans Klaus Jürgen Wolfgang Pierre Jacques François Carlos José Juan Иван Сергей Дмитрий Андрей".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Angela Ursula Sabine Heike Monika Marie Françoise Isabelle María Carmen Ana Анна Ольга Елена Наталья".split()

_NAME = r"[^\W\d_a-z][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_either = lambda words: "|".join(map(re.escape, [*words, *(w.upper() for w in words)]))
_TITLES = _either([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES])
_NAMES = _either([*MALE_NAMES, *FEMALE_NAMES])
EMAIL = re.compile(r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,24}")
SECRET = re.compile(r"(?:token|secret|passwd|password|api[ _-]?key|access[ _-]?key)[\"']?\s*[=:]\s*[\"']?([^\s\"',;]{8,})", re.IGNORECASE)
BARE_SECRET = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
NUMBER = re.compile(r"(?<![\d+.(])\d(?:[ -]?\d){12,18}(?!\d)")
SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
PHONE = re.compile(r"(?<![\d.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")
IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
MAC = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])")
TITLED = re.compile(rf"\b({_TITLES})\b\.?[ ]({_NAME}(?: {_NAME}){{0,2}})")
NAMED = re.compile(rf"\b({_NAMES}) ({_NAME})")
_FULL = rf"{_NAME}(?: {_NAME}){{1,2}}"
#: Full names by what is said around them, in the languages of the titles.
CUED = [
    re.compile(rf"\b(?:[Mm]y name is|[Nn]ame *:|[Cc]ontact *:|[Ss]igned,?|[Ss]incerely,|[Rr]egards,|[Dd]ear|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]on nom est|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут)\s+({_FULL})"),
    re.compile(rf"\b({_FULL}) (?:met|said|says|wrote|writes|told|asked|called|visited|married|phoned|e-?mailed)\b"),
    re.compile(rf"\b(?:met|told|asked|visited|married|phoned|e-?mailed) ({_FULL})"),
    re.compile(rf"\b({_FULL}),? ?[<(](?=[\w.%+\-]+@)"),
]
#: Quick tests for texts that may have a place for each of these patterns: some of these strings is in the text.
_CUES = [
    ("y name is", "ame:", "ame :", "ontact:", "ontact :", "igned", "incerely", "egards", "Dear ", "dear ", "ch heiße", "ame ist", "appelle", "nom est", "llamo", "nombre es", "зовут"),
    (" met ", " said", " says", " wrote", " writes", " told", " asked", " called", " visited", " married", " phoned", "mailed"),
    ("met ", "told ", "asked ", "visited ", "married ", "phoned ", "mailed "),
    ("@",),
]


def cued(text: str) -> list[re.Pattern]:
    """The patterns that the text may have a place for."""
    return [pattern for pattern, cues in zip(CUED, _CUES) if any(c in text for c in cues)]


# Capitalised words that are no part of a name.
NOT_NAMES = frozenset("The This That These Those A An And But Or If In On At To For From With By Of It He She They We You I My Your Our His Her Their Is Are Was Were Be When Where What Who Why How All Some Many New Dear Mr Mrs Ms Miss Dr Prof Sir Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December".split())


# What a text must have for the patterns above to be tried; most texts have none of it.
_DIGIT, _CAPITAL = re.compile(r"\d"), re.compile(r"[A-ZÀ-ÖØ-ÞЀ-ӿ]\w+")
_PEOPLE = frozenset(w for words in (MALE_TITLES, FEMALE_TITLES, OTHER_TITLES, MALE_NAMES, FEMALE_NAMES) for x in words for w in (x, x.upper()))
_GENDER = {w.lower(): g for g, words in (("m", MALE_NAMES), ("f", FEMALE_NAMES)) for w in words}
_TITLE_GENDER = {w.lower(): g for g, words in (("m", MALE_TITLES), ("f", FEMALE_TITLES)) for w in words}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def script(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def digits_of(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def scan(text: str) -> tuple[list[tuple[int, int, str, str]], set[tuple[str, str, str]]]:
    """(start, end, kind, canonical value) of all mentions, in order, without overlaps; the kinds tried first win. And
    what titles say: (kind, value, gender)."""
    taken: list[tuple[int, int, str, str]] = []
    said: set[tuple[str, str, str]] = set()

    def add(start: int, end: int, kind: str, value: str) -> None:
        if all(end <= s or start >= e for s, e, _, _ in taken):
            taken.append((start, end, kind, value))

    digit = _DIGIT.search(text) is not None
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            add(*m.span(1), "secret", m[1])
    if digit or max(map(len, text.split()), default=0) >= 20:
        for m in BARE_SECRET.finditer(text):
            add(*m.span(), "secret", m[0])
    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email", m[0].lower())
    if ":" in text or "-" in text:
        for m in MAC.finditer(text):
            add(*m.span(), "mac", re.sub("[:-]", "", m[0]).lower())
    if digit:
        _numbers(text, add)
    capitals = _CAPITAL.findall(text)
    listed = not _PEOPLE.isdisjoint(capitals)
    if listed or len(capitals) > 1 and (patterns := cued(text)):
        _people(text, add, said, listed, cued(text) if listed else patterns)
    return sorted(taken), said


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    return scan(text)[0]


def _numbers(text: str, add) -> None:
    for m in IBAN.finditer(text):
        if iban_ok(value := m[0].replace(" ", "")):
            add(*m.span(), "iban", value)
    for m in NUMBER.finditer(text):
        value = digits_of(m[0])
        add(*m.span(), "card" if luhn(value) else "account", value)
    for m in SSN.finditer(text):
        add(*m.span(), "ssn", digits_of(m[0]))
    for m in PHONE.finditer(text):
        value = digits_of(m[0])
        if 7 <= len(value) <= 15:
            add(*m.span(), "phone", value[-10:])
    for m in IP.finditer(text):
        if all(int(x) < 256 for x in m[0].split(".")):
            add(*m.span(), "ip", ".".join(str(int(x)) for x in m[0].split(".")))


def _people(text: str, add, said: set, listed: bool, patterns: list[re.Pattern]) -> None:
    """Full names first; then every other place of their parts in the text."""
    parts: dict[str, str] = {}

    def name(words: list[str], at: int, gender: str = "n") -> None:
        for i, word in enumerate(words):
            last = i == len(words) - 1
            value = word.lower()
            kind = parts.setdefault(value, f"{'surname' if last else 'given'} {script(word)}")
            add(at, at + len(word), kind, value)
            if not last and gender != "n" and kind.startswith("given"):
                said.add((kind, value, gender))
            at += len(word) + 1

    for m in TITLED.finditer(text) if listed else ():
        words = m[2].split(" ")
        while len(words) > 1 and words[-1].title() in NOT_NAMES:
            words.pop()
        if words[0].title() not in NOT_NAMES:
            name(words, m.start(2), _TITLE_GENDER.get(m[1].lower(), "n"))
    for m in NAMED.finditer(text) if listed else ():
        if m[2].title() not in NOT_NAMES:
            name([m[1], m[2]], m.start())
    for pattern in patterns:
        for m in pattern.finditer(text):
            words = m[1].split(" ")
            if not any(w.title() in NOT_NAMES for w in words):
                name(words, m.start(1))
    if parts:
        spellings = sorted({y for x in parts for y in (x.upper(), "-".join(w[:1].upper() + w[1:] for w in x.split("-")), x[:1].upper() + x[1:])}, key=len, reverse=True)
        for m in re.finditer(rf"(?<![\w@.])(?:{'|'.join(map(re.escape, spellings))})(?![\w@])", text):
            add(*m.span(), parts[m[0].lower()], m[0].lower())


class Stream:
    """Numbers drawn from HMAC-SHA256."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.label, self.block, self.pool = key, "\x00".join(parts).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            data = hmac.new(self.key, self.label + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.left, self.block = int.from_bytes(data, "big"), 256, self.block + 1
        found = (self.pool & 0xFFFFFFFF) * n >> 32
        self.pool >>= 32
        self.left -= 32
        return found

    def pick(self, items):
        return items[self.below(len(items))]


_LOWER, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя"
_ACCENTED = "áàâäãéèêëíìîïñóòôöõúùûüýç"


def alike(stream: Stream, text: str, hexadecimal: bool = False) -> str:
    """Digits for digits, letters of the same case and script for letters, everything else as it is."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(stream.pick("0123456789abcdef" if hexadecimal else "0123456789"))
        elif c.isalpha():
            letters = "0123456789abcdef" if hexadecimal else _CYRILLIC if script(c) == "cyrillic" else _LOWER if c.isascii() else _ACCENTED
            d = stream.pick(letters)
            out.append(d.upper() if c.isupper() else d)
        else:
            out.append(c)
    return "".join(out)


_SYLLABLES = {"latin": ("b br c d dr f g gr h j k l m n p r s st t v w".split(), "a e i o u".split()), "cyrillic": ("б в г д ж з к л м н п р с т ф".split(), "а е и о у".split())}
_ENDINGS = {("m", "latin"): ["rt", "n", "s", "rd", "l"], ("f", "latin"): ["na", "ra", "lia", "tte", "sa"], ("n", "latin"): ["ne", "ry", "le"], ("s", "latin"): ["rson", "ner", "lby", "mont", "ley"], ("m", "cyrillic"): ["н", "р", "м"], ("f", "cyrillic"): ["на", "ра", "ля"], ("n", "cyrillic"): ["ня", "ша"], ("s", "cyrillic"): ["енко", "нин", "рук"]}


def surrogate(key: bytes, kind: str, value: str, nonce: int = 0, gender: str | None = None) -> str:
    """The surrogate of a canonical value, itself canonical. ``gender`` (m, f, n) of a given name: by the name if not given."""
    stream = Stream(key, kind, value, str(nonce))
    first = kind.split(" ")[0]
    if nonce >= LONGER:
        return longer(stream, key, kind, value, nonce, gender)
    if first == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        host = alike(Stream(key, "domain", domain), labels[0])
        return f"{alike(stream, local)}@{host}.example.{labels[-1] if labels[-1] in ('com', 'net', 'org') else 'com'}"
    if first == "secret":
        plain = value.lower()
        return alike(stream, value, hexadecimal=all(c in "0123456789abcdef" for c in plain) and len(plain) >= 16)
    if first == "mac":
        return "02" + alike(stream, value[2:], hexadecimal=True)  # a locally administered address
    if first == "iban":
        body = alike(stream, value[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{value[:2]}00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if first in ("card", "account"):
        body = value[0] + alike(stream, value[1:-1])
        good = next(d for d in "0123456789" if luhn(body + d))
        if first == "card":
            return body + good
        return body + stream.pick([d for d in "0123456789" if d != good])
    if first == "ssn":
        return "9" + alike(stream, value[1:])  # areas from 900 on are never given out
    if first == "ip":
        ranges = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        octets = []
        for octet in value.split("."):
            low, high = ranges[len(octet)] if nonce < LONGER // 2 else (1, 254)
            octets.append(str(low + stream.below(high - low + 1)))
        return ".".join(octets)
    if first in ("given", "surname"):
        gender, writing = (gender or _GENDER.get(value, "n")) if first == "given" else "s", kind.split(" ")[1]
        consonants, vowels = _SYLLABLES[writing]
        stem = "".join(stream.pick(consonants) + stream.pick(vowels) for _ in range(2 + stream.below(2) + nonce // 4))
        return stem + stream.pick(_ENDINGS[gender, writing])
    return alike(stream, value)


def longer(stream: Stream, key: bytes, kind: str, value: str, nonce: int, gender: str | None) -> str:
    """A surrogate with a tail that grows with the nonce: hexadecimal groups of a documentation network for addresses,
    digits for numbers, else letters."""
    first, size = kind.split(" ")[0], nonce - LONGER + 4
    if first == "ip":
        return "2001:db8:" + ":".join("".join(stream.pick("0123456789abcdef") for _ in range(4)) for _ in range(min(6, size // 4))) + ":" * (size < 24)
    base = surrogate(key, kind, value, nonce % LONGER, gender)
    tail = "".join(stream.pick("0123456789" if value[-1:].isdigit() or first == "mac" else _CYRILLIC if script(value) == "cyrillic" else _LOWER) for _ in range(size))
    if first == "email":
        local, _, domain = base.partition("@")
        return f"{local}{tail}@{domain}"
    return base + tail


def render(kind: str, mention: str, value: str) -> str:
    """A canonical surrogate in the mention's own case and separators; what is longer than the mention goes to its end."""
    first = kind.split(" ")[0]
    if first in ("card", "account", "ssn", "phone", "iban", "mac"):
        places = [i for i, c in enumerate(mention) if c.isalnum()]
        out, tail = list(mention), value[len(places) :]
        plain = value[: len(places)]
        for i, c in zip(places[len(places) - len(plain) :], plain):
            out[i] = c.upper() if first == "mac" and mention.isupper() else c
        return "".join(out) + tail
    if first in ("given", "surname"):
        return value.upper() if mention.isupper() and len(mention) > 1 else value[:1].upper() + value[1:]
    if first == "email":
        return value.upper() if mention.isupper() else value
    return value


def entities(docs: DataFrame) -> DataFrame:
    """kind, value, gender: the distinct entities of all texts; gender (m, f, n) of given names, else null."""

    def make():
        seen: set[tuple] = set()

        def step(columns):
            if columns is None:
                return
            new = set()
            for text in columns["text"]:
                if text:
                    found, said = scan(text)
                    new |= {(*m[2:], "") for m in found} | said
            new -= seen
            if len(seen) > _KEPT:
                seen.clear()
            seen.update(new)
            if new:
                yield {name: list(x) for name, x in zip(("kind", "value", "said"), zip(*new))}

        return step

    found = map_batches(docs.select("text"), "kind string, value string, said string", make).groupBy("kind", "value").agg(*[F.max((F.col("said") == g).cast("int")).alias(g) for g in "mf"])
    by_name = F
    for gender, words in (("m", MALE_NAMES), ("f", FEMALE_NAMES)):
        by_name = by_name.when(F.col("value").isin(*[w.lower() for w in words]), gender)
    told = F.when((F.col("m") == 1) & (F.col("f") == 0), "m").when((F.col("f") == 1) & (F.col("m") == 0), "f").otherwise("n")
    return found.select("kind", "value", F.when(F.col("kind").startswith("given"), F.coalesce(by_name, told)).alias("gender"))


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """kind, value, gender, nonce, sub: a surrogate for each entity, distinct within its kind and not an entity itself."""

    def make():
        def step(columns):
            if columns is not None:
                yield {**columns, "sub": [surrogate(key, k, v, n, g) for k, v, n, g in zip(columns["kind"], columns["value"], columns["nonce"], columns["gender"])]}

        return step

    found = materialize(found)
    real = found.select("kind", F.col("value").alias("sub"), F.lit(True).alias("real"))
    pending, done = found.select("kind", "value", "gender", F.lit(0).alias("nonce")), []
    while True:
        drawn = materialize(map_batches(pending, "kind string, value string, gender string, nonce int, sub string", make))
        first = drawn.groupBy("kind", "sub").agg(F.min("value").alias("first"))
        marked = drawn.join(first.hint("merge"), ["kind", "sub"]).join(real.hint("merge"), ["kind", "sub"], "left")
        if done:
            before = reduce(DataFrame.union, done).select("kind", "sub", F.lit(True).alias("before"))
            marked = marked.join(before.hint("merge"), ["kind", "sub"], "left")
        else:
            marked = marked.withColumn("before", F.lit(None).cast("boolean"))
        good = (F.col("value") == F.col("first")) & F.col("real").isNull() & F.col("before").isNull()
        marked = materialize(marked.withColumn("good", good).select("kind", "value", "gender", "nonce", "sub", "good"))
        done.append(marked.where("good").select("kind", "value", "gender", "nonce", "sub"))
        pending = marked.where("not good").select("kind", "value", "gender", (F.col("nonce") + 1).alias("nonce"))
        if not pending.take(1):
            return reduce(DataFrame.union, done)


def rewrite(text: str, key: bytes, special: dict[tuple[str, str], tuple[int, str | None]], known: dict) -> tuple[str, list[str]]:
    """The text with all mentions replaced, and their kinds. ``special``: nonce and gender of entities, where they are not
    0 and what the name shows."""
    out, at, kinds = [], 0, []
    for start, end, kind, value in mentions(text):
        sub = known.get((kind, value))
        if sub is None:
            if len(known) > _KEPT:
                known.clear()
            sub = known[kind, value] = surrogate(key, kind, value, *special.get((kind, value), (0, None)))
        out += [text[at:start], render(kind, text[start:end], sub)]
        at = end
        kinds.append(kind.split(" ")[0])
    return "".join([*out, text[at:]]) if out else text, kinds


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities and kinds (such as ``email:2 ip:1``) added.

    All rows and columns stay; columns of ``docs`` with these two names are replaced. A null text stays null and has no
    entities. Repeated rows are rewritten alike. Texts without entities are unchanged.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    by_name = F.coalesce(*[F.when(F.col("value").isin(*[w.lower() for w in words]), g) for g, words in (("m", MALE_NAMES), ("f", FEMALE_NAMES))], F.lit("n"))
    redrawn = assign(entities(docs), key).where((F.col("nonce") > 0) | (F.col("gender") != by_name)).select("kind", "value", "nonce", "gender")
    redrawn = materialize(redrawn)
    few = redrawn.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    nonces = {(r["kind"], r["value"]): (r["nonce"], r["gender"]) for r in redrawn.collect()} if few else {}
    shared = spark.sparkContext.broadcast(pickle.dumps(nonces))
    carried = [c for c in docs.columns if c not in ("text", "n_entities", "kinds")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    inner = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)], F.col("text").alias("_text"))
    own = "array<struct<kind string, value string, nonce int, gender string>>"
    inner = inner.withColumn("_own", F.lit(None).cast(own)) if few else _with_nonces(inner, redrawn)
    schema = ", ".join([*(f"_c{i} {types[c]}" for i, c in enumerate(carried)), "_text string, _n long, _kinds string"])

    def make():
        common, known = pickle.loads(shared.value), {}

        def step(columns):
            if columns is None:
                return
            texts, counts, kinds = [], [], []
            for text, more in zip(columns["_text"], columns["_own"]):
                if more:
                    new, found = rewrite(text, key, {(m["kind"], m["value"]): (m["nonce"], m["gender"]) for m in more}, {})
                else:
                    new, found = rewrite(text, key, common, known) if text else (text, [])
                texts.append(new)
                counts.append(len(found))
                kinds.append(" ".join(f"{k}:{found.count(k)}" for k in sorted(set(found))))
            yield {f"_c{i}": columns[f"_c{i}"] for i in range(len(carried))} | {"_text": texts, "_n": counts, "_kinds": kinds}

        return step

    done = map_batches(inner, schema, make)
    place = {c: f"_c{i}" for i, c in enumerate(carried)} | {"text": "_text"}
    return done.select(*[F.col(place[c]).alias(c) for c in docs.columns if c in place], F.col("_n").alias("n_entities"), F.col("_kinds").alias("kinds"))


def _with_nonces(inner: DataFrame, redrawn: DataFrame) -> DataFrame:
    """The redrawn entities of each text, joined by the text's digest."""

    def make():
        def step(columns):
            if columns is not None:
                found = [(name, *m) for name, text in zip(columns["name"], columns["_text"]) for m in {m[2:] for m in mentions(text)}]
                if found:
                    yield {c: list(x) for c, x in zip(("name", "kind", "value"), zip(*found))}

        return step

    named = inner.withColumn("name", F.sha2("_text", 256))
    found = map_batches(named.where("_text is not null").select("name", "_text"), "name string, kind string, value string", make).distinct()
    own = found.join(redrawn.hint("merge"), ["kind", "value"]).groupBy("name").agg(F.collect_list(F.struct("kind", "value", "nonce", "gender")).alias("_own"))
    return named.join(own.hint("merge"), "name", "left").drop("name")
