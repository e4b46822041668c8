"""Text expressions: markup blanking, sentences, word shapes, rule tags inside the JVM; tokens with offsets in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: One piece of text: a number with separators, a word (with inner apostrophes and full stops), white space, or one other character.
PIECE = r"\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*|\s+|[^\p{L}\p{N}_\s]"
_HEAD = r"(?is)<head.*/head>|[^<]+|<"
_SCRIPT = r"(?is)<script.*?/script>|[^<]+|<"
_TAG = r"(?i)<.+?>|[^<]+|<"


def blank_markup(html: Column) -> Column:
    """HTML with the head, scripts and tags replaced by as many spaces; line ends stay, so offsets do too."""
    text = html
    for pattern, starts in ((_HEAD, r"(?i)^<head"), (_SCRIPT, r"(?i)^<script"), (_TAG, r"(?s)^<.")):
        text = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _blank_if(starts)), "")
    return text


def _blank_if(pattern: str):
    return lambda x: F.when(x.rlike(pattern), F.regexp_replace(x, r"[^\n\r]", " ")).otherwise(x)


def pieces(text: Column) -> Column:
    """The pieces of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def words(text: Column) -> Column:
    """The pieces that are not white space, as an array."""
    return F.filter(pieces(text), lambda p: ~p.rlike(r"^\s"))


def offsets(parts: Column) -> Column:
    """The start of each piece."""
    sums = F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))
    return F.slice(sums, F.lit(1), F.size(parts))


#: Rows of an Arrow batch that tokens and suffixes give at a time.
_ROWS = 50_000


def cut(docs: DataFrame, text: str, emit: Callable[[str, list[tuple[int, int]]], list[tuple]], columns: str) -> DataFrame:
    """doc_id and the columns of ``emit``, for each text and the places (start, end) of its pieces: one pass over each text.

    A running sum over pieces needs a shuffle in the JVM, or copies of a growing array; a scan has the places at hand.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    from weftline.session import ship_package

    ship_package(docs.sparkSession)
    fields = StructType([docs.schema["doc_id"], *_parse_datatype_string(columns)])
    arrow = to_arrow_schema(fields)
    # white space as in the JVM, where it is ASCII
    pattern = PIECE.replace(r"_\s]", r"_ \t\n\x0B\f\r]").replace(r"\s", r"[ \t\n\x0B\f\r]")

    def run(batches):
        import regex

        find, held = regex.compile(pattern).finditer, []
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if content:
                    held += [(doc, *row) for row in emit(content, [m.span() for m in find(content)])]
                while len(held) >= _ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held[:_ROWS]), arrow)], schema=arrow)
                    held = held[_ROWS:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return docs.select("doc_id", text).mapInArrow(run, fields)


def tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, end, token: the pieces that are not white space, with their offsets."""

    def emit(content, places):
        return [(a, b, content[a:b]) for a, b in places if content[a] not in " \t\n\x0b\f\r"]

    return cut(docs, text, emit, "start int, end int, token string")


def token_ranges(toks: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, start, end, n: the number of tokens in each range (doc_id, start, end) whose ends are ends of tokens."""
    asked = ranges.select("doc_id", F.col("start").alias("lower"), F.col("end").alias("upper")).distinct()
    inside = toks.join(asked, "doc_id").where((F.col("start") >= F.col("lower")) & (F.col("end") <= F.col("upper")))
    found = inside.groupBy("doc_id", "lower", "upper").agg(F.min("start").alias("first"), F.max("end").alias("last"), F.count("*").alias("n"))
    return found.where("first = lower and last = upper").select("doc_id", F.col("lower").alias("start"), F.col("upper").alias("end"), "n")


#: Ends of sentences: a stop, quotes or brackets after it, white space.
SENTENCE = r"[^.!?…]*(?:[.!?…]+(?:[^\s.!?…][^.!?…]*)?)*?[.!?…]+[\"'”’)\]]*\s+|[\s\S]+"


def sentence_flags(toks: DataFrame) -> DataFrame:
    """Tokens with sent, numbered from 0 in each document: a sentence ends after a stop that white space or the end follows."""
    w = W.partitionBy("doc_id").orderBy("start")
    before = F.lag("token").over(w)
    ended = before.isin(".", "!", "?", "…") & (F.lag("end").over(w) < F.col("start"))
    return toks.withColumn("sent", F.sum(F.coalesce(ended, F.lit(False)).cast("int")).over(w).cast("int"))


def tagged(toks: DataFrame) -> DataFrame:
    """Tokens with pos by rules: numbers CD, punctuation itself, determiners DT, adjectives JJ, adverbs RB, verbs, capitals NNP, others NN."""
    t, low = F.col("token"), F.lower("token")
    pos = (
        F.when(t.rlike(r"^\p{N}"), "CD")
        .when(t.rlike(r"^[.!?]$"), ".")
        .when(t.rlike(r"^[,;:]$"), ",")
        .when(~t.rlike(r"^[\p{L}_]"), "SYM")
        .when(low.isin("the", "a", "an", "der", "die", "das", "ein", "eine", "le", "la", "les", "un", "une", "el", "los", "las", "una"), "DT")
        .when(low.isin("of", "in", "to", "for", "with", "by", "on", "at", "from", "von", "mit", "zu", "im", "de", "du", "des", "dans", "par", "sur", "en", "con", "para", "del"), "IN")
        .when(low.isin("and", "or", "und", "et", "y"), "CC")
        .when(low.isin("he", "she", "it", "they", "er", "sie", "es", "il", "elle"), "PRP")
        .when(low.rlike("(ly|ment|mente)$") & (F.length(t) > 4), "RB")
        .when(low.rlike("(ing|ed|ieren)$") & (F.length(t) > 4), "VB")
        .when(low.rlike("(ous|ful|able|ible|ive|isch|lich|eux)$") & (F.length(t) > 4), "JJ")
        .when(t.rlike(r"^\p{Lu}"), "NNP")
        .otherwise("NN")
    )
    return toks.withColumn("pos", pos)


def chunked(toks: DataFrame) -> DataFrame:
    """Tagged tokens with np: B-NP, I-NP or O for runs of (DT) JJ* NN*.

    A run goes on while tags are nominal; a determiner starts a new one. A run without a noun is none.
    """
    w = W.partitionBy("doc_id").orderBy("start")
    nominal = F.col("pos").isin("DT", "JJ", "NN", "NNP")
    starts = nominal & (~F.coalesce(F.lag(nominal).over(w), F.lit(False)) | (F.col("pos") == "DT") | (F.coalesce(F.lag("sent").over(w), F.lit(-1)) != F.col("sent")))
    run = toks.withColumn("nominal", nominal).withColumn("run", F.sum(starts.cast("int")).over(w)).withColumn("starts", starts)
    noun = F.max((F.col("pos").isin("NN", "NNP") & F.col("nominal")).cast("int")).over(W.partitionBy("doc_id", "run"))
    np = F.when(F.col("nominal") & (noun == 1), F.when(F.col("starts"), "B-NP").otherwise("I-NP")).otherwise("O")
    return run.withColumn("np", np).drop("nominal", "run", "starts")


_DT = frozenset("the a an der die das ein eine le la les un une el los las una".split())
_IN = frozenset("of in to for with by on at from von mit zu im de du des dans par sur en con para del".split())
_CC, _PRP = frozenset("and or und et y".split()), frozenset("he she it they er sie es il elle".split())
_RB, _VB, _JJ = ("ly", "ment", "mente"), ("ing", "ed", "ieren"), ("ous", "ful", "able", "ible", "ive", "isch", "lich", "eux")
#: Tokens of which a process remembers the tag.
_KNOWN = 500_000


def _tag(token: str) -> str:
    """The tag of one token, by the rules of ``tagged``."""
    import regex

    if regex.match(r"\p{N}", token):
        return "CD"
    if token in (".", "!", "?"):
        return "."
    if token in (",", ";", ":"):
        return ","
    if not regex.match(r"[\p{L}_]", token):
        return "SYM"
    low = token.lower()
    for words_, tag in ((_DT, "DT"), (_IN, "IN"), (_CC, "CC"), (_PRP, "PRP")):
        if low in words_:
            return tag
    if len(token) > 4:
        for ends, tag in ((_RB, "RB"), (_VB, "VB"), (_JJ, "JJ")):
            if low.endswith(ends):
                return tag
    return "NNP" if regex.match(r"\p{Lu}", token) else "NN"


def annotator() -> Callable[[str, list[tuple[int, int]]], list[list]]:
    """A function of a text and the places of its pieces: [start, end, token, sent, pos, np, i] of each token, i the place in
    its sentence. One scan of the text gives what ``sentence_flags``, ``tagged`` and ``chunked`` find by windows."""
    tags: dict[str, str] = {}

    def annotate(content, places):
        rows, run = [], []
        sent = i = ended = before_end = 0
        noun = nominal = False

        def close():
            if noun:
                for row in run:
                    row[5] = "I-NP"
                run[0][5] = "B-NP"
            run.clear()

        for a, b in places:
            if content[a] in " \t\n\x0b\f\r":
                continue
            token = content[a:b]
            tag = tags.get(token)
            if tag is None:
                if len(tags) >= _KNOWN:
                    tags.clear()
                tag = tags[token] = _tag(token)
            starts = not nominal or tag == "DT"
            if ended and before_end < a:
                sent, i, starts = sent + 1, 0, True
            nominal = tag in ("NN", "NNP", "DT", "JJ")
            if run and (starts or not nominal):
                close()
                noun = False
            row = [a, b, token, sent, tag, "O", i]
            if nominal:
                run.append(row)
                noun = noun or tag in ("NN", "NNP")
            rows.append(row)
            ended, before_end, i = token in (".", "!", "?", "…"), b, i + 1
        if run:
            close()
        return rows

    return annotate


def per_text(docs: DataFrame, emit: Callable[[list[list]], list[tuple]], columns: str, text: str = "text") -> DataFrame:
    """doc_id and the columns of ``emit``, a function of the annotated tokens of one text (see ``annotator``)."""
    made = []

    def run(content, places):
        if not made:
            made.append(annotator())
        return emit(made[0](content, places))

    return cut(docs, text, run, columns)


def annotated(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, start, end, token, sent, pos, np, i of each token: one pass over each text, nothing is dealt."""
    return per_text(docs, lambda rows: rows, "start int, end int, token string, sent int, pos string, np string, i int", text)


def phrase_counts(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, phrases, inside, distinct_inside, distinct_tokens of each text that has tokens."""

    def count(rows):
        inside = [r[2] for r in rows if r[5] != "O"]
        return [(len(rows), sum(r[5] == "B-NP" for r in rows), len(inside), len(set(inside)), len({r[2] for r in rows}))] if rows else []

    return per_text(docs, count, "tokens long, phrases long, inside long, distinct_inside long, distinct_tokens long")


def phrases(toks: DataFrame) -> DataFrame:
    """doc_id, start, end, n_tokens of noun phrases from BIO tags; an orphan I-NP begins a phrase, any other tag ends one."""
    w = W.partitionBy("doc_id").orderBy("start")
    before = F.coalesce(F.lag("np").over(w), F.lit("O"))
    starts = (F.col("np") == "B-NP") | ((F.col("np") == "I-NP") & ~before.isin("B-NP", "I-NP"))
    numbered = toks.withColumn("phrase", F.sum(starts.cast("int")).over(w)).where(F.col("np").isin("B-NP", "I-NP"))
    return numbered.groupBy("doc_id", "phrase").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_tokens")).drop("phrase")


#: Word shapes in the order in which they are tried; the last that matches holds.
SHAPES = [
    ("MIXEDCAPS", r"[A-Z][a-z]+[A-Z][A-Za-z]*"),
    ("ALLDIGITS", r"[0-9]+"),
    ("NUMERICAL", r"[-0-9]+[\.,]+[0-9\.,]+"),
    ("DATE", r"[0-9]+[!-/:-@\[-`{-~0-9]+"),
    ("ROMAN", r"[ivxdlcm]+|[IVXDLCM]+"),
    ("MULTIDOTS", r"\.\.+"),
    ("LONELYINITIAL", r"\p{Lu}\."),
    ("ABBR", r"[\p{Lu}\p{Ll}][\p{Lu}\p{Ll}]+\."),
    ("SINGLECHARALLCAPS", r"[\p{Lu}\p{Ll}]"),
    ("CAPLETTER", r"[A-Z]"),
    ("PUNC", r"[,\.;:?!()]"),
    ("QUOTES", r"[\"`'][\p{Lu}\p{Ll}]?"),
    ("ENUM", r"[0-9]+[,\.;:?!()a-z]+"),
    ("NUMRANGE", r"[0-9]+-[0-9]+"),
]


def word_shape(token: Column) -> Column:
    """The name of the last shape that the whole token has, or the token itself."""
    shape = F
    for name, pattern in reversed(SHAPES):
        shape = shape.when(token.rlike(f"^(?:{pattern})$"), name)
    return shape.otherwise(token)


def word_features(token: Column, suffix: bool = True) -> Column:
    """The shape, or the token and, if longer than three characters, its last three as ``s:``."""
    shape = word_shape(token)
    plain = F.array(F.concat(F.lit("s:"), F.right(token, F.lit(3))), token) if suffix else F.array(token)
    return F.when((shape == token) & (F.length(token) > 3), plain).otherwise(F.array(shape))


def shape_of() -> Callable[[str], str]:
    """``word_shape`` for one token in Python."""
    import regex

    tried = [(name, regex.compile(f"(?:{pattern})").fullmatch) for name, pattern in reversed(SHAPES)]
    known: dict[str, str] = {}

    def shape(token):
        found = known.get(token)
        if found is None:
            if len(known) >= _KNOWN:
                known.clear()
            found = known[token] = next((name for name, match in tried if match(token)), token)
        return found

    return shape


def grams_of(sequence: list[str], n: int, prefix: str = "") -> list[str]:
    """``ngrams`` in Python."""
    size = min(len(sequence), n)
    return [prefix + ",".join(sequence[k : k + size]) for k in range(len(sequence) - size + 1)] if sequence else []


def ngrams(sequence: Column, n: int, prefix: str = "") -> Column:
    """Runs of n items joined by commas, n at most the length; none for an empty sequence."""
    size = F.least(F.size(sequence), F.lit(n))
    made = F.transform(F.sequence(F.lit(1), F.size(sequence) - size + 1), lambda i: F.concat(F.lit(prefix), F.array_join(F.slice(sequence, i, size), ",")))
    return F.when(F.size(sequence) > 0, made).otherwise(F.array().cast("array<string>"))


#: Frequent words of each language: the profile that language identification counts.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "ein", "eine", "sich", "auf", "für", "im", "dem", "zu"],
    "en": ["the", "and", "of", "to", "is", "that", "with", "for", "are", "was", "it", "this", "by", "from"],
    "es": ["el", "los", "las", "que", "una", "con", "para", "por", "del", "su", "se", "y"],
    "fr": ["le", "les", "des", "et", "est", "une", "dans", "pour", "sur", "avec", "qui", "au", "du"],
}


def detect_language(docs: DataFrame, default: str = "unknown") -> DataFrame:
    """doc_id, language: the language with most stop words; de and en are kept, anything else is the default."""
    low = F.transform(words(F.col("text")), F.lower)
    among = lambda own: lambda w: w.isin(*own)
    counts = [F.size(F.filter(low, among(own))).alias(lang) for lang, own in STOP_WORDS.items()]
    counted = docs.select("doc_id", *counts)
    best = F.greatest(*STOP_WORDS)
    lang = F
    for name in STOP_WORDS:
        lang = lang.when((F.col(name) == best) & (best > 0), name if name in ("de", "en") else default)
    return counted.select("doc_id", lang.otherwise(default).alias("language"))
