"""Literal spotting: which literals of a knowledge base occur where in which document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftline.functions.text import cut, offsets, pieces
from weftline.session import materialize

#: Longest suffix in characters.
MAX_SUFFIX = 100
#: A literal is looked up by its first characters, as many as the longest of these lengths that it has: long ones keep
#: literals that begin alike (numbered names) apart, short ones are for short literals.
HEADS = (16, 8, 4, 3, 2, 1)


def suffix_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n, distinct, least of each text's suffixes (see ``suffixes``), counted text by text."""

    def count(content, places):
        found = [content[a : a + MAX_SUFFIX].lower() for a, _ in places if content[a].isalnum()]
        return [(len(found), len(set(found)), min(found))] if found else []

    return cut(docs, "text", count, "n long, distinct long, least string")


#: Bits of the filter of literals' beginnings: a fixed size, 16 MB for any number of literals.
FILTER_BITS = 1 << 27
#: Characters of the beginnings that are tried first.
STEM = 4
#: Characters that Python and the JVM may write differently in lower case; texts with one are not filtered.
_UNLIKE = "[\u0130\u03a3\u2c2f\ua7c0-\ua7ff\U00010570-\U000105bf\U00010d50-\U00010d6f]"


def suffixes(docs: DataFrame, most_pieces: int, begins: Callable[[], Callable[[str], bool]] | None = None) -> DataFrame:
    """doc_id, start, first (length of the token), suffix (lower case, at most MAX_SUFFIX characters), surface (at most
    ``most_pieces`` pieces) at every token that starts with a letter or digit. One pass over each text.

    ``begins`` makes a test of the first characters; suffixes that fail it give no row.
    """
    made = []

    def emit(content, places):
        ends = [b for _, b in places]
        last = len(ends) - 1
        if begins is None:
            return [(a, b - a, content[a : ends[min(i + most_pieces - 1, last)]]) for i, (a, b) in enumerate(places) if content[a].isalnum()]
        if not made:
            made.append(begins())
        test = made[0]
        return [(a, b - a, content[a : ends[min(i + most_pieces - 1, last)]]) for i, (a, b) in enumerate(places) if content[a].isalnum() and test(content[a : a + HEADS[0]])]

    return cut(docs, "text", emit, "start int, first int, surface string").select("doc_id", "start", "first", F.lower(F.substring("surface", 1, MAX_SUFFIX)).alias("suffix"), "surface")


def bitmap(texts: DataFrame) -> bytes:
    """A filter of FILTER_BITS bits with the CRC-32 of each ``text`` set, gathered in words of 64 bits."""
    import numpy as np

    bit = F.crc32(F.col("text").cast("binary")) % FILTER_BITS
    words = texts.select(bit.alias("bit")).distinct().groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    found = words.toPandas()  # at most 2^21 rows of two numbers
    bits = np.zeros(FILTER_BITS // 64, dtype="<i8")
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.tobytes()


def beginnings(wanted: DataFrame, lengths: list[int]) -> Callable[[], Callable[[str], bool]]:
    """The test for ``suffixes``: may a text be the beginning of an occurrence of a literal of ``wanted`` (low, head)?

    A filter of fixed size has the heads, and the first STEM characters of each literal: most texts end there. What it
    lets through by chance, the join drops.
    """
    texts = wanted.select(F.explode(F.array(F.concat(F.lit("h"), "head"), F.concat(F.lit("s"), F.substring("low", 1, STEM)))).alias("text"))
    shared = wanted.sparkSession.sparkContext.broadcast(bitmap(texts))

    def begins():
        import re
        from zlib import crc32

        bits, unlike, stems = shared.value, re.compile(_UNLIKE).search, {}

        def has(text):
            bit = crc32(text.encode("utf-8", "surrogatepass")) % FILTER_BITS
            return bits[bit >> 3] >> (bit & 7) & 1

        def test(text):
            stem = text[:STEM]
            known = stems.get(stem)
            if known is None:
                if len(stems) > 500_000:
                    stems.clear()
                low = stem.lower()
                known = stems[stem] = bool(unlike(stem)) or any(has("s" + low[:n]) for n in range(1, STEM + 1))
            if not known:
                return False
            low = text.lower()
            return bool(unlike(text)) or any(has("h" + low[:n]) for n in lengths)

        return test

    return begins


def literal_rows(literals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (literal index, property, belief, literal) with lower-cased text and its number of pieces."""
    joined = symbols.join(literals, symbols["object"] == literals["index"])
    return joined.select(F.col("object").alias("literal_index"), F.col("predicate").alias("property"), "belief", "literal", F.lower("literal").alias("low")).distinct().withColumn("n_pieces", F.size(pieces(F.col("literal"))))


def spot(docs: DataFrame, literals: DataFrame, symbols: DataFrame) -> DataFrame:
    """doc_id, a, b, literal_index, property, belief, literal, surface for each occurrence of a whole literal at a token start.

    An equi-join on the first characters (lower case) finds candidates, a prefix test confirms them. Each suffix has a
    head of each length that some literal is looked up by, so short literals are found beside long ones. Suffixes that
    begin like no literal go before the join, so what is dealt grows with the matches and not with the text. Occurrences
    that do not end with a token are removed.
    """
    size = F.length("low")
    head = F.coalesce(*[F.when(size >= n, F.substring("low", 1, n)) for n in HEADS])
    wanted = materialize(literal_rows(literals, symbols).where(size > 0).withColumn("head", head))
    known = wanted.agg(F.max("n_pieces").alias("most"), F.collect_set(F.length("head")).alias("lengths")).head()  # at most as many as HEADS
    lengths = sorted(known["lengths"]) or [1]
    heads = F.array_distinct(F.array(*[F.substring("suffix", 1, n) for n in lengths]))
    found = suffixes(docs, known["most"] or 1, beginnings(wanted, lengths)).withColumn("head", F.explode(heads))
    hits = found.join(wanted, "head").where(F.col("suffix").startswith(F.col("low")))
    rest = F.substring("surface", F.length("literal") + 1, F.lit(2))
    # the match ends with a token unless a word goes on behind it
    inside = rest.rlike(r"^[\p{L}\p{N}_]|^['’.][\p{L}\p{N}_]") & F.col("literal").rlike(r"[\p{L}\p{N}_]$")
    return hits.where(~inside).select("doc_id", F.col("start").alias("a"), (F.col("start") + F.length("literal")).alias("b"), "literal_index", "property", "belief", "literal", F.substring("surface", F.lit(1), F.length("literal")).alias("surface"))


def longest(spans: DataFrame) -> DataFrame:
    """Spans without those that lie inside a longer one; equal spans stay."""
    w = W.partitionBy("doc_id").orderBy("a", F.desc("b")).rowsBetween(W.unboundedPreceding, -1)
    distinct = spans.select("doc_id", "a", "b").distinct()
    inside = F.coalesce(F.max("b").over(w) >= F.col("b"), F.lit(False))
    kept = distinct.withColumn("inside", inside).where(~F.col("inside")).select("doc_id", "a", "b")
    return spans.join(kept, ["doc_id", "a", "b"], "left_semi")


def exact_case(spans: DataFrame) -> DataFrame:
    """If some literal equals a surface text exactly, other spellings go for that surface text in the document."""
    exact = F.max((F.col("literal") == F.col("surface")).cast("int")).over(W.partitionBy("doc_id", "surface"))
    return spans.withColumn("exact", exact).where((F.col("exact") == 0) | (F.col("literal") == F.col("surface"))).drop("exact")


def ordered(spans: DataFrame) -> DataFrame:
    return spans.orderBy("doc_id", "a", F.desc("b"), "property")


def bio(spans: DataFrame) -> DataFrame:
    """doc_id, start, property, literal_index, position (B or I) for each token of each span, cut from its own surface."""
    inner = spans.select("doc_id", "a", "b", "property", "literal_index", "surface").distinct().withColumn("p", pieces(F.col("surface")))
    inner = inner.withColumn("o", offsets(F.col("p")))
    rows = inner.select("doc_id", "a", "property", "literal_index", F.explode(F.arrays_zip("p", "o")).alias("t")).where(~F.col("t.p").rlike(r"^\s"))
    return rows.select("doc_id", (F.col("a") + F.col("t.o")).alias("start"), "property", "literal_index", F.when(F.col("t.o") == 0, "B").otherwise("I").alias("position"))


def regex_entities(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """doc_id, regex, start, end, value of every match of every pattern.

    A pattern's matches and the gaps between them alternate; their running lengths give the offsets. Only matches
    become rows. Patterns must not match the empty string.
    """
    rows = None
    for name, pattern in patterns.items():
        # only texts with a match are cut
        found = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.split("text", pattern).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("values"))
        both = F.flatten(F.zip_with(F.slice("gaps", 1, F.size("values")), "values", lambda g, v: F.array(g, v)))
        placed = found.select("doc_id", "values", offsets(both).alias("o"))
        one = placed.select("doc_id", F.posexplode("values").alias("i", "value"), "o").select("doc_id", F.lit(name).alias("regex"), F.get("o", F.col("i") * 2 + 1).alias("start"), "value")
        one = one.select("doc_id", "regex", "start", (F.col("start") + F.length("value")).alias("end"), "value")
        rows = one if rows is None else rows.unionAll(one)
    return rows


def property_frequency(spans: DataFrame, n_docs: Column) -> DataFrame:
    """property, df, score: the number of documents with it, and N / (df + 1)."""
    return spans.groupBy("property").agg(F.count_distinct("doc_id").alias("df")).select("property", "df", (n_docs / (F.col("df") + 1)).alias("score"))
