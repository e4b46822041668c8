"""Triple sources: RDF text formats, ingest rules, and a knowledge base made of relational tables.

A triple has s, p, o (strings) and kind ('uri' or 'literal'; 'bnode' before the ingest rules).
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftline.session import table

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
#: Longest URI and the bounds of a literal's length that ingest keeps.
URI_LENGTH, LITERAL_LENGTH = 120, (2, 100)
BASE = "http://ex/"

_URI = r"<([^<>\"{}|^`\\\x00-\x20]*)>"
_NTRIPLE = r"^\s*(?:" + _URI + r"|(_:[\w.-]+))\s+" + _URI + r"\s+(?:" + _URI + r"|(_:[\w.-]+)|\"((?:[^\"\\]|\\.)*)\"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files (plain, gz or bz2). Lines that are not triples are left out, as a lenient parser does."""
    return parse_ntriples(spark.read.text(path))


def parse_ntriples(lines: DataFrame) -> DataFrame:
    """The same from a DataFrame with one line of text in ``value`` of each row."""
    part = [F.regexp_extract("value", _NTRIPLE, i) for i in range(1, 7)]
    text = part[5]
    for escaped, plain in ((r'\\"', '"'), (r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r"\\\\", r"\\")):
        text = F.regexp_replace(text, escaped, plain)
    kind = F.when(part[3] != "", "uri").when(part[4] != "", "bnode").otherwise("literal")
    found = lines.where(F.col("value").rlike(_NTRIPLE))
    return found.select(F.when(part[0] != "", part[0]).otherwise(part[1]).alias("s"), part[2].alias("p"), F.when(part[3] != "", part[3]).when(part[4] != "", part[4]).otherwise(text).alias("o"), kind.alias("kind"))


def parse_documents(docs: DataFrame, syntax: str, base: str = "") -> DataFrame:
    """Triples of whole documents (column ``text``) in Turtle, TriG, RDF/XML or TriX, in Arrow batches.

    A document is one row, so this is for many files of moderate size; N-Triples is the format for bulk.
    """
    from weftline.session import ship_package
    from weftline.sources import rdfxml, turtle

    ship_package(docs.sparkSession)
    read = {"turtle": turtle.read_turtle, "trig": turtle.read_turtle, "rdfxml": rdfxml.read_rdfxml, "trix": rdfxml.read_trix}[syntax]

    def run(batches):
        for batch in batches:
            rows = [t for text in batch.column(0).to_pylist() for t in read(text or "", base)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*rows)], names=["s", "p", "o", "kind"])

    return docs.select("text").mapInArrow(run, "s string, p string, o string, kind string")


def parse_turtle(docs: DataFrame) -> DataFrame:
    """Triples of Turtle documents: prefixes, base, a, ; and , lists, literals; no nesting or collections."""
    return parse_documents(docs, "turtle")


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """Triples of a database table with columns s, p, o, kind. Give partitionColumn, lowerBound, upperBound and
    numPartitions to read a large table in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load().select("s", "p", "o", "kind")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Triples of CSV files with a header and quoted values, as ``sinks.save`` writes them."""
    return spark.read.option("header", True).option("quote", '"').option("escape", "\\").csv(path).select("s", "p", "o", "kind")


def ingest(triples: DataFrame) -> DataFrame:
    """The ingest rules: URIs of at most 120 characters; literals without line ends, tabs, quotes and backslashes, trimmed, of 2 to 100; no blank objects."""
    literal = F.trim(F.regexp_replace("o", r'[\n\t\\"]', ""))
    cleaned = triples.withColumn("o", F.when(F.col("kind") == "literal", literal).otherwise(F.col("o")))
    short = (F.length("s") <= URI_LENGTH) & (F.length("p") <= URI_LENGTH)
    fits = F.when(F.col("kind") == "literal", F.length("o").between(*LITERAL_LENGTH)).otherwise(F.length("o") <= URI_LENGTH)
    return cleaned.where((F.col("kind") != "bnode") & short & fits)


def repair_uri(uri: Column) -> Column:
    """Percent-encode characters that no URI may hold, and give a scheme to what has none."""
    encoded = uri
    for char, code in ((r" ", "%20"), (r'"', "%22"), (r"<", "%3C"), (r">", "%3E"), (r"\\", "%5C"), (r"\^", "%5E"), (r"`", "%60"), (r"\{", "%7B"), (r"\|", "%7C"), (r"\}", "%7D")):
        encoded = F.regexp_replace(encoded, char, code)
    return F.when(encoded.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), encoded).otherwise(F.concat(F.lit("http://"), encoded))


def literal_hash(text: Column, k: int = 4) -> Column:
    """The Java string hash of the first k characters, as a signed int (characters of the basic plane)."""
    codes = F.transform(F.filter(F.split(F.substring(text, 1, k), ""), lambda c: c != ""), F.ascii)
    word = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    return F.when(word >= 1 << 31, word - (1 << 32)).otherwise(word).cast("int")


def star_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of the relational tables and of the benchmark items.

    Keys are resources, foreign keys and types object properties, names datatype properties. A benchmark item has the
    first two words of its text as name and the first three as label, the name of the item before it as alias, and is
    related to two other items.
    """

    def uri(kind: str, *keys: str) -> Column:
        return F.concat(F.lit(f"{BASE}{kind}/"), F.concat_ws("-", *[F.col(k).cast("string") for k in keys]))

    def rows(df: DataFrame, s: Column, *parts: tuple) -> list[DataFrame]:
        return [df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind")) for p, o, kind in parts]

    def typed(name: str) -> tuple:
        return (RDF_TYPE, F.lit(f"{BASE}type/{name}"), "uri")

    t = {n: table(spark, folder, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "benchmark")}
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    items = t["benchmark"].select("item_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    count = t["benchmark"].agg(F.count("*").alias("n"))
    items = items.crossJoin(F.broadcast(count))  # one row
    name, label = (F.array_join(F.slice("w", 1, k), " ") for k in (2, 3))
    other = lambda step: F.concat(F.lit(f"{BASE}item/"), F.pmod(step, F.col("n")).cast("string"))
    parts = [
        *rows(t["region"], uri("region", "r_regionkey"), typed("region"), (f"{BASE}name", F.col("r_name"), "literal")),
        *rows(t["nation"], uri("nation", "n_nationkey"), typed("nation"), (f"{BASE}inRegion", uri("region", "n_regionkey"), "uri"), (f"{BASE}name", F.col("n_name"), "literal")),
        *rows(t["customer"], uri("customer", "c_custkey"), typed("customer"), (RDF_TYPE, F.concat(F.lit(f"{BASE}type/segment-"), slug(F.col("c_mktsegment"))), "uri"), (f"{BASE}inNation", uri("nation", "c_nationkey"), "uri"), (f"{BASE}name", F.col("c_name"), "literal")),
        *rows(t["supplier"], uri("supplier", "s_suppkey"), typed("supplier"), (f"{BASE}inNation", uri("nation", "s_nationkey"), "uri"), (f"{BASE}name", F.col("s_name"), "literal")),
        *rows(t["part"], uri("part", "p_partkey"), typed("part"), (RDF_TYPE, F.concat(F.lit(f"{BASE}type/part-"), slug(F.col("p_type"))), "uri"), (f"{BASE}name", F.col("p_name"), "literal"), (f"{BASE}brand", F.col("p_brand"), "literal")),
        *rows(t["orders"], uri("order", "o_orderkey"), typed("order"), (RDF_TYPE, F.concat(F.lit(f"{BASE}type/priority-"), slug(F.col("o_orderpriority"))), "uri"), (f"{BASE}byCustomer", uri("customer", "o_custkey"), "uri")),
        *rows(t["lineitem"], uri("order", "l_orderkey"), (f"{BASE}contains", uri("part", "l_partkey"), "uri"), (f"{BASE}suppliedBy", uri("supplier", "l_suppkey"), "uri")),
        *rows(items, uri("item", "item_id"), typed("item"), (RDF_TYPE, F.concat(F.lit(f"{BASE}type/item-"), F.pmod(F.col("item_id"), F.lit(4)).cast("string")), "uri"), (f"{BASE}related", other(F.col("item_id") * 7 + 3), "uri"), (f"{BASE}related", other(F.col("item_id") + 5), "uri"), (f"{BASE}title", name, "literal"), (f"{BASE}label", label, "literal")),
        *rows(items, other(F.col("item_id") + 1), (f"{BASE}alias", name, "literal")),
    ]
    return reduce(DataFrame.unionAll, parts)


TRIPLES_SQL = rf"""
bench AS (SELECT item_id, regexp_extract_all(text, '\S+') AS w, (SELECT count(*) FROM benchmark) AS n FROM benchmark),
triples AS (
SELECT '{BASE}region/' || r_regionkey AS s, '{RDF_TYPE}' AS p, '{BASE}type/region' AS o, 'uri' AS kind FROM region
UNION ALL SELECT '{BASE}region/' || r_regionkey, '{BASE}name', r_name, 'literal' FROM region
UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{RDF_TYPE}', '{BASE}type/nation', 'uri' FROM nation
UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{BASE}inRegion', '{BASE}region/' || n_regionkey, 'uri' FROM nation
UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{BASE}name', n_name, 'literal' FROM nation
UNION ALL SELECT '{BASE}customer/' || c_custkey, '{RDF_TYPE}', '{BASE}type/customer', 'uri' FROM customer
UNION ALL SELECT '{BASE}customer/' || c_custkey, '{RDF_TYPE}', '{BASE}type/segment-' || regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), 'uri' FROM customer
UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}inNation', '{BASE}nation/' || c_nationkey, 'uri' FROM customer
UNION ALL SELECT '{BASE}customer/' || c_custkey, '{BASE}name', c_name, 'literal' FROM customer
UNION ALL SELECT '{BASE}supplier/' || s_suppkey, '{RDF_TYPE}', '{BASE}type/supplier', 'uri' FROM supplier
UNION ALL SELECT '{BASE}supplier/' || s_suppkey, '{BASE}inNation', '{BASE}nation/' || s_nationkey, 'uri' FROM supplier
UNION ALL SELECT '{BASE}supplier/' || s_suppkey, '{BASE}name', s_name, 'literal' FROM supplier
UNION ALL SELECT '{BASE}part/' || p_partkey, '{RDF_TYPE}', '{BASE}type/part', 'uri' FROM part
UNION ALL SELECT '{BASE}part/' || p_partkey, '{RDF_TYPE}', '{BASE}type/part-' || regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), 'uri' FROM part
UNION ALL SELECT '{BASE}part/' || p_partkey, '{BASE}name', p_name, 'literal' FROM part
UNION ALL SELECT '{BASE}part/' || p_partkey, '{BASE}brand', p_brand, 'literal' FROM part
UNION ALL SELECT '{BASE}order/' || o_orderkey, '{RDF_TYPE}', '{BASE}type/order', 'uri' FROM orders
UNION ALL SELECT '{BASE}order/' || o_orderkey, '{RDF_TYPE}', '{BASE}type/priority-' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), 'uri' FROM orders
UNION ALL SELECT '{BASE}order/' || o_orderkey, '{BASE}byCustomer', '{BASE}customer/' || o_custkey, 'uri' FROM orders
UNION ALL SELECT '{BASE}order/' || l_orderkey, '{BASE}contains', '{BASE}part/' || l_partkey, 'uri' FROM lineitem
UNION ALL SELECT '{BASE}order/' || l_orderkey, '{BASE}suppliedBy', '{BASE}supplier/' || l_suppkey, 'uri' FROM lineitem
UNION ALL SELECT '{BASE}item/' || item_id, '{RDF_TYPE}', '{BASE}type/item', 'uri' FROM bench
UNION ALL SELECT '{BASE}item/' || item_id, '{RDF_TYPE}', '{BASE}type/item-' || (item_id % 4), 'uri' FROM bench
UNION ALL SELECT '{BASE}item/' || item_id, '{BASE}related', '{BASE}item/' || ((item_id * 7 + 3) % n), 'uri' FROM bench
UNION ALL SELECT '{BASE}item/' || item_id, '{BASE}related', '{BASE}item/' || ((item_id + 5) % n), 'uri' FROM bench
UNION ALL SELECT '{BASE}item/' || item_id, '{BASE}title', array_to_string(w[1:2], ' '), 'literal' FROM bench
UNION ALL SELECT '{BASE}item/' || item_id, '{BASE}label', array_to_string(w[1:3], ' '), 'literal' FROM bench
UNION ALL SELECT '{BASE}item/' || ((item_id + 1) % n), '{BASE}alias', array_to_string(w[1:2], ' '), 'literal' FROM bench),
clean AS (SELECT s, p, CASE WHEN kind = 'literal' THEN trim(regexp_replace(o, '[\n\t\\"]', '', 'g')) ELSE o END AS o, kind FROM triples),
ingested AS (SELECT * FROM clean WHERE length(s) <= {URI_LENGTH} AND length(p) <= {URI_LENGTH}
 AND CASE WHEN kind = 'literal' THEN length(o) BETWEEN {LITERAL_LENGTH[0]} AND {LITERAL_LENGTH[1]} ELSE length(o) <= {URI_LENGTH} END)"""


def literal_hash_sql(text: str, k: int = 4) -> str:
    word = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({text}, 1, {k}), ''), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296)"
    return f"(CASE WHEN {word} >= 2147483648 THEN {word} - 4294967296 ELSE {word} END)::INTEGER"
