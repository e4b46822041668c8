"""Serialisations as DataFrames of lines or texts; ``save`` writes any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from weftline.functions.filters import likely
from weftline.operators.kb import KnowledgeBase
from weftline.session import materialize
from weftline.sources.triples import RDF_TYPE


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a DataFrame: parquet, csv (quoted) or text (one string column)."""
    writer = df.write.mode("overwrite")
    writer.option("quote", '"').option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def quads(found: DataFrame, facts: DataFrame, predicted: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc_id, g, s, p, o, distinct: what was recognised, what is known and what is predicted."""
    text = found.select("doc_id", "subject", F.col("property").alias("predicate"), F.col("surface").alias("o")).distinct()
    own = found.select(F.col("subject").alias("index"))
    text = text.join(kb.named(own).select(F.col("index").alias("subject"), F.col("uri").alias("s")), "subject").join(kb.property_names.withColumnRenamed("uri", "p"), "predicate")
    recognised = text.select("doc_id", F.lit("recognized").alias("g"), "s", "p", F.concat(F.lit('"'), "o", F.lit('"@en')).alias("o"))
    types = found.select("doc_id", "subject").distinct().join(kb.types_of(own).distinct(), "subject").withColumnRenamed("type", "object")
    typed = named(types.withColumn("g", F.lit("recognized")), kb, RDF_TYPE)
    rows = [recognised, typed, named(facts.withColumn("g", F.lit("known")), kb), named(predicted.withColumn("g", F.lit("predicted")), kb)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out.distinct()


def named(edges: DataFrame, kb: KnowledgeBase, predicate: str | None = None) -> DataFrame:
    uri = materialize(kb.named(edges.select(F.col("subject").alias("index")).unionAll(edges.select("object"))))
    both = edges.join(uri.select(F.col("index").alias("subject"), F.col("uri").alias("s")), "subject").join(uri.select(F.col("index").alias("object"), F.col("uri").alias("o")), "object")
    if predicate:
        return both.select("doc_id", "g", "s", F.lit(predicate).alias("p"), "o")
    return both.join(kb.property_names.withColumnRenamed("uri", "p"), "predicate").select("doc_id", "g", "s", "p", "o")


def trig(rows: DataFrame) -> DataFrame:
    """line: one statement in N-Quads form for each quad."""
    term = lambda c: F.when(F.col(c).startswith('"'), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    return rows.select(F.concat_ws(" ", term("s"), term("p"), term("o"), F.concat(F.lit("<doc:"), F.col("doc_id").cast("string"), F.lit("#"), "g", F.lit(">")), F.lit(".")).alias("line"))


def rdfa(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, xhtml: text with a span around each marked token (doc_id, start, end, about, property).

    A token with several marks has the first by property and about. A document's pieces between marks are cut from its
    text by the array of its marks, so the text is joined once and never exploded; texts without marks are not dealt.
    """
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    first = marks.groupBy("doc_id", "start", "end").agg(F.min(F.struct("property", "about")).alias("m"))
    spans = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("m.about").alias("about"), F.col("m.property").alias("property")))).alias("spans"))
    spans, docs = materialize(spans), docs.select("doc_id", "text")
    marked = likely(docs, ["doc_id"], spans.select("doc_id")).join(spans, "doc_id", "left")
    plain = likely(docs, ["doc_id"], spans.select("doc_id"), keep=False)
    joined = marked.unionAll(plain.select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))
    text = F.col("text")
    built = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,about:string,property:string>>")),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], esc(F.substring(text, a["at"] + 1, s["start"] - a["at"])), F.lit('<span about="'), s["about"], F.lit('" property="'), s["property"], F.lit('">'), esc(F.substring(text, s["start"] + 1, s["end"] - s["start"])), F.lit("</span>")).alias("out"),
            s["end"].alias("at"),
        ),
    )
    title = F.concat(esc(F.substring("text", 1, 20)), F.lit("..."))
    body = F.concat(built["out"], esc(F.substring(text, built["at"] + 1, F.length(text))))
    return joined.select("doc_id", F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), body, F.lit("</body></html>")).alias("xhtml"))


def dot(edges: DataFrame, directed: bool = True) -> DataFrame:
    """doc_id, line: edges (doc_id, src, dst, label) as DOT lines, with the opening and closing line by order ``n``."""
    arrow = "->" if directed else "--"
    body = edges.select("doc_id", F.lit(1).alias("n"), F.format_string('  "%s" ' + arrow + ' "%s" [label="%s"];', "src", "dst", "label").alias("line"))
    docs = edges.select("doc_id").distinct()
    head = docs.select("doc_id", F.lit(0).alias("n"), F.lit("digraph {" if directed else "graph {").alias("line"))
    return head.unionAll(body).unionAll(docs.select("doc_id", F.lit(2).alias("n"), F.lit("}").alias("line")))


def matrix_tsv(m: DataFrame) -> DataFrame:
    """line, n: a square matrix (row, col, value) with its names, values with two decimals; row 0 is the header."""
    names = m.select(F.col("col").alias("name")).union(m.select("row")).distinct()
    header = names.agg(F.array_sort(F.collect_list("name")).alias("names"))  # of the schema's size
    cells = m.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    every = names.withColumnRenamed("name", "row").join(cells, "row", "left").crossJoin(F.broadcast(header))
    values = F.transform("names", lambda n: F.format_string("%.2f", F.coalesce(F.try_element_at("m", n), F.lit(0.0))))
    rows = every.select(F.array_position("names", F.col("row")).cast("int").alias("n"), F.concat_ws("\t", F.col("row").cast("string"), values).alias("line"))
    return header.select(F.lit(0).alias("n"), F.concat_ws("\t", F.lit(""), F.transform("names", lambda n: n.cast("string"))).alias("line")).unionAll(rows)


def labelled_lines(words: DataFrame) -> DataFrame:
    """doc_id, sent, text: ``word pos np label`` lines of each sentence, with an empty line at its end."""
    line = F.concat_ws(" ", "word", "pos", "np", "label")
    lines = words.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("l")))).alias("l"))
    return lines.select("doc_id", "sent", F.concat(F.array_join(F.transform("l", lambda x: x["l"]), "\n"), F.lit("\n\n")).alias("text"))


def linked_json(found: DataFrame, kb: KnowledgeBase) -> DataFrame:
    """doc_id, uri, json: a subject's literal properties as an object, names in words; for surfaces that are no numbers."""
    wanted = found.where(~F.col("surface").rlike(r"^[0-9.,]+$")).select("doc_id", "subject", "uri").distinct()
    name = F.lower(F.regexp_replace(F.regexp_extract("uri", r"[^/#]*$", 0), r"(\p{Ll})(\p{Lu})", "$1 $2"))
    names = F.broadcast(kb.property_names.select("predicate", name.alias("name")))  # one row for each property of the schema
    wanted = materialize(wanted)
    # only the literals of the subjects asked for are dealt
    values = likely(kb.symbols, ["subject"], wanted.select("subject")).join(wanted.select("subject").distinct(), "subject", "left_semi")
    values = materialize(values.join(names, "predicate").select("subject", "name", "object"))
    texts = likely(kb.literals, ["index"], values.select("object")).select(F.col("index").alias("object"), "literal")
    values = values.join(texts, "object")
    listed = values.groupBy("subject", "name").agg(F.array_sort(F.collect_list("literal")).alias("v"))
    whole = listed.groupBy("subject").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v"))))).alias("json"))
    return wanted.join(whole, "subject").select("doc_id", "uri", "json")
