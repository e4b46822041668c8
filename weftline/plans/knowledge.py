"""Queries over the knowledge base: dictionaries, lookups, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftline.operators.kb import KB_SQL, KnowledgeBase
from weftline.sources.triples import BASE, RDF_TYPE, ingest, literal_hash, literal_hash_sql, repair_uri, star_triples

#: Patterns of structured values in literals.
PATTERNS = {"brand": r"^Brand#[0-9]+$", "code": r"^[A-Za-z]+#[0-9]{9}$", "capitals": r"^[A-Z ]+$", "words": r"^[a-z]+ [a-z]+$"}
_ITEMS = f"{BASE}item/"


def kb(spark, folder) -> KnowledgeBase:
    return KnowledgeBase.of_folder(spark, folder)


def items(k: KnowledgeBase) -> DataFrame:
    return k.resources.where(F.col("uri").startswith(_ITEMS))


def sql(select: str) -> str:
    return f"{KB_SQL}\n{select}"


ITEMS_SQL = f"(SELECT index FROM res_dict WHERE starts_with(uri, '{_ITEMS}'))"


def ingest_filter(spark, folder):
    found = ingest(star_triples(spark, folder))
    return found.groupBy("p", "kind").agg(F.count("*").alias("n"), F.sum(F.length("o")).alias("chars"))


def route_triples(spark, folder):
    k = kb(spark, folder)
    return k.triples.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("p").alias("predicates"))


def uri_repair(spark, folder):
    k = kb(spark, folder)
    return k.literals.select("index", repair_uri(F.col("literal")).alias("uri"))


def literal_hashes(spark, folder):
    k = kb(spark, folder)
    return k.literals.select("literal", literal_hash(F.col("literal")).alias("plain"), F.col("prefix").alias("lowered"))


def relations_counts(spark, folder):
    k = kb(spark, folder)
    return k.relations.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


def exact_literals(spark, folder):
    """Literal to id and back for all names of nations."""
    k = kb(spark, folder)
    names = spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_name").alias("literal"))
    return names.join(k.literals, "literal").select("literal", "index")


def uri_lookup(spark, folder):
    k = kb(spark, folder)
    wanted = spark.read.parquet(f"{folder}/nation.parquet").select(F.concat(F.lit(f"{BASE}nation/"), F.col("n_nationkey").cast("string")).alias("uri"))
    return wanted.join(k.resources, "uri").select("uri", "index")


def out_edges(spark, folder):
    k = kb(spark, folder)
    return k.outgoing(items(k))


def in_edges(spark, folder):
    k = kb(spark, folder)
    return k.incoming(items(k)).orderBy("subject")


def types_of(spark, folder):
    k = kb(spark, folder)
    return k.types_of(items(k))


def sample_instances(spark, folder):
    return kb(spark, folder).sample_instances(20)


def all_types(spark, folder):
    return kb(spark, folder).type_names.select("type")


def clusters(spark, folder):
    return kb(spark, folder).type_clusters.select("cluster").distinct()


def property_type(spark, folder):
    k = kb(spark, folder)
    return k.resources.join(k.property_types, F.col("index") == F.col("predicate"), "left").select("index", F.coalesce("kind", F.lit(0)).alias("kind"))


def datatype_props_of_cluster(spark, folder):
    return kb(spark, folder).coverage_ambiguity.where(F.col("coverage") / F.col("ambiguity") > 0.5).select("cluster", "property")


def connecting_clusters(spark, folder):
    return kb(spark, folder).markov_chain(100).where("probability > 0.1").select("predicate", "subject", "object")


def literal_candidates(spark, folder):
    k = kb(spark, folder)
    hashes = spark.createDataFrame([("re",), ("gree",), ("bran",), ("asia",), ("euro",)], "w string").select(literal_hash(F.col("w")).alias("prefix"))
    return k.literal_candidates(hashes)


def literal_candidates_filtered(spark, folder):
    k = kb(spark, folder)
    return k.literal_candidates(k.literals.select("prefix"), k.property_ids("brand", "title"))


def instance_candidates(spark, folder):
    k = kb(spark, folder)
    pairs = k.symbols.join(k.property_ids("title", "alias"), F.col("predicate") == F.col("index")).select("predicate", "object")
    return k.instance_candidates(pairs)


def db_sort(spark, folder):
    k = kb(spark, folder)
    return k.literals.select(F.substring("literal", 1, 8).alias("cut"), "index").orderBy("cut", "index")


def markov_lookup(spark, folder):
    """The probability of every pair of clusters by every property, 0 where never seen."""
    k = kb(spark, folder)
    c = k.type_clusters.select("cluster").distinct()
    p = k.predicates.where("kind = 'uri'").select("predicate")
    every = c.select(F.col("cluster").alias("subject")).crossJoin(F.broadcast(p)).crossJoin(F.broadcast(c.select(F.col("cluster").alias("object"))))  # of the schema's size
    return every.join(k.markov_chain(100), ["subject", "predicate", "object"], "left").select("subject", "predicate", "object", F.coalesce("probability", F.lit(0.0)).alias("probability"))


def markov_topk(spark, folder):
    k = kb(spark, folder)
    return k.markov_top(k.markov_chain(100), 2)


def subject_cardinality_lookup(spark, folder):
    k = kb(spark, folder)
    return k.property_types.join(k.cardinality("subject"), "predicate", "left").select("predicate", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))


def prefix_candidate_count(spark, folder):
    """Symbols whose literal shares its first k characters with a benchmark title, for k from 1 to 10."""
    k = kb(spark, folder)
    titles = k.literals.join(k.symbols.join(k.property_ids("title"), F.col("predicate") == F.col("index"), "left_semi").select(F.col("object").alias("index")).distinct(), "index", "left_semi")
    ks = spark.range(1, 11).select(F.col("id").cast("int").alias("k"))
    wanted = titles.crossJoin(F.broadcast(ks)).select("k", F.substring("literal", F.lit(1), F.col("k")).alias("cut")).distinct()
    rows = k.symbols.join(k.literals, F.col("object") == F.col("index")).groupBy("literal").agg(F.count("*").alias("n")).crossJoin(F.broadcast(ks)).select("k", F.substring("literal", F.lit(1), F.col("k")).alias("cut"), "n")
    return rows.join(wanted, ["k", "cut"], "left_semi").groupBy("k").agg(F.sum("n").alias("candidates"))


def regex_distribution(spark, folder):
    return kb(spark, folder).regex_distribution(PATTERNS)


def regexes(spark, folder):
    return regex_distribution(spark, folder).select("regex").distinct()


def cond_prob(spark, folder):
    m = kb(spark, folder).type_cooccurrence(50)
    diagonal = m.where("t1 = t2").select(F.col("t1").alias("t2"), F.col("count").alias("own"))
    return m.join(diagonal, "t2").select("t1", "t2", F.when((F.col("count") >= 2) & (F.col("own") >= 2), F.col("count") / F.col("own")).otherwise(0.0).alias("probability"))


def proper_noun_rating(spark, folder):
    k = kb(spark, folder)
    # the share of the literals of each property stands in for a corpus here; spot_property_df has the corpus form
    total = k.symbols.count()
    idf = k.symbols.groupBy(F.col("predicate").alias("property")).agg((F.lit(float(total)) / (F.count("*") + 1)).alias("score"))
    return k.proper_noun_rating(idf)


_REGEX_SQL = "SELECT regex, property, hits / n AS ratio FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS regex, predicate AS property, count(*) AS n, count(*) FILTER (regexp_matches(literal, '{p}')) AS hits FROM (SELECT DISTINCT predicate, literal FROM symbols JOIN lit_dict ON index = object) GROUP BY 2" for name, p in PATTERNS.items()) + ") WHERE hits / n > 0.9"
_COVERAGE_SQL = "coverage AS (SELECT r.object AS cluster, s.predicate AS property, count(DISTINCT s.subject) / avg(h.count) AS coverage FROM relations r JOIN (SELECT DISTINCT cluster FROM type_clusters) c ON c.cluster = r.object JOIN histogram_types h ON h.type = r.object JOIN symbols s ON s.subject = r.subject GROUP BY 1, 2), rated AS (SELECT cluster, property, coverage, avg_references AS ambiguity FROM coverage JOIN ambiguity_symbols ON attribute = property)"
_COOC = "(SELECT a.type AS t1, b.type AS t2, count(*) AS count FROM (SELECT DISTINCT subject FROM (SELECT DISTINCT type, subject FROM types) QUALIFY row_number() OVER (PARTITION BY type ORDER BY subject) <= {n}) s JOIN (SELECT DISTINCT * FROM types) a USING (subject) JOIN (SELECT DISTINCT * FROM types) b USING (subject) GROUP BY 1, 2)"
_CARD = "SELECT predicate, count(DISTINCT {c}) AS count, count(*) AS sum, count(*) / count(DISTINCT {c}) AS ratio FROM relations GROUP BY 1"
_CANDIDATES = "SELECT DISTINCT lower(l.literal) AS lower_literal, l.index AS literal_index, s.predicate, s.belief, l.literal FROM lit_dict l JOIN symbols s ON s.object = l.index"
_REPAIR = "literal"
for _c, _code in (("\\ ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), (r"\\", "%5C"), (r"\^", "%5E"), ("`", "%60"), (r"\{", "%7B"), (r"\|", "%7C"), (r"\}", "%7D")):
    _REPAIR = f"regexp_replace({_REPAIR}, '{_c}', '{_code}', 'g')"

QUERIES = {
    "ingest_filter": (ingest_filter, sql("SELECT p, kind, count(*) AS n, sum(length(o))::BIGINT AS chars FROM ingested GROUP BY 1, 2")),
    "route_triples": (route_triples, sql("SELECT kind, count(*) AS n, count(DISTINCT p) AS predicates FROM ingested GROUP BY 1")),
    "uri_repair": (uri_repair, sql(f"SELECT index, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN u ELSE 'http://' || u END AS uri FROM (SELECT index, {_REPAIR} AS u FROM lit_dict)")),
    "literal_hash": (literal_hashes, sql(f"SELECT literal, {literal_hash_sql('literal')} AS plain, prefix AS lowered FROM lit_dict")),
    "res_dict": (lambda s, f: kb(s, f).resources, sql("SELECT index, uri FROM res_dict")),
    "lit_dict": (lambda s, f: kb(s, f).literals, sql("SELECT index, literal, prefix FROM lit_dict")),
    "encode_relations": (relations_counts, sql("SELECT subject, predicate, object, count(*) AS n FROM relations GROUP BY 1, 2, 3")),
    "encode_symbols": (lambda s, f: kb(s, f).symbols.select("subject", "predicate", "object", "belief"), sql("SELECT subject, predicate, object, belief FROM symbols")),
    "literal_ids": (exact_literals, sql("SELECT literal, index FROM nation JOIN lit_dict ON literal = n_name")),
    "uri_ids": (uri_lookup, sql(f"SELECT uri, index FROM nation JOIN res_dict ON uri = '{BASE}nation/' || n_nationkey")),
    "out_edges": (out_edges, sql(f"SELECT * FROM relations WHERE subject IN {ITEMS_SQL}")),
    "in_edges": (in_edges, sql(f"SELECT * FROM relations WHERE object IN {ITEMS_SQL}")),
    "types_of": (types_of, sql(f"SELECT * FROM types WHERE subject IN {ITEMS_SQL}")),
    "sample_instances": (sample_instances, sql("SELECT type, subject FROM (SELECT DISTINCT * FROM types) QUALIFY row_number() OVER (PARTITION BY type ORDER BY subject) <= 20")),
    "all_types": (all_types, sql("SELECT DISTINCT type FROM types")),
    "clusters": (clusters, sql("SELECT DISTINCT cluster FROM type_clusters")),
    "type_clusters": (lambda s, f: kb(s, f).type_clusters, sql("SELECT * FROM type_clusters")),
    "classifications": (lambda s, f: kb(s, f).classifications, sql("SELECT * FROM classifications")),
    "cluster_of": (lambda s, f: kb(s, f).instance_clusters, sql("SELECT * FROM instance_clusters")),
    "property_type": (property_type, sql("SELECT index, CASE WHEN index IN (SELECT predicate FROM symbols) THEN 1 WHEN index IN (SELECT predicate FROM relations) THEN 2 ELSE 0 END AS kind FROM res_dict")),
    "datatype_props_of_cluster": (datatype_props_of_cluster, sql(f", {_COVERAGE_SQL} SELECT cluster, property FROM rated WHERE coverage / ambiguity > 0.5").replace("\n, ", ",\n")),
    "connecting_clusters": (connecting_clusters, sql("SELECT predicate, subject, object FROM markov_chain WHERE probability > 0.1")),
    "literal_candidates": (literal_candidates, sql(f"{_CANDIDATES} WHERE prefix IN (SELECT {literal_hash_sql('w')} FROM (VALUES ('re'), ('gree'), ('bran'), ('asia'), ('euro')) v(w))")),
    "literal_candidates_filtered": (literal_candidates_filtered, sql(f"{_CANDIDATES} WHERE predicate IN (SELECT index FROM res_dict WHERE uri IN ('{BASE}brand', '{BASE}title'))")),
    "instance_candidates": (instance_candidates, sql(f"SELECT DISTINCT subject, predicate, object, uri FROM symbols JOIN res_dict ON index = subject WHERE predicate IN (SELECT index FROM res_dict WHERE uri IN ('{BASE}title', '{BASE}alias'))")),
    "db_sort": (db_sort, sql("SELECT substr(literal, 1, 8) AS cut, index FROM lit_dict")),
    "markov_chain": (lambda s, f: kb(s, f).markov_chain(100), sql("SELECT * FROM markov_chain")),
    "markov_lookup": (markov_lookup, sql("SELECT c.cluster AS subject, p.predicate, o.cluster AS object, coalesce(probability, 0.0) AS probability FROM (SELECT DISTINCT cluster FROM type_clusters) c, (SELECT DISTINCT predicate FROM relations) p, (SELECT DISTINCT cluster FROM type_clusters) o LEFT JOIN markov_chain m ON m.subject = c.cluster AND m.predicate = p.predicate AND m.object = o.cluster")),
    "markov_topk": (markov_topk, sql("SELECT subject, object, predicate, round(probability, 5) AS weight FROM markov_chain QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY probability DESC, predicate) <= 2")),
    "subject_card": (lambda s, f: kb(s, f).cardinality("subject"), sql(_CARD.format(c="subject"))),
    "object_card": (lambda s, f: kb(s, f).cardinality("object"), sql(_CARD.format(c="object"))),
    "subject_card_lookup": (subject_cardinality_lookup, sql("SELECT p.predicate, coalesce(c.ratio, 0.0) AS ratio FROM (SELECT predicate FROM symbols UNION SELECT predicate FROM relations) p LEFT JOIN (" + _CARD.format(c="subject") + ") c USING (predicate)")),
    "hist_literals": (lambda s, f: kb(s, f).histogram_literals, sql("SELECT * FROM histogram_literals")),
    "ambiguity_symbols": (lambda s, f: kb(s, f).ambiguity, sql("SELECT * FROM ambiguity_symbols")),
    "hist_types": (lambda s, f: kb(s, f).histogram_types, sql("SELECT * FROM histogram_types")),
    "hist_symbols": (lambda s, f: kb(s, f).histogram_symbols, sql("SELECT predicate, count(DISTINCT object) AS count FROM symbols GROUP BY 1")),
    "coverage_ambiguity": (lambda s, f: kb(s, f).coverage_ambiguity, sql(f", {_COVERAGE_SQL} SELECT * FROM rated").replace("\n, ", ",\n")),
    "proper_noun_rating": (proper_noun_rating, sql(f", {_COVERAGE_SQL} SELECT cluster, property, coverage / ambiguity * idf AS rating, coverage, ambiguity, idf FROM rated JOIN (SELECT predicate AS property, (SELECT count(*) FROM symbols)::DOUBLE / (count(*) + 1) AS idf FROM symbols GROUP BY 1) USING (property)").replace("\n, ", ",\n")),
    "regex_distribution": (regex_distribution, sql(_REGEX_SQL)),
    "regexes": (regexes, sql(f"SELECT DISTINCT regex FROM ({_REGEX_SQL})")),
    "type_cooccurrence": (lambda s, f: kb(s, f).type_cooccurrence(50), sql(f"SELECT * FROM {_COOC.format(n=50)}")),
    "cond_prob": (cond_prob, sql(f"SELECT m.t1, m.t2, CASE WHEN m.count >= 2 AND d.count >= 2 THEN m.count / d.count ELSE 0.0 END AS probability FROM {_COOC.format(n=50)} m JOIN {_COOC.format(n=50)} d ON d.t1 = m.t2 AND d.t2 = m.t2")),
    "literal_length_hist": (lambda s, f: kb(s, f).literal_lengths, sql("SELECT length(literal) AS length, count(*) AS count FROM lit_dict GROUP BY 1")),
    "prefix_candidate_count": (prefix_candidate_count, sql(f"SELECT k::INTEGER AS k, count(*) AS candidates FROM range(1, 11) r(k), symbols s JOIN lit_dict l ON l.index = s.object WHERE substr(l.literal, 1, k::INTEGER) IN (SELECT substr(t.literal, 1, k::INTEGER) FROM symbols ts JOIN lit_dict t ON t.index = ts.object WHERE ts.predicate = (SELECT index FROM res_dict WHERE uri = '{BASE}title')) GROUP BY 1")),
}
