"""Queries on matrices, clusters, labelled text, templates and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftline.functions import text
from weftline.operators import evaluation, features, matrix, sinks, templates
from weftline.plans.context import Context
from weftline.plans.knowledge import _COOC, kb, sql
from weftline.session import materialize, table
from weftline.sources import corpus, triples

TEMPLATE = """PREFIX ex: <http://ex/>
SELECT * FROM NAMED <http://ex/kb#recognized>
WHERE { GRAPH <http://ex/kb#recognized> { ?s ex:title ?o . ?s ex:inNation ?n ; a <http://ex/type/supplier> . <http://ex/item/1> ex:label "ASIA" } }"""


def shipments(spark, folder) -> DataFrame:
    """row (nation of the supplier), col (brand number), value (orders): a matrix of real data."""
    line = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey")
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("row"))
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("col"))
    counted = line.join(supplier, "l_suppkey").join(part, "l_partkey").groupBy("row", "col").agg(F.count("*").alias("n"))
    return counted.select("row", "col", F.col("n").cast("double").alias("value"))


_M = "m AS (SELECT s_nationkey AS row, regexp_extract(p_brand, '[0-9]+')::INTEGER AS col, count(*)::DOUBLE AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"
_DENSE = f"WITH {_M}, d AS (SELECT r.row, c.col, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT row FROM m) r, (SELECT DISTINCT col FROM m) c LEFT JOIN m ON m.row = r.row AND m.col = c.col)"
_COS = f"{_DENSE}, cs AS (SELECT a.row AS c1, b.row AS c2, CASE WHEN a.row = b.row THEN 1.0 ELSE sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))) END AS cosine FROM d a JOIN d b USING (col) GROUP BY 1, 2, a.row, b.row HAVING sum(a.value * b.value) > 0)"


def _rounded(df: DataFrame, name: str, digits: int = 6) -> DataFrame:
    return df.withColumn(name, F.round(name, digits) + 0.0)  # no negative zero


def cooccurrence(spark, folder) -> DataFrame:
    return kb(spark, folder).type_cooccurrence(50).select(F.col("t1").alias("row"), F.col("t2").alias("col"), F.col("count").cast("double").alias("value"))


def correlations(spark, folder) -> DataFrame:
    return matrix.pearson(cooccurrence(spark, folder))


def type_clustering(spark, folder):
    """Clusters of correlated types, with a label; types left alone are their own cluster."""
    return kb(spark, folder).correlated_clusters(50, 0.5)


def clustering_quality(spark, folder):
    k = kb(spark, folder)
    truth = k.type_clusters.select(F.col("type").alias("item"), F.col("cluster").alias("concept"))
    return evaluation.cluster_quality(type_clustering(spark, folder).select(F.col("type").alias("item"), "cluster"), truth)


def label_clusters(spark, folder):
    k = kb(spark, folder)
    clusters = k.type_clusters.select(F.col("type").alias("item"), "cluster")
    return matrix.label_clusters(clusters, matrix.conditional(cooccurrence(spark, folder)).select("a", "b", "probability"))


def clipped(spark, folder):
    return _rounded(evaluation.clipped_mean(matrix.pearson(shipments(spark, folder)), ["c1"]), "mean")


def matrix_lines(spark, folder):
    m = matrix.cosine_rows(shipments(spark, folder)).select(F.col("c1").alias("row"), F.col("c2").alias("col"), F.round("cosine", 6).alias("value"))
    return sinks.matrix_tsv(m)


def labelled(spark, folder) -> DataFrame:
    """Words of the documents with labels: numbers QUANTITY, capitalised words inside a sentence NAME."""
    t = Context.of(spark, folder).chunked
    return t.select("doc_id", "sent", "i", F.col("token").alias("word"), "pos", "np", _label().alias("label"))


def _label() -> Column:
    return F.when(F.col("pos") == "CD", "QUANTITY").when((F.col("pos") == "NNP") & (F.col("i") > 0), "NAME").otherwise("O")


def _label_of(pos: str, i: int) -> str:
    return "QUANTITY" if pos == "CD" else "NAME" if pos == "NNP" and i > 0 else "O"


def examples(spark, folder):
    return features.examples(labelled(spark, folder))


def context(spark, folder):
    rows = example_rows(spark, folder)
    return rows.select("doc_id", "sent", "lower", "upper", "label", F.array_join("features", " ").alias("features"))


def example_rows(spark, folder):
    return features.text_examples(Context.of(spark, folder).docs, _label_of)


def corefs(spark, folder):
    words = labelled(spark, folder)
    return features.coreference(words, features.examples(words))


def feature_lines(spark, folder):
    return features.serialize(example_rows(spark, folder))


def stop_lists(spark, folder):
    return features.stop_features(example_rows(spark, folder), 20, 2)


def top_weights(spark, folder):
    return features.top_features(features.train_weights(example_rows(spark, folder)), 10)


def classified(spark, folder):
    found = features.judge(materialize(example_rows(spark, folder)))
    return found.select("doc_id", "sent", "lower", "best", F.round("p1", 6).alias("p1"), F.round("p2", 6).alias("p2"), "accepted")


def cross_validated(spark, folder):
    return features.fold_scores(materialize(example_rows(spark, folder)), folds=3)


def labelled_corpus(spark, folder):
    """What ``sinks.labelled_lines`` makes of the labelled words, text by text."""

    def lines(rows):
        found = []
        for (_, _, word, sent, pos, np, i) in rows:
            if i == 0:
                found.append([sent, ""])
            found[-1][1] += f"{word} {pos} {np} {_label_of(pos, i)}\n"
        return [(sent, lines + "\n") for sent, lines in found]

    return text.per_text(Context.of(spark, folder).docs, lines, "sent int, text string")


def template_filters(spark, folder):
    return templates.Filters(templates.parse(TEMPLATE), kb(spark, folder)).names()


def template_infer(spark, folder):
    k = kb(spark, folder)
    f = templates.Filters(templates.parse(TEMPLATE), k)
    ratings = k.coverage_ambiguity.select("cluster", "property", (F.col("coverage") / F.col("ambiguity")).alias("rating"))
    return f.names(f.infer(0.001, 0.5, k.markov_chain(100), ratings))


def template_candidates(spark, folder):
    """Literal candidates of a template's datatype properties only."""
    k = kb(spark, folder)
    f = templates.Filters(templates.parse(TEMPLATE), k)
    return k.literal_candidates(k.literals.select("prefix"), f.of("datatype property"))


def graph_uris(spark, folder):
    return table(spark, folder, "documents").select("doc_id", templates.graph_uri("http://ex/ie", "kb one", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), "recognized").alias("uri"))


def conll_lines(spark, folder) -> DataFrame:
    """Lines of a CoNLL file made of the documents: a marker, then a line for each word, and an empty one behind each sentence.

    n grows along a file; it leaves gaps between documents (for up to 2^28 lines each).
    """

    def lines(rows):
        if not rows:
            return []
        found = ["-DOCSTART- -X- O O"]
        for (_, _, word, sent, pos, np, i) in rows:
            if i == 0 and len(found) > 1:
                found.append("")
            found.append(f"{word} {pos} {np} {_label_of(pos, i)}")
        return enumerate([*found, ""])

    every = text.per_text(Context.of(spark, folder).docs, lambda rows: list(lines(rows)), "k int, line string")
    return every.select(F.concat(F.lit("part-"), F.pmod("doc_id", F.lit(8)).cast("string")).alias("file"), (F.shiftleft("doc_id", 28) + F.col("k")).alias("n"), "line")


def conll_scan(spark, folder):
    return corpus.conll_documents(conll_lines(spark, folder)).groupBy("file", "doc").agg(F.count("*").alias("n"))


def conll_text(spark, folder):
    return corpus.conll_text(corpus.conll_documents(conll_lines(spark, folder)))


def conll_words(spark, folder):
    found = corpus.conll_words(corpus.conll_documents(conll_lines(spark, folder)))
    return found.groupBy("label", "pos").agg(F.count("*").alias("n"))


def link_labels(spark, folder):
    """Links quoted in pages."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return corpus.labels_from_links(pages, r'href="(/[^"/]+)"')


def triple_labels(spark, folder):
    t = kb(spark, folder).triples.withColumn("p", F.when(F.col("p") == "http://ex/name", corpus.LABEL_PREDICATES["nature"][0]).otherwise(F.col("p")))
    return corpus.labels_from_triples(t, "nature")


def taxonomy(spark, folder) -> DataFrame:
    """sub, super: all pairs that subclass steps reach; steps are types to clusters, and clusters to a root by rounds of joins."""
    k = kb(spark, folder)
    root = k.uri_index(triples.RDF_TYPE)
    steps = k.type_clusters.where("type <> cluster").select(F.col("type").alias("sub"), F.col("cluster").alias("super")).unionAll(k.type_clusters.select(F.col("cluster").alias("sub")).distinct().select("sub", F.lit(root).alias("super")))
    from weftline.session import materialize

    reached = materialize(steps.distinct())
    while True:
        more = materialize(reached.unionAll(reached.select("sub", F.col("super").alias("mid")).join(steps.select(F.col("sub").alias("mid"), "super"), "mid").select("sub", "super")).distinct())
        if more.count() == reached.count():
            return more
        reached = more


def ntriples_parse(spark, folder):
    """The knowledge base written as N-Triples lines and read again."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"@en'))
    line = F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), F.when(F.col("kind") == "literal", quoted).otherwise(F.concat(F.lit("<"), "o", F.lit(">"))), F.lit(" ."))
    return triples.parse_ntriples(kb(spark, folder).triples.select(line.alias("value"))).groupBy("p", "kind").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


_EX = "ex AS (SELECT doc_id, sent, label, min(i)::INTEGER AS lower, max(i)::INTEGER AS upper FROM (SELECT *, sum(st::INT) OVER (PARTITION BY doc_id, sent ORDER BY i) AS run FROM (SELECT *, coalesce(lag(label) OVER (PARTITION BY doc_id, sent ORDER BY i) <> label, true) AS st FROM lab)) WHERE label <> 'O' GROUP BY doc_id, sent, run, label)"
from weftline.plans.corpus import NP_SQL  # noqa: E402

_LAB = f"{NP_SQL}, lab AS (SELECT doc_id, sent, i, token AS word, pos, np, CASE WHEN pos = 'CD' THEN 'QUANTITY' WHEN pos = 'NNP' AND i > 0 THEN 'NAME' ELSE 'O' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent ORDER BY start) - 1 AS i FROM np)), {_EX}"
_SHAPE = "CASE " + " ".join(f"WHEN regexp_matches(word, '^(?:{p.replace(chr(39), chr(39) * 2)})$') THEN '{name}'" for name, p in reversed(text.SHAPES)) + " ELSE word END"
_GRAM = "CASE WHEN len({s}) > 0 THEN list_transform(range(1, len({s}) - least(len({s}), {n}) + 2), lambda k: '{s}:' || array_to_string({s}[k:k + least(len({s}), {n}) - 1], ',')) ELSE [] END"
_FEATURES = f"""{_LAB}, shaped AS (SELECT *, {_SHAPE} AS shape FROM lab),
said AS (SELECT e.doc_id, e.sent, e.lower, e.upper, e.label, s.i,
 CASE WHEN s.i < e.lower AND e.lower - s.i < 4 THEN 'a' WHEN s.i > e.upper AND s.i - e.upper < 4 THEN 'p' WHEN s.i BETWEEN e.lower AND e.upper THEN 'i' END AS side,
 CASE WHEN s.i BETWEEN e.lower AND e.upper THEN CASE WHEN shape = word AND length(word) > 3 THEN ['s:' || right(word, 3), word] ELSE [shape] END WHEN s.label <> 'O' THEN [s.label] WHEN substr(s.pos, 1, 2) IN ({', '.join(repr(t) for t in features.CONTENT_TAGS)}) THEN [shape] ELSE [] END AS f
 FROM ex e JOIN shaped s ON s.doc_id = e.doc_id AND s.sent = e.sent),
sides AS (SELECT doc_id, sent, lower, upper, label, {', '.join(f"coalesce(flatten(list(f ORDER BY i) FILTER (side = '{x}')), []) AS {x}" for x in 'api')} FROM said GROUP BY ALL),
feats AS (SELECT doc_id, sent, lower, upper, label, flatten([{', '.join(_GRAM.format(s=x, n=n) for n in (1, 2, 3) for x in 'ap')}, {_GRAM.format(s='i', n=1)}]) AS features FROM sides),
fcounts AS (SELECT label, feature, count(*) AS n FROM (SELECT label, unnest(features) AS feature FROM feats) GROUP BY 1, 2),
ftotals AS (SELECT label, sum(n) AS t, (SELECT count(DISTINCT feature) FROM fcounts) AS v FROM fcounts GROUP BY 1)"""
_CLASSIFIED = """, special AS (SELECT t.label, ln(count(*) / (SELECT count(*) FROM feats)) AS prior, ln(1 / (any_value(t) + any_value(v))) AS unseen FROM feats f JOIN ftotals t USING (label) GROUP BY 1),
asked AS (SELECT doc_id, sent, lower, unnest(CASE WHEN len(features) = 0 THEN [NULL] ELSE features END) AS feature FROM feats),
summed AS (SELECT a.doc_id, a.sent, a.lower, s.label, any_value(s.prior) + sum(coalesce(ln((c.n + 1) / (t.t + t.v)), s.unseen)) AS s FROM asked a CROSS JOIN special s JOIN ftotals t USING (label) LEFT JOIN fcounts c ON c.label = s.label AND c.feature = a.feature GROUP BY 1, 2, 3, 4),
soft AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id, sent, lower) AS p FROM (SELECT *, exp(s - max(s) OVER (PARTITION BY doc_id, sent, lower)) AS e FROM summed)),
placed2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sent, lower ORDER BY p DESC, label) AS rank FROM soft),
best AS (SELECT doc_id, sent, lower, max(label) FILTER (rank = 1) AS best, max(p) FILTER (rank = 1) AS p1, coalesce(max(p) FILTER (rank = 2), 0.0) AS p2 FROM placed2 GROUP BY 1, 2, 3)
SELECT doc_id, sent, lower, best, round(p1, 6) AS p1, round(p2, 6) AS p2, p1 - p2 > 0.6 AS accepted FROM best"""
_CONLL = f"{_LAB}, filed AS (SELECT *, 'part-' || (doc_id % 8) AS file, dense_rank() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS doc FROM lab)"
_COND = f"cm AS (SELECT * FROM {_COOC.format(n=50)}), cp AS (SELECT m.t1 AS a, m.t2 AS b, m.count / d.count AS probability FROM cm m JOIN cm d ON d.t1 = m.t2 AND d.t2 = m.t2)"

QUERIES = {
    "matrix": (shipments, f"WITH {_M} SELECT * FROM m"),
    "matrix_dense": (lambda s, f: matrix.dense(shipments(s, f)), f"{_DENSE} SELECT * FROM d"),
    "matrix_stats": (lambda s, f: matrix.column_stats(shipments(s, f)).select("col", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")), f"{_DENSE} SELECT col, count(*)::DOUBLE AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM d GROUP BY 1"),
    "covariance": (lambda s, f: _rounded(matrix.covariance(shipments(s, f)), "covariance", 5), f"{_DENSE} SELECT a.col AS c1, b.col AS c2, round(covar_pop(a.value, b.value), 5) + 0.0 AS covariance FROM d a JOIN d b USING (row) GROUP BY 1, 2"),
    "pearson": (lambda s, f: _rounded(matrix.pearson(shipments(s, f)), "correlation"), f"{_DENSE} SELECT a.col AS c1, b.col AS c2, round(corr(a.value, b.value), 6) + 0.0 AS correlation FROM d a JOIN d b USING (row) GROUP BY 1, 2"),
    "spearman": (lambda s, f: _rounded(matrix.spearman(shipments(s, f)), "correlation"), f"{_DENSE}, k AS (SELECT row, col, rank() OVER (PARTITION BY col ORDER BY value DESC)::DOUBLE AS value FROM d) SELECT a.col AS c1, b.col AS c2, round(corr(a.value, b.value), 6) + 0.0 AS correlation FROM k a JOIN k b USING (row) GROUP BY 1, 2"),
    "cosine_rows": (lambda s, f: _rounded(matrix.cosine_rows(shipments(s, f)), "cosine"), f"{_COS} SELECT c1, c2, round(cosine, 6) AS cosine FROM cs"),
    "cosine_restricted": (lambda s, f: _rounded(matrix.cosine_restricted(shipments(s, f), [1, 2]), "cosine"), f"{_COS} SELECT c1, c2, round(cosine, 6) AS cosine FROM cs WHERE EXISTS (SELECT 1 FROM m a JOIN m b USING (col) WHERE a.row = c1 AND b.row = c2 AND col IN (1, 2))"),
    "predict_cosine": (lambda s, f: _rounded(matrix.predict_by_similarity(shipments(s, f), matrix.cosine_rows(shipments(s, f))), "value", 4), f"{_COS} SELECT d.row, d.col, round(CASE WHEN d.value <> 0 THEN d.value ELSE (SELECT sum(cosine * e.value) FROM cs JOIN d e ON e.row = c2 AND e.col = d.col WHERE c1 = d.row AND c2 <> d.row AND e.value <> 0) END, 4) AS value FROM d WHERE d.value <> 0 OR EXISTS (SELECT 1 FROM d e JOIN cs ON c1 = d.row AND c2 = e.row WHERE e.col = d.col AND e.row <> d.row AND e.value <> 0)"),
    "significance": (lambda s, f: _rounded(matrix.significance(cooccurrence(s, f), 1000.0), "significance", 6), sql(f", {_COND}, sg AS (SELECT m.t1 AS a, m.t2 AS b, c1.count * c2.count / 1000.0 AS mean, m.count + 1 AS k FROM cm m JOIN cm c1 ON c1.t1 = m.t1 AND c1.t2 = m.t1 JOIN cm c2 ON c2.t1 = m.t2 AND c2.t2 = m.t2) SELECT a, b, round(-(-any_value(mean) + (any_value(k) + 1) * ln(any_value(mean)) - lgamma(any_value(k) + 2) + ln(sum(exp(j * ln(mean) - lgamma(k + 2 + j) + lgamma(k + 2))))), 6) + 0.0 AS significance FROM sg, range(400) t(j) GROUP BY 1, 2").replace("\n, ", ",\n")),
    "conditional_matrix": (lambda s, f: matrix.conditional(cooccurrence(s, f)), sql(f", {_COND} SELECT a, b, probability FROM cp").replace("\n, ", ",\n")),
    "type_correlation": (lambda s, f: _rounded(correlations(s, f), "correlation"), sql(f", {_COND}, dd AS (SELECT r.t AS row, c.t AS col, coalesce(m.count, 0)::DOUBLE AS value FROM (SELECT DISTINCT t1 AS t FROM cm) r CROSS JOIN (SELECT DISTINCT t2 AS t FROM cm) c LEFT JOIN cm m ON m.t1 = r.t AND m.t2 = c.t) SELECT a.col AS c1, b.col AS c2, round(corr(a.value, b.value), 6) + 0.0 AS correlation FROM dd a JOIN dd b USING (row) GROUP BY 1, 2").replace("\n, ", ",\n")),
    "hierarchical_clusters": (lambda s, f: matrix.hierarchical(correlations(s, f), 0.5), None),
    "cluster_types": (type_clustering, None),
    "clustering_quality": (clustering_quality, None),
    "label_clusters": (label_clusters, sql(f", {_COND}, sc AS (SELECT t.cluster, p.a AS k, sum(p.probability) / any_value(z.n) * (sum(coalesce(q.probability, 0)) / any_value(z.n)) AS score FROM type_clusters t JOIN cp p ON p.b = t.type LEFT JOIN cp q ON q.a = t.type AND q.b = p.a JOIN (SELECT cluster, count(*) AS n FROM type_clusters GROUP BY 1) z ON z.cluster = t.cluster GROUP BY 1, 2) SELECT cluster, k AS label FROM sc LEFT JOIN (SELECT cluster, type AS k, 1 AS inside FROM type_clusters) USING (cluster, k) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, coalesce(inside, 0) DESC, k) = 1").replace("\n, ", ",\n")),
    "pca": (lambda s, f: _rounded(matrix.pca(shipments(s, f)), "value", 4), None),
    "clipped_correlations": (clipped, f"{_DENSE}, r AS (SELECT a.col AS c1, b.col AS c2, corr(a.value, b.value) AS v FROM d a JOIN d b USING (row) GROUP BY 1, 2) SELECT c1, round(avg(CASE WHEN v IS NULL OR isnan(v) OR v < 0.001 THEN 0.0 WHEN v > 1 THEN 1.0 ELSE v END), 6) AS mean FROM r GROUP BY 1"),
    "matrix_tsv": (matrix_lines, f"{_COS}, names AS (SELECT DISTINCT c1 AS name FROM cs UNION SELECT c2 FROM cs) SELECT 0 AS n, chr(9) || string_agg(name::VARCHAR, chr(9) ORDER BY name) AS line FROM names UNION ALL SELECT row_number() OVER (ORDER BY name)::INTEGER, line FROM (SELECT r.name, r.name || chr(9) || string_agg(printf('%.2f', coalesce(round(cosine, 6), 0.0)), chr(9) ORDER BY c.name) AS line FROM names r CROSS JOIN names c LEFT JOIN cs ON c1 = r.name AND c2 = c.name GROUP BY 1)"),
    "labelled_corpus": (labelled_corpus, f"{_LAB} SELECT doc_id, sent, string_agg(word || ' ' || pos || ' ' || np || ' ' || label, chr(10) ORDER BY i) || chr(10) || chr(10) AS text FROM lab GROUP BY 1, 2"),
    "examples": (examples, f"{_LAB} SELECT * FROM ex"),
    "coreference": (corefs, f"{_LAB} SELECT w.doc_id, w.sent, 0 AS lower, 0 AS upper, arg_max(e.label, e.upper) AS label FROM lab w JOIN ex e ON e.doc_id = w.doc_id AND e.sent + 1 = w.sent WHERE w.i = 0 AND starts_with(w.pos, 'PRP') GROUP BY 1, 2"),
    "context_features": (context, f"{_FEATURES} SELECT doc_id, sent, lower, upper, label, array_to_string(features, ' ') AS features FROM feats"),
    "feature_lines": (feature_lines, f"{_FEATURES} SELECT concat_ws(' ', doc_id || '-' || sent || '-' || lower, label, nullif(array_to_string(features, ' '), '')) AS line FROM feats"),
    "stop_features": (stop_lists, f"{_FEATURES}, every AS (SELECT feature, sum(n)::BIGINT AS n FROM fcounts GROUP BY 1) SELECT * FROM (SELECT feature, n, 'stop' AS list FROM every ORDER BY n DESC, feature LIMIT 20) UNION ALL SELECT feature, n, 'pruned' FROM every WHERE n < 2"),
    "top_features": (top_weights, f"{_FEATURES} SELECT label, rank::INTEGER AS rank, feature FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, feature) AS rank FROM fcounts) WHERE rank <= 10"),
    "classify_entities": (classified, f"{_FEATURES}{_CLASSIFIED}"),
    "cross_validation": (cross_validated, None),
    "template_filters": (template_filters, sql("SELECT 'datatype property' AS role, 'http://ex/title' AS name UNION ALL SELECT 'datatype property', 'http://ex/label' UNION ALL SELECT 'object property', 'http://ex/inNation' UNION ALL SELECT 'type', 'http://ex/type/supplier' UNION ALL SELECT 'subject', 'http://ex/item/1' UNION ALL SELECT 'literal', 'ASIA'")),
    "template_infer": (template_infer, None),
    "template_candidates": (template_candidates, sql("SELECT DISTINCT lower(l.literal) AS lower_literal, l.index AS literal_index, s.predicate, s.belief, l.literal FROM lit_dict l JOIN symbols s ON s.object = l.index WHERE predicate IN (SELECT index FROM res_dict WHERE uri IN ('http://ex/title', 'http://ex/label'))")),
    "graph_uris": (graph_uris, "SELECT doc_id, 'http://ex/ie?graph=kb+one&doc=doc%2F' || doc_id || '#recognized' AS uri FROM documents"),
    "conll_scan": (conll_scan, f"{_CONLL} SELECT file, doc, count(*) + count(DISTINCT sent) AS n FROM filed GROUP BY 1, 2"),
    "conll_text": (conll_text, f"{_CONLL} SELECT file, doc, string_agg(line, '' ORDER BY sent) AS text FROM (SELECT file, doc, sent, string_agg(word || ' ', '' ORDER BY i) || chr(10) AS line FROM filed GROUP BY 1, 2, 3) GROUP BY 1, 2"),
    "conll_words": (conll_words, f"{_CONLL} SELECT label, pos, count(*) AS n FROM filed GROUP BY 1, 2"),
    "link_labels": (link_labels, "SELECT page_id AS doc_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"/]+)\"', 1)) AS label FROM pages"),
    "triple_labels": (triple_labels, sql("SELECT s, o FROM ingested WHERE p = 'http://ex/name'")),
    "taxonomy": (taxonomy, sql(", steps AS (SELECT type AS sub, cluster AS super FROM type_clusters WHERE type <> cluster UNION SELECT cluster, (SELECT index FROM rdf_type) FROM type_clusters), closure(sub, super) AS (SELECT sub, super FROM steps UNION SELECT c.sub, s.super FROM closure c JOIN steps s ON s.sub = c.super) SELECT DISTINCT sub, super FROM closure").replace("\n, ", ",\n")),
    "ntriples_parse": (ntriples_parse, sql("SELECT p, kind, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM ingested GROUP BY 1, 2")),
}
