"""Hand-made fixtures with expected values."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import evaluation, linking, matrix, rating, sinks, spotting, templates
from weftline.operators.kb import KnowledgeBase
from weftline.sources import corpus, triples
from weftline.sources.turtle import read_turtle

TURTLE = """@prefix ex-ins: <http://example.org/instance#> . @prefix ex-ont: <http://example.org/ontology#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
ex-ins:Percy_Jackson rdfs:label "Percy Jackson"@en ; a ex-ont:Person ; ex-ont:livesIn ex-ins:Camp_Halfblood .
ex-ins:Camp_Halfblood rdfs:label "Camp Halfblood" ; a ex-ont:Place . # a comment
"""
MATRIX = ["1001101", "0010011", "0100000", "1000000"]


@pytest.fixture(scope="module")
def small(spark):
    rows = triples.parse_turtle(spark.createDataFrame([(TURTLE,)], "text string"))
    return KnowledgeBase(triples.ingest(rows))


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, j, 1.0) for i, r in enumerate(MATRIX) for j, c in enumerate(r) if c == "1"], "row int, col int, value double")


def test_load(small):
    assert small.literals.count() == 2 and small.resources.count() == 7
    assert small.relations.count() == 3 and small.symbols.count() == 2
    assert {r["literal"]: r["prefix"] for r in small.literals.collect()} == {"Camp Halfblood": 3046017, "Percy Jackson": 3437286}
    assert [r["index"] for r in small.resources.orderBy("uri").collect()] == list(range(1, 8))
    assert {r["count"] for r in small.histogram_literals.collect()} == {1}
    assert {r["count"] for r in small.histogram_types.collect()} == {1}
    assert small.histogram_symbols.head()["count"] == 2
    card = {r["predicate"]: (r["count"], r["sum"], r["ratio"]) for r in small.cardinality("subject").collect()}
    assert card[small.uri_index(triples.RDF_TYPE)] == (2, 2, 1.0)
    assert card[small.uri_index("http://example.org/ontology#livesIn")] == (1, 1, 1.0)


def test_java_hash(spark):
    df = spark.createDataFrame([("Camp Halfblood",), ("Percy",), ("ab",), ("",)], "t string")
    assert [r[0] for r in df.select(triples.literal_hash(F.col("t"))).collect()] == [2092705, 2483974, 3105, 0]


def test_turtle_terms():
    assert list(read_turtle('<a> <b> "x\\n\\"y\\"", 3.5, true ; a _:n . _:n <c> """long "text" here"""^^<t> .')) == [
        ("a", "b", 'x\n"y"', "literal"), ("a", "b", "3.5", "literal"), ("a", "b", "true", "literal"),
        ("a", triples.RDF_TYPE, "_:n", "bnode"), ("_:n", "c", 'long "text" here', "literal")]


def test_ntriples_and_ingest(spark, tmp_path):
    lines = ['<http://a> <http://p> "one\\ttwo"@en .', "<http://a> <http://p> <http://b> . # c", "_:x <http://p> _:y .", '<http://a> <http://p> "x" .', "not a triple", f'<http://{"a" * 130}> <http://p> "long subject" .']
    with gzip.open(tmp_path / "t.nt.gz", "wt") as out:
        out.write("\n".join(lines))
    rows = triples.read_ntriples(spark, str(tmp_path))
    assert rows.count() == 5
    assert sorted(tuple(r) for r in triples.ingest(rows).collect()) == [("http://a", "http://p", "http://b", "uri"), ("http://a", "http://p", "onetwo", "literal")]


def test_uri_repair(spark):
    df = spark.createDataFrame([("http://a/b c|d",), ("no scheme",), ("urn:x",)], "u string")
    assert [r[0] for r in df.select(triples.repair_uri(F.col("u"))).collect()] == ["http://a/b%20c%7Cd", "http://no%20scheme", "urn:x"]


def test_html_keeps_offsets(spark):
    page = "<html><HEAD><title>t</title></HEAD>\n<body>Angela <b>Merkel</b><script>var a='<p>';\n</script> is &nbsp; the <i\nx>chancellor.</body></html>"
    plain = spark.createDataFrame([(page,)], "h string").select(text.blank_markup(F.col("h"))).head()[0]
    assert len(plain) == len(page) and plain.count("\n") == page.count("\n")
    assert plain.index("Merkel") == page.index("Merkel") and "&nbsp;" in plain and "var" not in plain and "title" not in plain


def test_tokens_cover_text(spark):
    said = "In Berlin, can't U.S. 3.14 pay 1,000?  Yes. (Ok)"
    docs = spark.createDataFrame([(1, said), (2, ""), (3, None)], "doc_id long, text string")
    found = text.tokens(docs).orderBy("doc_id", "start").collect()
    assert [r["token"] for r in found] == ["In", "Berlin", ",", "can't", "U.S", ".", "3.14", "pay", "1,000", "?", "Yes", ".", "(", "Ok", ")"]
    assert all(said[r["start"] : r["end"]] == r["token"] for r in found)
    sents = text.sentence_flags(text.tokens(docs)).orderBy("start").collect()
    assert [r["sent"] for r in sents] == [0] * 6 + [1] * 4 + [2] * 2 + [3] * 3


def test_shapes(spark):
    cases = {"McDonald": "MIXEDCAPS", "1": "ALLDIGITS", "12": "DATE", "3.14": "DATE", "XIV": "ROMAN", "...": "MULTIDOTS", "A.": "LONELYINITIAL", "etc.": "ABBR", "A": "CAPLETTER", "x": "SINGLECHARALLCAPS", "?": "PUNC", "'": "QUOTES", "12a": "ENUM", "1-2": "NUMRANGE", "word": "word"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", text.word_shape(F.col("t")).alias("s")).collect()} == cases


def test_clusters_of_any_graph(spark):
    """Types of an unknown naming are clustered by their instances: musicians are artists, bands and venues stand alone."""
    rows, base = [], "http://music.example/"
    add = lambda s, p, o: rows.append((base + s, p if p == triples.RDF_TYPE else base + p, base + o, "uri"))
    for i in range(30):
        for kind in ("Artist", "Musician") if i % 5 else ("Artist",):
            add(f"a{i}", triples.RDF_TYPE, kind)
        add(f"a{i}", "memberOf", f"b{i % 7}")
    for i in range(7):
        add(f"b{i}", triples.RDF_TYPE, "Band")
        add(f"b{i}", "playsAt", f"v{i % 3}")
        rows.append((f"{base}b{i}", f"{base}name", f"Band {i}", "literal"))
    for i in range(3):
        add(f"v{i}", triples.RDF_TYPE, "Venue")
    kb = KnowledgeBase(triples.ingest(spark.createDataFrame(rows, "s string, p string, o string, kind string")))
    name = {r["index"]: r["uri"].removeprefix(base) for r in kb.resources.collect()}
    clusters = {name[r["type"]]: name[r["cluster"]] for r in kb.type_clusters.collect()}
    assert set(clusters) == {"Artist", "Musician", "Band", "Venue"} and clusters["Artist"] == clusters["Musician"] != clusters["Band"] == "Band"
    assert kb.instance_clusters.count() == 40
    chain = {(name[r["subject"]], name[r["predicate"]], name[r["object"]]) for r in kb.markov_chain(100).collect()}
    assert {(clusters["Artist"], "memberOf", "Band"), ("Band", "playsAt", "Venue")} <= chain
    assert kb.coverage_ambiguity.count() == 1
    found = spark.createDataFrame([(1, kb.uri_index(f"{base}a1")), (1, kb.uri_index(f"{base}b2"))], "doc_id long, subject int")
    guessed = linking.predict_facts(found, kb, kb.markov_top(kb.markov_chain(100), 1)).collect()
    assert ("a1", "memberOf", "b2") in {(name[r["subject"]], name[r["predicate"]], name[r["object"]]) for r in guessed}


def test_short_literals_beside_long_ones(spark):
    for other in ("New York", "Berlin", "Customer#000000001"):
        literals = spark.createDataFrame([(1, "USA", 0), (2, other, 0), (3, "UK", 0), (4, "x", 0)], "index int, literal string, prefix int")
        symbols = spark.createDataFrame([(9, 1, i, 1.0) for i in (1, 2, 3, 4)], "subject int, predicate int, object int, belief double")
        docs = spark.createDataFrame([(1, f"the USA and {other}. usa, Uk x USAid")], "doc_id long, text string")
        assert sorted(r["surface"] for r in spotting.spot(docs, literals, symbols).collect()) == sorted(["USA", other, "usa", "Uk", "x"])


def test_link_scores_of_many_documents(spark):
    """Documents do not influence each other, whatever else is in the batch."""
    graph = [(1, 2), (2, 3), (3, 1), (1, 4)]
    rows = [(d, a + d, b + d, 1) for d in range(50) for a, b in graph[: 2 + d % 3]]
    found = {(r["doc_id"], r["node"] - r["doc_id"]): tuple(r)[2:] for r in linking.link_scores(spark.createDataFrame(rows, "doc_id long, src int, dst int, predicate int")).collect()}
    for d in range(3, 50):
        assert all(found[d, n] == found[d % 3, n] for n in (1, 2, 3))
    assert found[2, 1][0] == pytest.approx(0.310681198) and found[2, 4][2] == pytest.approx(0.707106781)


def test_spotting_rules(spark):
    docs = spark.createDataFrame([(1, "New York City and new york. York Cityscape")], "doc_id long, text string")
    literals = spark.createDataFrame([(1, "New York", 0), (2, "New York City", 0), (3, "York City", 0), (4, "new york", 0)], "index int, literal string, prefix int")
    symbols = spark.createDataFrame([(10 + i, 5, i, 1.0) for i in range(1, 5)], "subject int, predicate int, object int, belief double")
    spans = spotting.spot(docs, literals, symbols)
    pairs = lambda df: sorted((r["a"], r["b"], r["literal"]) for r in df.collect())
    assert pairs(spans) == [(0, 8, "New York"), (0, 8, "new york"), (0, 13, "New York City"), (4, 13, "York City"), (18, 26, "New York"), (18, 26, "new york")]
    kept = spotting.longest(spans)
    assert pairs(kept) == [(0, 13, "New York City"), (18, 26, "New York"), (18, 26, "new york")]
    assert pairs(spotting.exact_case(kept)) == [(0, 13, "New York City"), (18, 26, "new york")]
    marks = spotting.bio(spotting.exact_case(kept)).orderBy("start").collect()
    assert [(r["start"], r["position"]) for r in marks] == [(0, "B"), (4, "I"), (9, "I"), (18, "B"), (22, "I")]


def test_components_and_resolvers(spark):
    pairs = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10)], "doc_id long, literal_index int, subject int")
    found = {(r["doc_id"], r["subject"]): r["component"] for r in linking.components(pairs).collect()}
    assert found == {(1, 10): 1, (1, 11): 1, (1, 12): 3, (2, 10): 1}
    candidates = linking.components(pairs)
    edges = spark.createDataFrame([(1, 10, 20, 7), (1, 11, 20, 7), (1, 20, 11, 8), (1, 11, 21, 7)], "doc_id long, src int, dst int, predicate int")
    for name in linking.RESOLVERS:
        votes = linking.resolve(linking.scores(candidates, edges, name)).collect()
        assert {r["subject"] for r in votes} == {10, 11} and max(r["vote"] for r in votes) == 1
    best = linking.winners(candidates, linking.resolve(linking.scores(candidates, edges, "degree")))
    assert {(r["doc_id"], r["component"]): r["subject"] for r in best.collect()} == {(1, 1): 11, (1, 3): 12, (2, 1): 10}


def test_matrix_values(cells):
    cosine = {(r["c1"], r["c2"]): r["cosine"] for r in matrix.cosine_rows(cells).collect()}
    assert cosine[0, 1] == pytest.approx(0.288675, abs=1e-6) and cosine[0, 3] == pytest.approx(0.5) and (0, 2) not in cosine
    turned = cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    pearson = {(r["c1"], r["c2"]): r["correlation"] for r in matrix.pearson(turned).collect()}
    for pair, value in {(0, 1): -0.416667, (0, 2): -0.471405, (0, 3): 0.353553, (1, 2): -0.353553, (1, 3): -0.353553, (2, 3): -0.166667}.items():
        assert pearson[pair] == pytest.approx(value, abs=1e-6)
    guess = {(r["row"], r["col"]): r["value"] for r in matrix.predict_by_similarity(cells, matrix.cosine_rows(cells)).collect()}
    assert [round(guess.get((0, c), 0), 6) for c in range(7)] == [1, 0, 0.288675, 1, 1, 0.288675, 1]
    assert [round(guess.get((3, c), 0), 6) for c in range(7)] == [1, 0, 0, 0.5, 0.5, 0, 0.5]
    assert [guess.get((2, c), 0) for c in range(7)] == [0, 1, 0, 0, 0, 0, 0]


def test_significance(spark):
    m = spark.createDataFrame([(1, 1, 10.0), (2, 2, 20.0), (1, 2, 5.0)], "row int, col int, value double")
    from math import exp, factorial, log

    mean = 10 * 20 / 100
    tail = 1 - sum(exp(-mean) * mean**i / factorial(i) for i in range(7))
    got = {(r["a"], r["b"]): r["significance"] for r in matrix.significance(m, 100.0).collect()}
    assert got[1, 2] == pytest.approx(-log(tail), rel=1e-9)


def test_hierarchical(spark):
    block = [(a, b, 1.0 if a == b else 0.9 if (a < 2) == (b < 2) and a < 3 and b < 3 else 0.1) for a in range(4) for b in range(4)]
    m = spark.createDataFrame(block, "c1 int, c2 int, correlation double")
    assert {r["item"]: r["cluster"] for r in matrix.hierarchical(m, 0.5).collect()} == {0: 0, 1: 0}
    assert len(matrix.hierarchical(m, 0.5, keep_single=True).collect()) == 4


def test_normalise_and_fuse(spark):
    rows = [(1, "m", s, float(v)) for s, v in enumerate([3, 1, 0, 4])] + [(1, "k", s, 2.0) for s in range(3)]
    ratings = spark.createDataFrame(rows, "doc_id long, metric string, subject int, value double")
    normal = {(r["metric"], r["subject"]): r["value"] for r in rating.normalise(ratings).collect()}
    for s, v in enumerate([1.273861, 0.726139, 0.452277, 1.547723]):
        assert normal["m", s] == pytest.approx(v, abs=1e-6)
    fused = {r["subject"]: r["value"] for r in rating.fuse(ratings, ["m", "k"]).collect()}
    assert fused == {0: 6.0, 1: 2.0, 2: 2.0}
    belief = spark.createDataFrame([(1, "m", 1, 0.5), (1, "k", 1, 0.5)], "doc_id long, metric string, subject int, value double")
    assert rating.fuse(belief, ["m", "k"], "belief").head()["value"] == 0.75


def test_average_precision(spark):
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (1, 4, 0.6)], "doc_id long, subject int, value double")
    truth = spark.createDataFrame([(1, 1), (1, 3), (1, 9)], "doc_id long, subject int")
    r = evaluation.average_precision(scores, truth).head()
    assert r["ap"] == pytest.approx((1 + 2 / 3) / 3) and r["precision"] == 0.5 and r["recall"] == pytest.approx(2 / 3)


def test_templates(small):
    none = templates.parse("SELECT * WHERE {?s <rdfs:label> ?o}")
    assert none.patterns == [(None, None, "rdfs:label", None)] and templates.Filters(none, small).ids.count() == 0
    assert templates.Filters(templates.parse(None), small).ids.count() == 0
    said = "PREFIX o: <http://example.org/ontology#> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> SELECT * FROM NAMED <k#recognized> WHERE {GRAPH <k#recognized> {?s rdfs:label \"Percy Jackson\" ; o:livesIn ?x . ?s a o:Person}}"
    found = templates.Filters(templates.parse(said), small)
    assert sorted(tuple(r) for r in found.names().collect()) == [("datatype property", "http://www.w3.org/2000/01/rdf-schema#label"), ("literal", "Percy Jackson"), ("object property", "http://example.org/ontology#livesIn"), ("type", "http://example.org/ontology#Person")]
    assert found.graphs == ["k#recognized"]


def test_conll(spark):
    lines = ["-DOCSTART- -X- O O", "", "Peter NNP I-NP I-PER", "came VBD I-VP O", "", "He PRP I-NP O", "-DOCSTART- -X- O O", "End NN I-NP O"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, n int, line string")
    docs = corpus.conll_documents(df)
    assert [r["text"] for r in corpus.conll_text(docs).orderBy("doc").collect()] == ["\nPeter came \nHe ", "End "]
    words = corpus.conll_words(docs).orderBy("doc", "sent", "i").collect()
    assert [(r["doc"], r["word"], r["label"]) for r in words] == [(1, "Peter", "I-PER"), (1, "came", "O"), (1, "He", "O"), (2, "End", "O")]


def test_archives_and_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("a b.txt", "one")
        z.writestr("d/e.txt", "two")
    rows = corpus.read_zip(spark, str(tmp_path / "c.zip")).orderBy("uri").collect()
    assert [r["text"] for r in rows] == ["one", "two"] and rows[0]["uri"].endswith("c.zip/a+b.txt")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.html").write_text("<p>\n")
    r = corpus.read_directory(spark, str(tmp_path / "t")).head()
    assert r["text"] == "<p>\n" and r["mime"] == "text/html"


def test_rdfa_and_dot(spark):
    docs = spark.createDataFrame([(1, "Angela <M> is here"), (2, "none")], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0, 6, "u:a", "u:name"), (1, 0, 6, "u:b", "u:other")], "doc_id long, start int, end int, about string, property string")
    out = {r["doc_id"]: r["xhtml"] for r in sinks.rdfa(docs, marks).collect()}
    assert '<body><span about="u:a" property="u:name">Angela</span> &lt;M&gt; is here</body>' in out[1] and "<body>none</body>" in out[2]
    edges = spark.createDataFrame([(1, 1, 2, "p")], "doc_id long, src int, dst int, label string")
    assert [r["line"] for r in sinks.dot(edges).orderBy("n").collect()] == ["digraph {", '  "1" -> "2" [label="p"];', "}"]


def test_save_and_read(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text')], "i int, t string")
    sinks.save(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c")).head()["t"] == 'a "quoted", text'
    sinks.save(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).collect() == df.collect()


def test_tree_cuts_and_vectors(spark, cells):
    from pyspark.sql import Row

    pairs = matrix.pearson(cells)
    cuts = matrix.hierarchical_cuts(pairs, [0.0, 1.0]).collect()
    by = {t: {r["item"]: r["cluster"] for r in cuts if r["threshold"] == t} for t in (0.0, 1.0)}
    assert len(by[0.0]) == len(by[1.0]) == 7 and len(set(by[1.0].values())) == 1
    assert by[0.0][3] == by[0.0][4] and by[0.0][2] == by[0.0][5] and len(set(by[0.0].values())) < 7  # equal columns are one at any threshold
    wide = matrix.cluster_distances(pairs).collect()
    assert {r["col"] for r in wide} == set(range(7)) and all(0 <= r["value"] <= 2 for r in wide)
    a, b = spark.createDataFrame([Row(item="x", value=3.0), Row(item="y", value=1.0)]), spark.createDataFrame([Row(item="y", value=4.0), Row(item="z", value=2.0)])
    assert {r["item"]: r["value"] for r in matrix.minus(a, b).collect()} == {"x": 3.0, "y": -3.0, "z": -2.0}


def test_workflow(spark, small):
    from weftline import workflow

    page = "<html><body>Percy Jackson went to Camp Halfblood.</body></html>"
    docs = workflow.create_documents(spark, [(1, page)], mime="text/html", language="en", template="t")
    assert docs.head()["text"].startswith(" ") and len(docs.head()["text"]) == len(page) and docs.head()["template"] == "t"
    line = workflow.Pipeline(small).configure(regular_expressions=None, phrase_classes=lambda run: run["instances"] if "instances" in run.done else run.docs)
    run = line.run(docs, evaluate={"literals": lambda run: evaluation.precision_recall(run["literals"].select("doc_id", "surface"), run["literals"].select("doc_id", "surface"), ["surface"], ["doc_id"])})
    assert "regular expressions" not in run.done and list(run.done)[0] == "language" and run["language"].head()["language"] == "en"
    assert {r["surface"] for r in run["literals"].collect()} == {"Percy Jackson", "Camp Halfblood"}
    facts = run["known facts"].collect()
    assert len(facts) == 3 and run["disambiguation"].count() == 2 and run["relevance"].count() > 0
    report = {(r["step"], r["measure"]): r["value"] for r in line.report(run).collect()}
    assert report["literals", "precision"] == report["literals", "recall"] == 1.0 and report["literals", "hits"] == 2.0
    assert "words" in line.run(docs, last="words").done and "sentences" not in line.run(docs, last="words").done
    with pytest.raises(ValueError):
        line.configure(no_such_step=None)


def test_leave_one_out_by_similarity(spark):
    """Three players of one club and city: each one's club is found from the others, a lone fact is not judged."""
    base = "http://x/"
    rows = [(f"{base}p{i}", triples.RDF_TYPE, f"{base}Player", "uri") for i in range(4)] + [(f"{base}{x}", triples.RDF_TYPE, f"{base}{t}", "uri") for x, t in (("c1", "Club"), ("c2", "Club"), ("t1", "Town"), ("t2", "Town"))]
    rows += [(f"{base}p{i}", f"{base}{p}", f"{base}{o}", "uri") for i, club, town in ((0, "c1", "t1"), (1, "c1", "t1"), (2, "c2", "t2"), (3, "c2", "t2")) for p, o in (("plays", club), ("lives", town))]
    kb = KnowledgeBase(triples.ingest(spark.createDataFrame(rows, "s string, p string, o string, kind string")), lambda uri: uri)
    facts = kb.relations.where(F.col("predicate") != kb.rdf_type).select(F.lit(1).cast("long").alias("doc_id"), "subject", "predicate", "object")
    found = linking.leave_one_out_similar(facts, kb, kb.markov_chain(100)).head()
    assert (found["n"], found["correct"], found["accuracy"]) == (8, 8, 1.0)
    assert linking.leave_one_out_similar(facts.limit(1), kb, kb.markov_chain(100)).head()["n"] == 0


def test_rdf_in_xml(spark):
    rdf = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://b/doc">
    <e:Person rdf:about="http://e/a" e:name="Ann"><e:knows><e:Person rdf:ID="bob"><e:age>7</e:age></e:Person></e:knows><e:home rdf:resource="town"/>
    <e:address rdf:parseType="Resource"><e:city>X &amp; Y</e:city></e:address></e:Person>
    <rdf:Description rdf:nodeID="n"><rdf:type rdf:resource="http://e/T"/><e:list rdf:parseType="Collection"><rdf:Description rdf:about="http://e/1"/></e:list></rdf:Description></rdf:RDF>"""
    trix = '<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/"><graph><uri>http://g</uri><triple><uri>http://a</uri><uri>http://p</uri><plainLiteral>hi</plainLiteral></triple><triple><id>x</id><uri>http://p</uri><uri>http://b</uri></triple></graph></TriX>'
    trig = '@prefix : <http://t/> . :g { :a :p :b . :a :q "x" } GRAPH :h { :c a :D . } :out :p :b .'
    parse = lambda text, syntax: sorted(map(tuple, triples.parse_documents(spark.createDataFrame([(text,), (None,), ("<broken",)], "text string"), syntax).collect()))
    t = triples.RDF_TYPE
    found = parse(rdf, "rdfxml")
    assert {("http://e/a", t, "http://e/Person", "uri"), ("http://e/a", "http://e/name", "Ann", "literal"), ("http://e/a", "http://e/knows", "http://b/doc#bob", "uri"), ("http://b/doc#bob", "http://e/age", "7", "literal"), ("http://e/a", "http://e/home", "http://b/town", "uri"), ("_:n", t, "http://e/T", "uri")} <= set(found)
    (blank,) = [o for s, p, o, k in found if p == "http://e/address" and k == "bnode"]
    assert (blank, "http://e/city", "X & Y", "literal") in found
    (cell,) = [o for s, p, o, k in found if p == "http://e/list"]
    assert (cell, t.replace("type", "first"), "http://e/1", "uri") in found and (cell, t.replace("type", "rest"), t.replace("type", "nil"), "uri") in found
    assert parse(trix, "trix") == [("_:x", "http://p", "http://b", "uri"), ("http://a", "http://p", "hi", "literal")]
    assert parse(trig, "trig") == [("http://t/a", "http://t/p", "http://t/b", "uri"), ("http://t/a", "http://t/q", "x", "literal"), ("http://t/c", t, "http://t/D", "uri"), ("http://t/out", "http://t/p", "http://t/b", "uri")]


def test_csv_and_truth_files(spark, tmp_path):
    rows = spark.createDataFrame([("http://a", "http://p", 'say "x", y', "literal")], "s string, p string, o string, kind string")
    sinks.save(rows, str(tmp_path / "t"), "csv")
    assert triples.read_csv(spark, str(tmp_path / "t")).collect() == rows.collect()
    docs = spark.createDataFrame([(1, "z.zip/txt%2Fone.txt"), (2, "z.zip/txt%2Ftwo.txt")], "doc_id long, uri string")
    truths = spark.createDataFrame([("z.zip/rdf%2Fone.rdf", "truth one")], "uri string, text string")
    assert {r["doc_id"]: r["truth"] for r in corpus.truth_of(docs, truths, [("txt", "rdf")]).collect()} == {1: "truth one", 2: None}
    assert {r["n"] for r in corpus.map_documents(docs, lambda d: (d["doc_id"], len(d["uri"])), "doc_id long, n int").collect()} == {19}


def test_expansion_in_stages(spark):
    """A sure component that reaches all others ends the expansion; a lonely one has all expanded, and itself backward."""
    base = "http://x/"
    edges = [("a", "b1"), ("b1", "z"), ("b2", "y"), ("w", "c1")]
    kb = KnowledgeBase(triples.ingest(spark.createDataFrame([(base + s, f"{base}p", base + o, "uri") for s, o in edges], "s string, p string, o string, kind string")))
    ids = {r["uri"].removeprefix(base): r["index"] for r in kb.resources.collect()}
    rows = [(1, ids["a"], 1), (1, ids["b1"], 2), (1, ids["b2"], 2)]
    rows += [(2, ids["a"], 1), (2, ids["b1"], 2), (2, ids["b2"], 2), (2, ids["c1"], 3)]
    found = linking.staged_expansion(spark.createDataFrame(rows, "doc_id long, subject int, component int"), kb)
    names = {i: n for n, i in ids.items()}
    assert {(r["doc_id"], names[r["src"]], names[r["dst"]]) for r in found.collect()} == {(1, "a", "b1"), (2, "a", "b1"), (2, "b1", "z"), (2, "b2", "y"), (2, "w", "c1")}


def test_trained_models(spark):
    """Maximum entropy finds what decides a label, with probabilities; a tagger learns noun phrases from words and tags."""
    from weftline.operators import features

    rows = [(i, 0, 0, label, [f"i:{word}", "a:the"]) for i, (label, word) in enumerate([("PLACE", "town"), ("PLACE", "city"), ("NAME", "ann"), ("NAME", "bob")] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, sent int, lower int, label string, features array<string>")
    model = features.train_maxent(df)
    asked = spark.createDataFrame([(1, ["i:town", "a:the"]), (2, ["i:bob"]), (3, ["a:the"])], "doc_id long, features array<string>")
    found = {r["doc_id"]: r for r in features.apply_maxent(model, asked, ["doc_id"], 0.3).collect()}
    assert (found[1]["best"], found[1]["accepted"]) == ("PLACE", True) and (found[2]["best"], found[2]["accepted"]) == ("NAME", True)
    assert found[3]["p1"] == pytest.approx(0.5, abs=0.02) and not found[3]["accepted"]
    said = [("the", "DT", "B-NP"), ("old", "JJ", "I-NP"), ("house", "NN", "I-NP"), ("fell", "VB", "O")]
    words = spark.createDataFrame([(d, 0, i, *w) for d in range(60) for i, w in enumerate(said[d % 2 :])], "doc_id long, sent int, i int, word string, pos string, np string")
    scores = {r["label"]: r["f1"] for r in features.evaluate_chunker(words.replace({"the": "a"}, subset="word")).collect()}
    assert scores["O"] == 1.0 and scores["I-NP"] > 0.8
