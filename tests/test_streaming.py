from weftline.operators import spotting
from weftline.streaming.spotting import spot_stream


def test_stream_equals_batch(spark, tmp_path):
    from weftline.operators.kb import KnowledgeBase

    triples = spark.createDataFrame([("u:1", "u:name", "New York", "literal"), ("u:2", "u:name", "York", "literal")], "s string, p string, o string, kind string")
    kb = KnowledgeBase(triples)
    docs = spark.createDataFrame([(1, "in New York"), (2, "no city"), (3, "York and York")], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = spot_stream(stream, kb, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    batch = spotting.exact_case(spotting.longest(spotting.spot(docs, kb.literals, kb.symbols)))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.select(batch.columns).collect())) == sorted(map(tuple, batch.collect()))
