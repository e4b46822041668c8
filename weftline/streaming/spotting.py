"""Spotting in a stream of documents: each micro-batch runs through the batch operators against a fixed knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import spotting
from weftline.operators.kb import KnowledgeBase


def spot_stream(docs: DataFrame, kb: KnowledgeBase, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the kept spans of each micro-batch of ``docs`` (doc_id, text) to Parquet, one folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so every document counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        spans = spotting.exact_case(spotting.longest(spotting.spot(batch, kb.literals, kb.symbols)))
        spans.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
