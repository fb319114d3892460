"""Continuous ingest: every micro-batch is flushed as one segment of a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions.text import Analyzer, PunctuationAnalyzer
from lexmill.operators.index import TextIndex, complete, latest_version
from lexmill.sources.docstore import numbered


def segment_writer(path: str, analyzer: Analyzer | None = None, positional: bool = True):
    """A foreachBatch function; the batch id is the segment number, and a replayed batch overwrites its own segment.

    Segments are added to version 0 of the index; once they have been merged into a later version, batches are refused, as
    their numbers would be taken.
    """
    analyzer = analyzer or PunctuationAnalyzer()

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        if latest_version(spark, path) > 0:
            raise ValueError(f"the index at {path} has been merged; stream into a new one")
        at = f"{path}/version=0"
        docs = numbered(batch, "doc_id", "_o").withColumn("local_doc_id", F.col("_o").cast("int")).withColumn("segment_id", F.lit(batch_id)).drop("_o")
        postings = TextIndex._post(docs, analyzer, positional)
        docs.drop("segment_id").write.mode("overwrite").parquet(f"{at}/documents/segment_id={batch_id}")
        postings.drop("segment_id").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{at}/postings/segment_id={batch_id}")
        complete(spark, at)

    return write


def ingest(stream: DataFrame, path: str, checkpoint: str, analyzer: Analyzer | None = None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(segment_writer(path, analyzer)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
