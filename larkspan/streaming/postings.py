"""Postings kept up to date from a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.text import lexical_text
from larkspan.operators.lexical import term_frequencies


def record_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON-line files of a folder as a stream, with a column for the time they were ingested."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.withColumn("ingested_at", F.current_timestamp())


def append_postings(records: DataFrame, path: str, checkpoint: str):
    """Start a query that appends each batch's postings (doc_id, term, tf, batch) to the table at `path`.

    A batch writes its own partition and overwrites it when it is tried again after a failure, so each
    record's postings are there exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        once = batch.filter("_id is not null").dropDuplicates(["_id"]).withColumnRenamed("_id", "doc_id")
        rows = term_frequencies(once, "doc_id", lexical_text(F.col("title"), F.col("text")))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequencies_by_window(stream: DataFrame, time: str, window: str, late: str, key: str) -> DataFrame:
    """Counts per key and event-time window; rows later than `late` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
