"""Incremental jobs with Structured Streaming: chunk new documents, count outcomes, find stalls, keep the latest version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plugins import chunk_results, chunks_of
from textloom.sources.storage import shared_folder, write_upsert


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 4) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")  # a pattern also fits a table of one file


def stream_chunks(docs: DataFrame, strategy: str, sink: str, checkpoint: str, **parameters) -> None:
    """Chunk what has newly arrived and append it to sink; each batch writes a folder of its own, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunks_of(chunk_results(batch, strategy, **parameters)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_outcomes(outcomes: DataFrame, sink: str, checkpoint: str) -> None:
    """Running totals: every batch replaces the totals so far."""
    totals = outcomes.groupBy().agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count("*").alias("total"))
    totals.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_stalls(events: DataFrame, key: str, ts: str, timeout: str, sink: str, checkpoint: str, late: str = "0 seconds") -> None:
    """A session that closes is a stall: key, last activity plus timeout, number of events; each is written once."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    sessions = timed.groupBy(F.session_window(ts, timeout).alias("w"), key).agg(F.count("*").alias("n_events"))
    flat = sessions.select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("stalled_at"), "n_events")
    flat.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_upsert(versions: DataFrame, sink: str, checkpoint: str, every: int = 16) -> None:
    """Append versions(stem, run_ts, ...) per batch, and join them to one base every so many batches; load_upserts reads the newest ones.

    A repeated batch replaces itself.
    """
    writing = versions.writeStream.foreachBatch(lambda batch, number: write_upsert(batch, sink, number, every))
    writing.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
