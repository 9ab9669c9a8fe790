"""Silences of keys in a stream, by timers: also the last one of a key, which no later event closes."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


#: Groups that keys are hashed to; each has one state and one timer, so a batch costs calls by group and not by key.
BUCKETS = 512


def joined_sessions(runs: pd.DataFrame, timeout: int) -> pd.DataFrame:
    """Runs (k, first, last, n, touched; microseconds) with those of a key no further apart than timeout made one, in order."""
    runs = runs.sort_values(["k", "first"], kind="stable", ignore_index=True)
    reached = runs.groupby("k", sort=False)["last"].cummax().shift()
    new = (runs["k"] != runs["k"].shift()) | (runs["first"] - reached > timeout)
    return runs.groupby(new.cumsum(), sort=False).agg({"k": "first", "first": "first", "last": "max", "n": "sum", "touched": "max"}).reset_index(drop=True)


class Sessions(StatefulProcessor):
    """The open sessions of a group of keys. A timer gives out those of the keys that have been idle, and stays while there are others."""

    def __init__(self, key: str, timeout: int, late: int, idle_ms: int):
        self.key, self.timeout, self.late, self.idle_ms = key, timeout, late, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", StructType([StructField("rows", BinaryType())]))

    def held(self) -> list[pd.DataFrame]:
        return [pa.ipc.open_stream(bytes(self.open.get()[0])).read_pandas()] if self.open.exists() else []

    def keep(self, runs: pd.DataFrame) -> None:
        """The group's state and its timer, for the key that has been idle longest."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if not len(runs):
            self.open.clear()
            return
        batch, out = pa.RecordBatch.from_pandas(runs, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as writer:
            writer.write_batch(batch)
        self.open.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(runs["touched"].min()) + self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        new = [f[[self.key, "first", "last", "n"]].set_axis(["k", "first", "last", "n"], axis=1).assign(touched=now) for f in rows]
        runs = joined_sessions(pd.concat([*self.held(), *new], ignore_index=True), self.timeout)
        keys = runs.groupby("k", sort=False)
        runs["touched"] = keys["touched"].transform("max")
        over = (runs["last"] + self.timeout + self.late < keys["last"].transform("max")) & (runs["k"] == runs["k"].shift(-1))
        self.keep(runs[~over])
        yield self.made(runs[over])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for runs in self.held():
            idle = runs["touched"] + self.idle_ms <= timerValues.getCurrentProcessingTimeInMs()
            self.keep(runs[~idle])
            yield self.made(runs[idle])

    def made(self, runs: pd.DataFrame) -> pd.DataFrame:
        return runs[["k", "first", "last", "n"]].set_axis([self.key, "first", "last", "n_events"], axis=1).reset_index(drop=True)

    def close(self) -> None:
        pass


def stream_silences(events: DataFrame, key: str, ts: str, timeout_s: float, sink: str, checkpoint: str, late_s: float = 0.0, idle_s: float = 5.0) -> None:
    """key, from_ts, stalled_at (last event plus timeout), n_events of each session, written once, until nothing is open.

    A session ends where a key is silent for longer than timeout_s. It is given out when a newer event of its key is more than
    timeout_s and late_s after it, or else by a timer, once idle_s have gone by without any event of the key; so the last silence of a key
    needs no later event of any key. Events with a null key or time are left out. Tasks join the events of a key into runs before they are
    shuffled, so a key with many events sends few rows. State and timers are kept by BUCKETS groups of keys. A run of this job over the same checkpoint goes on where the last one ended.
    """
    spark = events.sparkSession
    timeout = int(timeout_s * 1_000_000)
    schema = StructType([StructField(key, events.schema[key].dataType, True), *(StructField(n, LongType()) for n in ("first", "last", "n"))])

    def runs_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.sort_values(["k", "t"], kind="stable")
            new = (f["k"] != f["k"].shift()) | (f["t"] - f["t"].shift() > timeout)
            grouped = f.groupby(new.cumsum(), sort=False)
            yield pd.DataFrame({key: grouped["k"].first(), "first": grouped["t"].first(), "last": grouped["t"].last(), "n": grouped["t"].size()})

    timed = events.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    out = StructType([schema[key], *(StructField(n, LongType()) for n in ("first", "last", "n_events"))])
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        found = timed.mapInPandas(runs_of, schema).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).groupBy("_bucket").transformWithStateInPandas(Sessions(key, timeout, int(late_s * 1_000_000), int(idle_s * 1_000)), out, "Append", "ProcessingTime")
        flat = found.select(key, F.timestamp_micros("first").alias("from_ts"), F.timestamp_micros(F.col("last") + timeout).alias("stalled_at"), "n_events")
        running = flat.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()
        try:
            while running.isActive and _open(running):
                time.sleep(0.1)
            if running.exception():
                raise running.exception()
        finally:
            running.stop()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _open(running) -> bool:
    """Whether the last batch had input or left state, sessions or the timers that will give them out. Timers keep batches coming without input.

    A batch that an earlier run left unfinished is repeated without a look at the source, and files can be without rows: both end nothing.
    """
    progress = running.lastProgress
    if progress is None:
        return True
    last = json.loads(progress.json)
    if "latestOffset" not in last["durationMs"] or any(x["startOffset"] != x["endOffset"] for x in last["sources"]):
        return True
    return last["numInputRows"] > 0 or any(op["numRowsTotal"] > 0 for op in last["stateOperators"])
