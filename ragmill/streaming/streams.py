"""Streams: windows over event time, sessions, deduplication. Stateful processors are in buffers and branches.

Each stream takes and gives a streaming DataFrame, so sources and sinks are the caller's. drain runs a stream over what is there into a
folder and can be called again to go on; run_available does so once, which is how a batch job uses the same plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import new_path, remove


def event_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A table's files as a stream, its times as timestamps in the session's zone."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet*")
    return stream.withColumn("ts", F.to_timestamp("ts"))


def tumbling(events: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """Count and sum for each window and key; a window closes once the watermark has passed it."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), *by)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str, *by: str) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *by)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def deduplicated(events: DataFrame, late: str, *key: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key))


def with_static(events: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return events.join(table, key, "left")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within have the state store that processors of buffers and branches need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, path: str, *, seconds: float | None = None) -> DataFrame:
    """Run a stream over what is there and read all that path has so far. The checkpoint stays, so the next call for the same path goes
    on where this one, finished or killed, has stopped; rows of a batch that was not committed are not read.

    A stream with timers has never done all its work: it needs a number of seconds to run for.
    """
    with keyed_state(stream.sparkSession):
        writer = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/log").outputMode("append")
        q = (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime="200 milliseconds")).start()
    if seconds is None:
        q.awaitTermination()
    elif not q.awaitTermination(seconds):
        q.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Drain a stream into a new table in the shared folder, once and for all: its checkpoint goes."""
    path = new_path(stream.sparkSession, name)
    out = drain(stream, path)
    remove(stream.sparkSession, f"{path}/log")
    return out
