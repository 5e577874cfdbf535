"""Structured Streaming twins of the incremental operators.

Each function takes a streaming DataFrame and starts a query that reads what is there
and stops (`availableNow`), or runs on with the given trigger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from icestats.operators.market import latest_by_key


def file_stream(spark: SparkSession, path: str, schema, *, kind: str = "parquet", pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    r = spark.readStream.schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.option("header", True).csv(path) if kind == "csv" else r.parquet(path)


def _run(writer, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def ingest_once(stream: DataFrame, key: Sequence[str], time: str, out: str, checkpoint: str, *, delay: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Append rows to a parquet folder, each key once within the lateness bound."""
    unique = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))
    return _run(unique.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, trigger).start()


#: How many versions of the state a checkpoint keeps.
KEPT_VERSIONS = 3


def keep_latest_lines(stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the latest line per key as keyed state of the query, beside its checkpoint.

    The state holds one line per key whatever number of batches have come; Spark's
    maintenance drops versions older than KEPT_VERSIONS batches. A restart goes on from the checkpoint; a repeated batch changes nothing,
    as the latest line is a maximum. Read it with `read_latest_lines`.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.minBatchesToRetain", KEPT_VERSIONS)
    return _run(latest_by_key(stream).writeStream.format("noop").outputMode("update"), checkpoint, trigger).start()


def read_latest_lines(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The current line of every key, read from the state store."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", "value.valueWithExtremumOrdering.*")


def share_in_windows(stream: DataFrame, time: str, focal: str, *, length: str = "90 seconds", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Focal share of events per game in sliding windows; works on a stream or a table."""
    w = stream.withWatermark(time, delay).groupBy("gameid", F.window(time, length, slide))
    mine = F.sum((F.col("owner") == focal).cast("bigint"))
    return w.agg(F.count(F.lit(1)).alias("events"), F.coalesce(mine, F.lit(0)).alias("focal")).select(
        "gameid", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events", "focal",
        (F.col("focal") / F.col("events")).alias("share"),
    )


def gap_sessions(stream: DataFrame, time: str, *, gap: str = "2 minutes", delay: str = "1 minute") -> DataFrame:
    """Runs of events of a game with no pause longer than the gap."""
    return stream.withWatermark(time, delay).groupBy("gameid", F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        "gameid", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"
    )


def with_end(stream: DataFrame, time: str, at, folder: str) -> DataFrame:
    """The stream and one empty row at the time `at`, which closes all windows and sessions before it.

    Use it for a stream that ends: its last results wait for a later row otherwise. The row
    itself stays in an open window and never comes out; `at` must lie beyond the last row
    by more than the lateness bound and the window or gap.
    """
    spark = stream.sparkSession
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema if f.name != time]
    row = spark.range(1).select(*empty, F.lit(at).cast(stream.schema[time].dataType).alias(time)).select(*stream.columns)
    row.write.mode("overwrite").parquet(folder)
    return stream.unionByName(spark.readStream.schema(row.schema).parquet(folder))


def append_results(result: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write finished windows or sessions to a parquet folder."""
    return _run(result.writeStream.format("parquet").option("path", out).outputMode("append"), checkpoint, trigger).start()
