"""Telemetry as streams: tool metrics with late data, and rebuilds when files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRACE = "at timestamp, tool string, session string, call_index long, duration double, success boolean, bytes long, truncated boolean"


def read_traces(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder; a line that is no JSON becomes a row of nulls and is left out."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_batch).json(folder).where("at is not null")


def tool_windows(traces: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, tool, calls, errors, mean_duration) in tumbling windows; rows later than ``late`` are not waited for.

    Works on a stream and, without watermark, alike on a table.
    """
    t = traces.withWatermark("at", late) if traces.isStreaming else traces
    g = t.groupBy(F.window("at", width).alias("w"), "tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.avg("duration").alias("mean_duration"))
    return g.select(F.col("w.start").alias("start"), "tool", "calls", "errors", "mean_duration")


def sessions(traces: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(session, start, calls) of runs of calls with less than ``gap`` between them."""
    t = traces.withWatermark("at", late) if traces.isStreaming else traces
    g = t.groupBy("session", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("calls"))
    return g.select("session", F.col("w.start").alias("start"), "calls")


def append_windows(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write closed windows to a table's folder, all that has arrived, then stop."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rebuild_on_arrival(spark: SparkSession, folder: str, checkpoint: str, rebuild: Callable[[DataFrame], None]) -> StreamingQuery:
    """Call ``rebuild`` with each batch of manifests (content, path) that arrive; a batch that was done is not done again."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    texts = files.select("path", F.decode("content", "utf-8").alias("content"))
    return texts.writeStream.foreachBatch(lambda df, _: rebuild(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
