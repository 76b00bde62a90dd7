"""File changes as a stream: latest state by path, bursts, ghosts of deleted paths. Batch and stream share the functions.

A change has path, kind (add, change, unlink), ts and an event_id that orders equal times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How late a change may come.
LATE = "10 minutes"


def from_events(events: DataFrame) -> DataFrame:
    """The events table as changes: users as paths, signups as additions, errors as deletions, the rest as changes."""
    kind = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "unlink").otherwise("change")
    return events.select(F.col("user_id").alias("path"), kind.alias("kind"), "ts", "event_id", "value")


def latest_state(changes: DataFrame) -> DataFrame:
    """(path, kind, ts, event_id) of each path's last change: a max over structs, with partial aggregates."""
    return changes.groupBy("path").agg(F.max(F.struct("ts", "event_id", "kind")).alias("s")).select("path", "s.kind", "s.ts", "s.event_id")


def bursts(changes: DataFrame, width: str = "1 second") -> DataFrame:
    """(start, n): changes in each tumbling window."""
    return changes.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(changes: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(path, start, n): runs of a path's changes less than a gap apart."""
    return changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("path", F.col("w.start").alias("start"), "n")


def priority(kind):
    return F.when(kind == "unlink", 0).when(kind == "add", 1).otherwise(2)


def ghosts(changes: DataFrame) -> DataFrame:
    """(path, ts) of paths whose last change deletes them."""
    return latest_state(changes).where("kind = 'unlink'").select("path", "ts")


def pace(n: int, pause: float) -> float:
    """Milliseconds to pause after a burst of n changes: longer after over 50, shorter after under 10."""
    return min(pause * 1.5, 500) if n > 50 else max(pause / 1.5, 50) if n < 10 else pause


def read_changes(spark: SparkSession, path: str, schema, *, files: int = 100) -> DataFrame:
    """Event files as a stream of changes, with a watermark."""
    changes = from_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path))
    return changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def keep_state(changes: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Folds each batch into a latest-state table: batch n reads state n - 1 and writes state n under `target`, so a retried batch
    writes the same folder again and a reader takes the highest complete one."""

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest_state(batch).select("path", "kind", "ts", "event_id")
        if n > 0:
            new = latest_state(spark.read.parquet(f"{target}/n={n - 1}").select("path", "kind", "ts", "event_id").unionByName(new))
        new.write.mode("overwrite").parquet(f"{target}/n={n}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(changes: DataFrame, width: str, name: str, checkpoint: str) -> StreamingQuery:
    """Counts by window and kind to a table in memory, each when its watermark has passed (complete at the end of input)."""
    counts = changes.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
