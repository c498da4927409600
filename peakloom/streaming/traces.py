"""Traces and sessions as streams, and the same results over a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(form).load(path)


def windows(events: DataFrame, at: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and kind; on a stream with a watermark."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("_at", late) if events.isStreaming else rows
    window = F.window("_at", size, slide) if slide else F.window("_at", size)
    out = rows.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with no gap as long as the given one."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    rows = rows.withWatermark("_at", late) if events.isStreaming else rows
    out = rows.groupBy(F.session_window("_at", gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), "n")


def unique(events: DataFrame, key: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once, within the watermark on a stream."""
    if not events.isStreaming:
        return events.dropDuplicates(key)
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(key).drop("_at")


def pairs(events: DataFrame, user: str, at: str, kind: str, first: str, then: str, within: str) -> DataFrame:
    """Starts and ends of one user whose end comes within a time after the start; a stream-stream join on streams."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    left = rows.where(F.col(kind) == first).select(F.col(user).alias("user"), F.col("event_id").alias("start_id"), F.col("_at").alias("started"))
    right = rows.where(F.col(kind) == then).select(F.col(user).alias("other"), F.col("event_id").alias("end_id"), F.col("_at").alias("ended"))
    if events.isStreaming:
        left, right = left.withWatermark("started", within), right.withWatermark("ended", within)
    on = (F.col("user") == F.col("other")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {within}"))
    return left.join(right, on).drop("other")


def latest(events: DataFrame, thread: str, at: list[str], columns: list[str]) -> DataFrame:
    """The state of each thread after all its events: the last value of each column that isn't null."""
    place = F.struct(*at)
    return events.groupBy(thread).agg(F.count("*").alias("turns"), *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])


def running(events: DataFrame, thread: str, at: list[str], columns: list[str]) -> DataFrame:
    """The state after each event."""
    so_far = Window.partitionBy(thread).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    return events.select(thread, *at, *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in columns])


def recent(events: DataFrame, thread: str, at: list[str], most: int) -> DataFrame:
    """The last few events of each thread."""
    place = F.row_number().over(Window.partitionBy(thread).orderBy(*[F.desc(a) for a in at]))
    return events.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def session_state(events: DataFrame, thread: str, columns: list[str], order: str) -> DataFrame:
    """``latest`` on a stream: state by thread, later events over earlier ones, put out whenever a thread changes."""
    schema = f"{thread} long, turns long, " + ", ".join(f"{c} string" for c in columns)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [0, *[None] * len(columns)]
        rows = pd.concat(list(parts)).sort_values(order)
        held[0] += len(rows)
        for i, c in enumerate(columns, 1):
            some = rows[c].dropna()
            held[i] = some.iloc[-1] if len(some) else held[i]
        state.update(tuple(held))
        yield pd.DataFrame([[key[0], *held]], columns=[thread, "turns", *columns])

    kept = "turns long, " + ", ".join(f"{c} string" for c in columns)
    return events.groupBy(thread).applyInPandasWithState(update, schema, kept, "update", GroupStateTimeout.NoTimeout)


def run_once(frame: DataFrame, name: str, mode: str, folder: str) -> None:
    """Processes all that there is and stops; the result is the in-memory table of that name."""
    frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
