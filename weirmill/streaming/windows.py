"""Structured Streaming forms of the event operators: windows with late data, sessions, and rate limits with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The named Parquet table as a stream of files; zone-less times become timestamps."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", f"{name}*.parquet").load(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows, late events up to ``late``."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) of sessions that end after a gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def limited(events: DataFrame, key: str, ident: str, rate: float, burst: float = 10.0) -> DataFrame:
    """(key, ident, passed) under a token bucket for each key; the bucket's level and time are kept as state between batches."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (burst, -1.0)
        rows = pd.concat(list(batches)).sort_values(["at", ident], kind="stable")
        passed = []
        for t in rows["at"]:
            level = min(burst, level + (t - last) * rate) if last >= 0 else level
            last = t
            passed.append(level >= 1)
            level -= level >= 1
        state.update((float(level), float(last)))
        yield pd.DataFrame({key: k[0], ident: rows[ident].to_numpy(), "passed": passed})

    kinds = dict(events.dtypes)
    timed = events.select(key, ident, (F.unix_micros("ts") / 1e6).alias("at"))
    schema = f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, passed boolean"
    return timed.groupBy(key).applyInPandasWithState(run, schema, "level double, last double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there, then stops; files are written exactly once."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
