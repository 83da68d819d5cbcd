"""Incremental processing: search, refresh and hybrid monitor runs as set joins, run states, rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmill.operators.relational import keep_first, snapshot_changes


def search_run(results: DataFrame, known: DataFrame, url: str, mark: str, order: str) -> DataFrame:
    """(order, action) of new results: ``skip_hash`` if the content is known or came before, ``skip_url`` if the url is, else ``add``.

    Content-less results (null mark) are judged by url alone.
    """
    seen_marks = known.select(F.col(mark)).dropna().distinct().withColumn("__mark", F.lit(True))
    seen_urls = known.select(F.col(url)).dropna().distinct().withColumn("__url", F.lit(True))
    firsts = results.filter(F.col(mark).isNotNull()).groupBy(mark).agg(F.min(order).alias("__first"))  # combined before the shuffle
    joined = results.join(seen_marks, mark, "left").join(seen_urls, url, "left").join(firsts, mark, "left")
    action = (
        F.when(F.col(mark).isNotNull() & (F.col("__mark").isNotNull() | (F.col("__first") < F.col(order))), "skip_hash").when(F.col("__url").isNotNull(), "skip_url").otherwise("add")
    )
    return joined.select(order, action.alias("action"))


def refresh_run(items: DataFrame, crawled: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, change) of re-crawled items: updated or unchanged by one kind of hash; items that were not crawled are left out."""
    return snapshot_changes(items, crawled, key, mark).filter(F.col("change").isin("updated", "unchanged"))


def run_status(errors: Column) -> Column:
    return F.when(F.size(errors) == 0, "completed").otherwise("failed")


def retriable(runs: DataFrame, monitor: str, order: str) -> DataFrame:
    """Monitors whose newest run failed."""
    return keep_first(runs, [monitor], [F.desc(order)]).filter(F.col("status") == "failed").select(monitor)


def error_streaks(events: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """``events`` with ``streak``: how many failures in a row end at each event; 0 after a success."""
    own = Window.partitionBy(key).orderBy(order)
    runs = events.withColumn("__ok", F.when(failed, 0).otherwise(1)).withColumn("__block", F.sum("__ok").over(own))
    inside = Window.partitionBy(key, "__block").orderBy(order)
    return runs.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(inside).cast("long")).drop("__ok", "__block")


def backoff(streak: Column, base: float = 2.0, factor: float = 1.0, most: float = 300.0, retry_after: Column | None = None) -> Column:
    """Seconds to wait: base ** streak * factor, at most ``most``; 0 without errors; a server's own wish wins."""
    wait = F.when(streak <= 0, 0.0).otherwise(F.least(F.pow(F.lit(base), F.least(streak, F.lit(64)).cast("double")) * factor, F.lit(most)))
    return F.coalesce(retry_after.cast("double"), wait) if retry_after is not None else wait


def token_bucket(times: list[float], rate: float, burst: float) -> list[bool]:
    """Which requests pass: the bucket refills at ``rate`` a second up to ``burst``, a request takes one."""
    level, last, out = burst, None, []
    for t in times:
        if last is not None:
            level = min(burst, level + (t - last) * rate)
        last = t
        passed = level >= 1
        level -= passed
        out.append(bool(passed))
    return out


def rate_limited(events: DataFrame, key: str, ident: str, time: str, rate: float, burst: float = 10.0) -> DataFrame:
    """(key, ident, passed) of each request under its key's bucket, in order of time; a key's requests are one task's, in batches of its state."""
    kinds = dict(events.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", ident], kind="stable")
        return pd.DataFrame({key: rows[key], ident: rows[ident], "passed": token_bucket(rows["at"].tolist(), rate, burst)})

    at = (F.unix_micros(F.col(time)) / 1e6).alias("at")
    return events.select(key, ident, at).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{ident}` {kinds[ident]}, passed boolean")


def healthy(stats: DataFrame, least_rate: float = 0.5) -> DataFrame:
    """Rows with ``healthy`` and a success rate of at least ``least_rate``; all rows if none is."""
    own = Window.partitionBy()
    good = F.col("healthy") & (F.col("success_rate") >= least_rate)
    return stats.withColumn("__good", good).withColumn("__any", F.max("__good").over(own)).filter(F.col("__good") | ~F.coalesce("__any", F.lit(False))).drop("__good", "__any")
