"""Listing, statistics, trending, timeline and mutation operators over websets, items, monitors and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmill.functions.text import strip


def iso(time: Column) -> Column:
    """A timestamp as text, to the second."""
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def contains_term(column: Column, term: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the term are ordinary characters."""
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{escaped}%")


def equal_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal every wanted value; a wanted None leaves that column free."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def metadata_filter(df: DataFrame, column: str, wanted: dict[str, str]) -> DataFrame:
    """Rows whose JSON object has every wanted top-level value, compared as text."""
    for key, value in wanted.items():
        df = df.filter(F.get_json_object(F.col(column), f"$.{key}") == value)
    return df


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*order).offset(offset).limit(limit)


def newest(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, cut to n a task before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; rows with a null key form one group."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def latest_rows(current: DataFrame, changes: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Upsert: of old and new rows with one key the one that comes last (``order`` puts the winner first); rows without a key replace
    none and are all kept."""
    rows = current.unionByName(changes)
    return keep_first(rows.filter(F.col(key).isNotNull()), [key], order).unionByName(rows.filter(F.col(key).isNull()))


def without_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Delete: the rows whose key is not listed; null keys stay."""
    return df.join(keys.select(column).distinct(), column, "left_anti")


def cascade(children: DataFrame, foreign: str, gone: DataFrame, key: str) -> DataFrame:
    """Children left when the parents in ``gone`` are deleted."""
    return children.join(gone.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def patch(df: DataFrame, patches: DataFrame, key: str, fields: Sequence[str], changed: str = "changed") -> DataFrame:
    """Partial update: fields named in the patch's map ``changed`` get its value, even null; the others stay."""
    joined = df.join(patches.select(key, F.col(changed).alias("__changed")), key, "left")
    values = {f: F.when(F.map_contains_key("__changed", F.lit(f)), F.col("__changed")[f]).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(values).drop("__changed")


def content_digest(content: Column) -> Column:
    """SHA-256 of the UTF-8 content; null for null and empty."""
    return F.when(F.length(content) > 0, F.sha2(content, 256))


def unseen_hashes(batch: DataFrame, seen: DataFrame, hash_column: str, order: Sequence[Column]) -> DataFrame:
    """Rows without content are kept; of the others the first of each hash that is not in ``seen``."""
    bare = batch.filter(F.col(hash_column).isNull())
    fresh = batch.join(seen.select(hash_column).dropna().distinct(), hash_column, "left_anti").filter(F.col(hash_column).isNotNull())
    return bare.unionByName(keep_first(fresh, [hash_column], order).select(batch.columns))


def merge_pages(results: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Crawled pages merged into results: content replaced, title kept unless empty, metadata merged with the page's winning.

    ``results``: key, title, content, meta (map); ``pages``: the same, unique in key. Results without a page stay as they are.
    """
    p = pages.select(key, *(F.col(c).alias(f"__{c}") for c in ("title", "content", "meta")))
    joined = results.join(p, key, "left")
    old = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    new = F.coalesce("__meta", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return joined.withColumns(
        {
            "content": F.coalesce("__content", "content"),
            "title": F.coalesce(F.nullif("title", F.lit("")), "__title", "title"),
            "meta": F.map_concat(kept, new),
        }
    ).drop("__title", "__content", "__meta")


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, hash_column: str) -> DataFrame:
    """(key, change) of a refresh: added, removed, updated or unchanged, by comparing one kind of hash with itself."""
    a = old.select(key, F.col(hash_column).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(key, F.col(hash_column).alias("__new"), F.lit(True).alias("__in_new"))
    change = (
        F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    )
    return a.join(b, key, "full").select(key, change.alias("change"))


def dashboard(websets: DataFrame, items: DataFrame, monitors: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(metric, n): one pass over each table."""
    day = F.expr("INTERVAL 1 DAY")
    parts = [
        websets.agg(F.count(F.lit(1)).alias("total_websets"), F.count_if(F.col("created_at") >= now - day).alias("websets_created_24h")),
        items.agg(F.count(F.lit(1)).alias("total_items"), F.count_if(F.col("enrichments").isNotNull()).alias("enriched_items")),
        monitors.agg(F.count(F.lit(1)).alias("total_monitors"), F.count_if(F.col("status") == "enabled").alias("active_monitors")),
        runs.agg(F.count_if(F.col("started_at") >= now - day).alias("runs_24h"), F.count_if(F.col("status") == "failed").alias("failed_runs")),
    ]
    rows = [p.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("n")) for c in p.columns)))) for p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def webset_stats(items: DataFrame) -> DataFrame:
    """Items, enriched items and mean content length of each webset."""
    return items.groupBy("webset_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("enrichments").isNotNull()).alias("n_enriched"), F.round(F.avg(F.length("content")), 6).alias("avg_content_length")
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs, successes, failures and changed items of each monitor; null counters count as 0."""
    return runs.groupBy("monitor_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.sum(F.coalesce("items_added", F.lit(0)) + F.coalesce("items_updated", F.lit(0))).cast("long").alias("n_changed"),
    )


PERIODS = {"24h": 1, "7d": 7, "30d": 30}


def trending(df: DataFrame, column: str, time: str, now: Column, period: str, limit: int) -> DataFrame:
    """Most frequent values of a column within a period (unknown periods mean 24h), with the change against the period before."""
    days = PERIODS.get(period, 1)
    span = F.expr(f"INTERVAL {days} DAY")
    back = F.expr(f"INTERVAL {2 * days} DAY")
    rows = df.filter(F.col(column).isNotNull() & (F.col(time) >= now - back) & (F.col(time) <= now))
    current = F.count_if(F.col(time) >= now - span)
    counts = rows.groupBy(column).agg(current.alias("n"), F.count_if(F.col(time) < now - span).alias("n_before")).filter("n > 0")
    change = F.when(F.col("n_before") > 0, F.round(F.lit(100.0) * (F.col("n") - F.col("n_before")) / F.col("n_before"), 6))
    return counts.withColumn("change_percent", change).orderBy(F.desc("n"), column).limit(max(1, min(limit, 50)))


def timeline(sources: Sequence[DataFrame], limit: int) -> DataFrame:
    """The newest events of several sources of (at, kind, ref, detail): limit // number of sources of each, then the newest limit."""
    each = limit // len(sources)
    order = (F.desc("at"), "kind", "ref")
    parts = [s.orderBy(*order).limit(each) for s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order).limit(limit)


def job_status(events: DataFrame, job: str, order: str) -> DataFrame:
    """The state of each job: that of its latest event."""
    return events.groupBy(job).agg(F.max_by("status", order).alias("status"), F.count(F.lit(1)).alias("n_events"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def non_blank(column: Column) -> Column:
    return F.coalesce(strip(column) != "", F.lit(False))
