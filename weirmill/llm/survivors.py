"""One surviving record for each group of duplicates, chosen field by field.

Each field has its own ranking of the group's rows: usable values only, then completeness, trust, recency and a
deterministic tie-break, by a window ordering that keeps the first row. The engine turns the rank filter into a
partition-wise limit before the shuffle, so a group that holds a third of all rows sends one row a field and task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmill.functions.text import strip
from weirmill.functions.urls import canonical_url


@dataclass(frozen=True)
class Field:
    """How one field is chosen. ``value`` null means not usable; higher ``complete``, ``trust`` and ``time`` win, null last."""

    name: str
    value: Column
    time: Column | None = None
    complete: Column | None = None
    trust: Column | None = None


_RANK = "name string, value string, complete double, trust double, time timestamp"


def field_candidates(rows: DataFrame, key: Column, rec: str, fields: list[Field], more: Column | None = None) -> DataFrame:
    """(key, rec, name, value, complete, trust, time), a row for each usable value.

    ``more``: an array of structs like _RANK, for fields whose names are data. Rows must have a key.
    """
    none = F.lit(None)
    each = [
        F.when(
            f.value.isNotNull(),
            F.struct(
                F.lit(f.name).alias("name"),
                f.value.cast("string").alias("value"),
                (f.complete if f.complete is not None else none).cast("double").alias("complete"),
                (f.trust if f.trust is not None else none).cast("double").alias("trust"),
                (f.time if f.time is not None else none).cast("timestamp").alias("time"),
            ),
        ).cast(f"struct<{_RANK.replace(' ', ':').replace(',:', ',')}>")
        for f in fields
    ]
    every = F.array_compact(F.array(*each))
    if more is not None:
        every = F.concat(every, F.coalesce(more.cast(f"array<struct<{_RANK.replace(' ', ':').replace(',:', ',')}>>"), F.array()))
    return rows.select(key.alias("key"), F.col(rec).alias("rec"), F.inline(every))


def best_values(candidates: DataFrame) -> DataFrame:
    """The best candidate for each (key, name): most complete, most trusted, latest, smallest rec."""
    order = Window.partitionBy("key", "name").orderBy(
        F.desc_nulls_last("complete"), F.desc_nulls_last("trust"), F.desc_nulls_last("time"), F.asc("rec")
    )
    return candidates.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank")


def groups(rows: DataFrame, key: Column, rec: str, least: int = 2) -> DataFrame:
    """(key, first_no, n_rows) of the groups with at least ``least`` rows; combined before the shuffle."""
    keyed = rows.select(key.alias("key"), F.col(rec).alias("rec"))
    return keyed.groupBy("key").agg(F.min("rec").alias("first_no"), F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= least)


# webset_items: pages and their enrichments

_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
#: The keys of JSON objects, and what is left of a JSON value that holds nothing.
_JSON_KEY = r'"(?:[^"\\]|\\.)*"\s*:'
_HOLLOW = r'"\s*"|null|[\[\]{},:\s]'


def crawl_time(time: Column) -> Column:
    """A crawl time, or null where it is missing or a placeholder (any time in 1970, UTC)."""
    low, high = F.lit("1970-01-01T00:00:00Z").cast("timestamp"), F.lit("1971-01-01T00:00:00Z").cast("timestamp")
    return F.when(~((time >= low) & (time < high)), time)


def plugin_candidates(enrichments: Column) -> Column:
    """Usable plugin values of an enrichments JSON: parsed, success is true, data not empty at every depth."""
    entries = F.map_entries(F.from_json(enrichments, "map<string,string>", _JSON))
    parsed = F.transform(
        entries,
        lambda e: F.struct(e["key"].alias("name"), F.from_json(e["value"], "success boolean, data string, timestamp string", _JSON).alias("v")),
    )
    held = lambda d: F.when(
        d.rlike(r"^\s*[\[{]"), F.regexp_replace(F.regexp_replace(d, _JSON_KEY, ""), _HOLLOW, "") != ""
    ).otherwise(strip(d) != "")
    usable = F.filter(parsed, lambda e: e["v"]["success"] & held(e["v"]["data"]))
    stamp = lambda t: F.when(t.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)\s*$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.transform(
        usable,
        lambda e: F.struct(
            e["name"].alias("name"),
            e["v"]["data"].alias("value"),
            F.lit(None).cast("double").alias("complete"),
            F.lit(None).cast("double").alias("trust"),
            stamp(e["v"]["timestamp"]).try_cast("timestamp").alias("time"),
        ),
    )


def page_key(url: Column) -> Column:
    """16 bytes that stand for the page a url leads to; null without url."""
    return F.unhex(F.md5(canonical_url(url)))


def text_fields() -> list[Field]:
    """The title and the content of a page: the longest counts as most complete; a row is trusted if its content_hash is that of its
    content, raw or without outer white space; then the latest crawl. The content's value is only its hash, as texts are not shuffled."""
    content = F.when(strip(F.col("content")) != "", F.col("content"))
    stated = F.lower(strip(F.col("content_hash")))
    trust = F.when((stated == F.sha2(content, 256)) | (stated == F.sha2(strip(content), 256)), 1.0).otherwise(0.0)
    title = F.when(strip(F.col("title")) != "", F.col("title"))
    crawled = crawl_time(F.col("last_crawled_at"))
    return [
        Field("title", title, time=crawled, complete=F.length(strip(title)), trust=trust),
        Field("content", F.sha2(content, 256), time=crawled, complete=F.length(strip(content)), trust=trust),
    ]


def page_survivors(items: DataFrame, least: int = 2, more: list[Field] | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of rows of one page, and the row that holds each field's best value.

    Fields: ``last_crawled_at``, each plugin of ``enrichments``, and those in ``more``. Null urls form no group; null, hollow, failed and broken
    enrichments and placeholder dates are not usable; a plugin time that can't be read loses to any that can; equal times go
    to the smallest row_no. Extra columns are ignored.
    """
    items = items.filter(strip(F.col("url")) != "")
    crawled = crawl_time(F.col("last_crawled_at"))
    cand = field_candidates(
        items, page_key(F.col("url")), "row_no", [Field("last_crawled_at", crawled, time=crawled), *(more or [])], more=plugin_candidates(F.col("enrichments"))
    )
    return groups(items, page_key(F.col("url")), "row_no", least), best_values(cand)


def survivor_fields(items: DataFrame) -> DataFrame:
    """(first_no, field_name, row_no) for groups of two rows or more."""
    group, best = page_survivors(items)
    joined = group.select("key", "first_no").join(best.select("key", "name", "rec"), "key")
    return joined.select("first_no", F.col("name").alias("field_name"), F.col("rec").alias("row_no"))


def merged_pages(items: DataFrame) -> DataFrame:
    """One row for each page: its first row's id, url and webset, the best title, last_crawled_at and plugin values, and content_no, the
    row with the best content.

    ``enrichments`` becomes a JSON array of the plugins' {name, row_no, data} in order of their names. Titles and contents are chosen
    by completeness, trust and recency (text_fields); null where no row has any.
    """
    group, best = page_survivors(items, least=1, more=text_fields())
    own = ("last_crawled_at", "title", "content")
    one = lambda name, value: F.max(F.when(F.col("name") == name, F.col(value)))
    fields = best.groupBy("key").agg(
        one("last_crawled_at", "time").alias("last_crawled_at"), one("title", "value").alias("title"), one("content", "rec").alias("content_no"),
        F.array_sort(F.collect_list(F.when(~F.col("name").isin(*own), F.struct("name", F.col("rec").alias("row_no"), F.col("value").alias("data"))))).alias("plugins"),
    )
    first = items.select(F.col("row_no").alias("first_no"), "id", "webset_id", "url")
    return (
        group.join(fields, "key", "left")
        .join(first, "first_no")
        .select("first_no", "id", "webset_id", "url", "title", "content_no", "n_rows", "last_crawled_at", F.to_json("plugins").alias("enrichments"))
    )
