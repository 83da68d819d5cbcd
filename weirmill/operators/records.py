"""Single-record mutations, numbering in batches, dates, schedules and choices around websets, monitors and crawls."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weirmill.functions.text import strip, words
from weirmill.operators.relational import content_digest
from weirmill.operators.textops import content_sha
from weirmill.session import stored


def update_items(items: DataFrame, patches: DataFrame, key: str, now: Column) -> DataFrame:
    """Items with the patches' non-null fields; new content also gets its hash and crawl time. ``patches`` is unique in ``key``."""
    fields = [c for c in patches.columns if c != key]
    joined = items.join(patches.select(key, *(F.col(c).alias(f"__{c}") for c in fields)), key, "left")
    values = {c: F.coalesce(f"__{c}", c) for c in fields}
    if "content" in fields:
        values["content_hash"] = F.when(F.col("__content").isNotNull(), F.sha2("__content", 256)).otherwise(F.col("content_hash"))
        values["last_crawled_at"] = F.when(F.col("__content").isNotNull(), now).otherwise(F.col("last_crawled_at"))
    return joined.withColumns(values).select(items.columns)


def record_runs(monitors: DataFrame, runs: DataFrame) -> DataFrame:
    """Monitors with last_run_at moved on to their newest run's start; combined before the shuffle."""
    newest = runs.filter("monitor_id is not null").groupBy(F.col("monitor_id").alias("id")).agg(F.max("started_at").alias("__at"))
    return monitors.join(newest, "id", "left").withColumn("last_run_at", F.greatest("last_run_at", "__at")).select(monitors.columns)


def with_collection(collections: DataFrame, name: str) -> DataFrame:
    """A collection's catalogue entry added, if it is not there; documents are not touched."""
    return collections.unionByName(collections.sparkSession.createDataFrame([(name,)], "collection string")).distinct()


def without_collection(collections: DataFrame, name: str) -> DataFrame:
    return collections.filter(~F.col("collection").eqNullSafe(name))


def first_match(items: DataFrame, order: str, **wanted: str) -> DataFrame:
    """The first row that equals every wanted value."""
    for column, value in wanted.items():
        items = items.filter(F.col(column) == value)
    return items.orderBy(order).limit(1)


def greedy_unique(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Rows without content, and of the others the first of each content hash."""
    hashed = rows.withColumn("__hash", content_digest(F.col(text)))
    bare = hashed.filter(F.col("__hash").isNull())
    first = hashed.filter(F.col("__hash").isNotNull()).withColumn("__rank", F.row_number().over(Window.partitionBy("__hash").orderBy(order))).filter("__rank = 1")
    return bare.unionByName(first.drop("__rank")).drop("__hash")


def content_hash(text: Column, kind: str) -> Column:
    """The content hash of the named kind; an unknown kind is an error."""
    kinds = {"sha256": lambda c: F.sha2(c, 256), "md5": F.md5, "normalized": content_sha}
    if kind not in kinds:
        raise ValueError(f"unknown hash {kind!r}; one of {sorted(kinds)}")
    return kinds[kind](text)


# numbering


def numbered(df: DataFrame, order: Sequence[str], name: str = "no") -> DataFrame:
    """``df`` with each row's number from 0 in the given order, without bringing it into one task: rows are sorted into ranges,
    counted there, and the ranges' first numbers, one a range, are added."""
    ranges = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    shift = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")  # a row a range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranges.withColumn("__inside", inside).join(F.broadcast(shift), "__range").withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def in_batches(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``df`` with ``batch``: rows 0 to size - 1 are batch 0, and so on."""
    return numbered(df, order, "__no").withColumn("batch", F.expr(f"__no div {size}")).drop("__no")


def numbered_within(df: DataFrame, key: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with each row's number from 1 within its key, in the given order: a key of any size is spread over ranges of it."""
    ranges = stored(df.repartitionByRange(F.col(key), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"))
    shift = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(key).orderBy("__range")) - F.col("__n")).drop("__n")  # rows of a key: one a range
    inside = F.row_number().over(Window.partitionBy("__range", key).orderBy(*order))
    return ranges.withColumn("__inside", inside).join(shift, [key, "__range"]).withColumn(name, (F.col("__before") + F.col("__inside")).cast("int")).drop("__range", "__inside", "__before")


def context(text: Column, part: Column, chars: int) -> Column:
    """What stands up to ``chars`` characters before and after the first place of a part, without outer white space; null if nothing."""
    at = F.position(part, text)
    begin = F.greatest(F.lit(1), at - chars)
    none = F.lit("")
    before, after = F.substring(text, begin, at - begin), F.substring(text, at + F.length(part), F.lit(chars))
    return F.when(at > 0, F.struct(F.nullif(strip(before), none).alias("before"), F.nullif(strip(after), none).alias("after")))


# crawls


def choose_proxy(stats: DataFrame, strategy: str, turn: int = 0) -> DataFrame:
    """The proxy to use next (``stats``: url, healthy, total_requests, average_ms, priority): of the healthy ones, or of all if none is.

    Strategies: round-robin (by ``turn``), least-used, fastest (unmeasured last), priority; ties by url.
    """
    anywhere = Window.partitionBy()  # proxies are configuration, not data
    able = stats.withColumn("__any", F.max("healthy").over(anywhere)).filter(F.col("healthy") | ~F.col("__any")).drop("__any")
    orders = {"least-used": [F.asc("total_requests")], "fastest": [F.asc_nulls_last("average_ms")], "priority": [F.desc("priority")]}
    if strategy == "round-robin":
        listed = able.agg(F.array_sort(F.collect_list("url")).alias("urls"))
        return listed.filter(F.size("urls") > 0).select(F.expr(f"urls[{turn + 1} % size(urls)]").alias("url"))
    if strategy not in orders:
        raise ValueError(f"unknown strategy {strategy!r}")
    return able.orderBy(*orders[strategy], "url").limit(1).select("url")


def adjusted_rate(rate: Column, n: Column, success_share: Column, errors_in_row: Column, default: float, configured: Column) -> Column:
    """A domain's next rate: halved (0.1 at least) after three errors in a row, else a tenth more, if the domain has a setting of its
    own, after a hundred requests with over 95 % success, up to twice the default."""
    more = F.when(configured & (n >= 100) & (success_share > 0.95) & (rate * 1.1 <= 2 * default), rate * 1.1).otherwise(rate)
    return F.when(errors_in_row >= 3, F.greatest(rate * 0.5, F.lit(0.1))).otherwise(more)


def worker_stats(log: DataFrame, worker: str, ok: Column) -> DataFrame:
    """Tasks, successes and failures of each worker."""
    return log.groupBy(worker).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"))


def token_estimate(text: Column) -> Column:
    """Tokens of a message by its white-space words, 1.3 each, cut to a whole number."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("long")


# dates

#: Fixed value: date formats tried in order after ISO 8601.
FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss")


def page_date(text: Column) -> Column:
    """A page's date: ISO 8601 first, then FORMATS; null if none fits."""
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"), F.try_to_timestamp(text))
    return F.coalesce(iso, *(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))


def feed_date(text: Column) -> Column:
    """A feed's date: ISO 8601, or the form of mail headers, with or without weekday."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|UT|Z)$", " +0000")
    mail = F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")))
    return F.coalesce(F.when(text.rlike(r"^\d{4}-"), page_date(text)), mail)


# monitors


def to_run(monitors: DataFrame, force: bool = False) -> DataFrame:
    """The monitors that may run: disabled ones only if forced."""
    return monitors if force else monitors.filter(F.coalesce(F.col("status") != "disabled", F.lit(True)))


#: Fixed value: what a monitor can do.
BEHAVIORS = ("search", "refresh", "hybrid")


def checked_settings(monitors: DataFrame, websets: DataFrame) -> DataFrame:
    """(id, valid, error) of each monitor's settings, without a run."""
    known = websets.select(F.col("id").alias("webset_id"), F.lit(True).alias("__known")).dropna().distinct()
    error = F.when(F.col("__known").isNull(), F.concat(F.lit("Webset "), F.coalesce("webset_id", F.lit("None")), F.lit(" not found"))).when(
        ~F.coalesce(F.col("behavior_type").isin(*BEHAVIORS), F.lit(False)), F.concat(F.lit("Unknown behavior "), F.coalesce("behavior_type", F.lit("None")))
    )
    return monitors.join(known, "webset_id", "left").select("id", error.isNull().alias("valid"), error.alias("error"))


@lru_cache(maxsize=10_000)
def cron_fields(cron: str) -> tuple[frozenset[int], ...] | None:
    """Minutes, hours, days, months and weekdays (0 is Sunday) of a five-field expression; None if it cannot be read."""
    bounds = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
    parts = cron.split()
    if len(parts) != 5:
        return None
    out = []
    try:
        for part, (low, high) in zip(parts, bounds):
            values: set[int] = set()
            for piece in part.split(","):
                span, _, step = piece.partition("/")
                a, dash, b = span.partition("-")
                first, last = (low, high) if span == "*" else (int(a), int(b) if dash else high if step else int(a))
                if not low <= first <= last <= high:
                    return None
                values |= set(range(first, last + 1, int(step or 1)))
            out.append(frozenset(v % 7 for v in values) if high == 7 else frozenset(values))
    except ValueError:
        return None
    return tuple(out)


def next_run(cron: str | None, zone: str | None, after: dt.datetime | None) -> dt.datetime | None:
    """The first minute after ``after`` (UTC) that a schedule names in its time zone (UTC without one); None if there is none in four
    years. Days and weekdays both given: either is enough. Missed runs count as one, as only the next is given."""
    fields = cron_fields(cron) if cron else None
    if fields is None or after is None:
        return None
    minutes, hours, days, months, weekdays = fields
    try:
        tz = ZoneInfo(zone or "UTC")
    except Exception:  # an unknown zone
        return None
    either = len(days) < 31 and len(weekdays) < 7
    start = after.replace(tzinfo=dt.timezone.utc).astimezone(tz)
    day = start.date()
    for _ in range(4 * 366):
        in_days, in_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        if day.month in months and (in_days or in_week if either else in_days and in_week):
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = dt.datetime(day.year, day.month, day.day, h, m, tzinfo=tz).astimezone(dt.timezone.utc)
                    if at > start:
                        return at.replace(tzinfo=None)
        day += dt.timedelta(days=1)
    return None


def next_runs(cron: Column, zone: Column, after: Column) -> Column:
    """next_run() of a column, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for crons, zones, afters in batches:
            times = [next_run(c, z, None if a is None else dt.datetime.fromisoformat(a)) for c, z, a in zip(crons, zones, afters)]
            yield pd.Series([None if t is None else t.strftime("%Y-%m-%d %H:%M:%S") for t in times], dtype=object)

    return F.to_timestamp(run(cron, zone, F.date_format(after, "yyyy-MM-dd HH:mm:ss")))


# chunks


def sliding_chunks(text: str | None, size: int = 512, overlap: int = 50, least: int = 100, at_sentences: bool = True) -> list[tuple[int, int, str]]:
    """(no, start, piece) of windows over a text, each ended at its last sentence end after ``least`` characters.

    A text of at most ``size`` is one piece. The windows begin ``size - overlap`` apart; the last is the first whose piece reaches the
    end. Pieces under ``least`` characters are left out.
    """
    if text is None or size <= overlap:
        return []
    if len(text) <= size:
        return [(0, 0, text)]
    out = []
    for at in range(0, len(text), size - overlap):
        piece = text[at : at + size]
        if at_sentences and len(piece) > least:
            for end in (". ", "! ", "? ", ".\n", "!\n", "?\n"):
                cut = piece.rfind(end)
                if cut > least:
                    piece = piece[: cut + 1].strip()
                    break
        if len(piece) >= least:
            out.append((len(out), at, piece))
        if at + len(piece) >= len(text):
            break
    return out


_CHUNK = T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("piece", T.StringType())]))


def sliding(text: Column, at_sentences: bool = True) -> Column:
    @F.pandas_udf(_CHUNK)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"no": n, "start_pos": a, "piece": p} for n, a, p in sliding_chunks(x, at_sentences=at_sentences)] for x in batch])

    return run(text)
