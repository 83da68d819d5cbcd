"""Relational queries: filters, joins, aggregates, sorts, set operations, mutations and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.operators import export, relational as R
from weirmill.tables import table

#: The queries' fixed "now"; the data ends before it.
NOW = "2024-12-31 00:00:00"


def now():
    return F.lit(f"{NOW}Z").cast("timestamp")


def flt_eq(s: SparkSession, d: str) -> DataFrame:
    return R.equal_filters(table(s, d, "monitors"), status="enabled", behavior_type="search", webset_id=None).select("id", "status", "behavior_type")


def flt_point(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "webset_items").filter("row_no = 1").select("row_no", "id", "url")


def flt_ilike(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "websets").filter(R.contains_term(F.col("name"), "robot") | R.contains_term(F.col("search_query"), "robot")).select("id", "name")


def flt_meta_eq(s: SparkSession, d: str) -> DataFrame:
    return R.metadata_filter(table(s, d, "webset_items"), "item_metadata", {"lang": "fr"}).select("row_no")


def flt_time_range(s: SparkSession, d: str) -> DataFrame:
    low, high = (F.lit(x).cast("timestamp") for x in ("2024-03-01T00:00:00Z", "2024-05-31T23:59:59Z"))
    return table(s, d, "monitor_runs").filter(F.col("started_at").between(low, high)).select("run_no", R.iso(F.col("started_at")).alias("started"))


def flt_not_null(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "webset_items").filter("enrichments is not null").select("row_no")


def flt_retention(s: SparkSession, d: str) -> DataFrame:
    kept = ~((F.col("status") == "completed") & (F.col("completed_at") < now() - F.expr("INTERVAL 7 DAYS")))
    return table(s, d, "monitor_runs").filter(F.coalesce(kept, F.lit(True))).select("run_no", "status")


def flt_in(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "websets").filter(F.lower("entity_type").isin("article", "company")).select("id", F.lower("entity_type").alias("entity_type"))


def flt_collection(s: SparkSession, d: str) -> DataFrame:
    return R.equal_filters(table(s, d, "ruvector_docs"), collection="papers").select("id", "collection")


def join_inner_runs(s: SparkSession, d: str) -> DataFrame:
    runs, mon = table(s, d, "monitor_runs"), table(s, d, "monitors")
    joined = runs.join(mon.select(F.col("id").alias("monitor_id"), "webset_id"), "monitor_id")
    return joined.groupBy("webset_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.coalesce("items_added", F.lit(0))).cast("long").alias("n_added"))


def join_semi_exists(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "webset_items").join(table(s, d, "websets").select(F.col("id").alias("webset_id")), "webset_id", "left_semi").select("row_no", "webset_id")


def _hashed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "webset_items").withColumn("hash", R.content_digest(F.col("content")))


def join_anti_hash(s: SparkSession, d: str) -> DataFrame:
    items = _hashed(s, d).select("row_no", "batch_no", "hash")
    last = items.filter("batch_no = 12")
    return R.unseen_hashes(last, items.filter("batch_no < 12"), "hash", [F.asc("row_no")]).select("row_no")


def join_anti_url(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "webset_items").select("row_no", "batch_no", "webset_id", "url")
    known = items.filter("batch_no < 12").select("webset_id", "url").distinct().withColumn("known", F.lit(True))
    last = items.filter("batch_no = 12").join(known, ["webset_id", "url"], "left")
    return last.groupBy("webset_id").agg(F.count_if(F.col("known").isNull()).alias("n_added"), F.count_if("known").alias("n_skipped"))


def join_left_merge(s: SparkSession, d: str) -> DataFrame:
    items = R.keep_first(table(s, d, "webset_items"), ["url"], [F.asc("row_no")])
    fetched = table(s, d, "fetch_results").filter("status = 200 and html is not null")
    pages = R.keep_first(fetched, ["url"], [F.asc("fetch_no")])
    meta = lambda c, k: F.when(c.isNotNull(), F.create_map(F.lit(k), c.cast("string")))
    left = items.select("url", "title", "content", meta(F.col("id"), "id").alias("meta"))
    right = pages.select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("html").alias("content"), meta(F.col("fetch_no"), "fetch_no").alias("meta"))
    out = R.merge_pages(left, right, "url")
    return out.select("url", "title", F.length("content").cast("long").alias("n_chars"), F.array_join(F.array_sort(F.map_keys("meta")), ",").alias("meta_keys"))


def join_fullouter_snapshot(s: SparkSession, d: str) -> DataFrame:
    items = _hashed(s, d)
    old = R.keep_first(items.filter("batch_no <= 6"), ["url"], [F.desc("row_no")])
    new = R.keep_first(items.filter("batch_no > 6"), ["url"], [F.desc("row_no")])
    return R.snapshot_changes(old, new, "url", "hash").groupBy("change").agg(F.count(F.lit(1)).alias("n_urls"))


def agg_dashboard(s: SparkSession, d: str) -> DataFrame:
    return R.dashboard(*(table(s, d, t) for t in ("websets", "webset_items", "monitors", "monitor_runs")), now())


def agg_stats(s: SparkSession, d: str) -> DataFrame:
    return R.webset_stats(table(s, d, "webset_items"))


def agg_run_summary(s: SparkSession, d: str) -> DataFrame:
    return R.run_summary(table(s, d, "monitor_runs"))


def agg_trending(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "ruvector_docs").select("collection", "created_at")
    return R.trending(df, "collection", "created_at", F.lit("2024-07-01T00:00:00Z").cast("timestamp"), "30d", 10)


def agg_collections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ruvector_docs").groupBy(F.coalesce("collection", F.lit("default")).alias("collection")).agg(F.count(F.lit(1)).alias("n_docs"))


def agg_service_stats(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs").agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct("collection").alias("n_collections"), F.count("parent_id").alias("n_children"))
    return docs.select("n_docs", "n_collections", "n_children")


def agg_domain_success(s: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[^:]+://([^/]+)", 1))
    rows = table(s, d, "fetch_results").groupBy(host.alias("host"))
    return rows.agg(F.count(F.lit(1)).alias("n_requests"), F.round(F.count_if(F.col("status") == 200) / F.count(F.lit(1)), 6).alias("success_rate"),
                    F.round(F.avg(F.when(F.col("status") == 200, F.col("load_time_ms"))), 4).alias("mean_ms"))


def agg_batch_summary(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "webset_items")
    return items.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.length("content") > 0).alias("n_successful"), F.count_if(~F.coalesce(F.length("content") > 0, F.lit(False))).alias("n_failed"))


def sort_page(s: SparkSession, d: str) -> DataFrame:
    return R.page(table(s, d, "websets"), [F.desc("updated_at"), F.asc("id")], 5, 10).select("id", "name")


def sort_nulls_last(s: SparkSession, d: str) -> DataFrame:
    return R.page(table(s, d, "monitors"), [F.desc_nulls_last("last_run_at"), F.asc("id")], 0, 50).select("id", R.iso(F.col("last_run_at")).alias("last_run"))


def topn_per_group(s: SparkSession, d: str) -> DataFrame:
    return R.newest(table(s, d, "monitor_runs").filter("monitor_id is not null"), "monitor_id", [F.desc_nulls_last("started_at"), F.desc("run_no")], 10).select("monitor_id", "run_no")


def set_keep_first(s: SparkSession, d: str) -> DataFrame:
    return R.keep_first(table(s, d, "webset_items").filter("content_hash is not null"), ["content_hash"], [F.asc("row_no")]).select("row_no", "content_hash")


def set_timeline(s: SparkSession, d: str) -> DataFrame:
    event = lambda df, at, kind, ref, detail: df.filter(F.col(at).isNotNull()).select(R.iso(F.col(at)).alias("at"), F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref"), F.coalesce(F.col(detail), F.lit("")).alias("detail"))
    return R.timeline(
        [event(table(s, d, "websets"), "created_at", "webset_created", "id", "name"), event(table(s, d, "monitor_runs"), "started_at", "monitor_run", "run_no", "status"), event(table(s, d, "webset_items"), "created_at", "item_added", "row_no", "url")], 60
    )


def set_difference(s: SparkSession, d: str) -> DataFrame:
    items = _hashed(s, d)
    return items.filter("batch_no = 12").select("hash").dropna().distinct().exceptAll(items.filter("batch_no < 12").select("hash").dropna().distinct())


def snk_upsert(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "webset_items")
    return R.latest_rows(items.filter("batch_no <= 6"), items.filter("batch_no > 6"), "id", [F.desc("row_no")]).select("id", "row_no")


def snk_cascade(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "websets").filter(F.lower("entity_type") == "company")
    left = R.cascade(table(s, d, "webset_items"), "webset_id", gone, "id").groupBy("webset_id").agg(F.count(F.lit(1)).alias("n_items"))
    return left


def snk_patch(s: SparkSession, d: str) -> DataFrame:
    monitors = table(s, d, "monitors")
    change = F.when(F.col("status") == "error", F.map_from_entries(F.array(F.struct(F.lit("status"), F.lit("enabled")), F.struct(F.lit("timezone"), F.lit(None).cast("string")))))
    patches = monitors.select("id", change.alias("changed")).filter("changed is not null")
    return R.patch(monitors, patches, "id", ["status", "timezone"]).select("id", "status", "timezone")


def snk_job_state(s: SparkSession, d: str) -> DataFrame:
    return R.job_status(table(s, d, "monitor_runs"), "id", "run_no")


def exp_csv(s: SparkSession, d: str) -> DataFrame:
    return export.csv_rows(table(s, d, "webset_items"))


def exp_markdown(s: SparkSession, d: str) -> DataFrame:
    return export.markdown(table(s, d, "websets"), table(s, d, "webset_items"))


def exp_json(s: SparkSession, d: str) -> DataFrame:
    return export.json_counts(export.json_documents(table(s, d, "websets"), table(s, d, "webset_items")))


_FUNCTIONS = (
    flt_eq, flt_point, flt_ilike, flt_meta_eq, flt_time_range, flt_not_null, flt_retention, flt_in, flt_collection, join_inner_runs, join_semi_exists, join_anti_hash, join_anti_url,
    join_left_merge, join_fullouter_snapshot, agg_dashboard, agg_stats, agg_run_summary, agg_trending, agg_collections, agg_service_stats, agg_domain_success, agg_batch_summary,
    sort_page, sort_nulls_last, topn_per_group, set_keep_first, set_timeline, set_difference, snk_upsert, snk_cascade, snk_patch, snk_job_state, exp_csv, exp_markdown, exp_json,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_ISO = "strftime({0} at time zone 'UTC', '%Y-%m-%d %H:%M:%S')".format
_T = f"timestamptz '{NOW}+00'"
_HASHED = "(select *, case when length(content) > 0 then sha256(content) end as hash from webset_items)"
ORACLE = {
    "flt_eq": "select id, status, behavior_type from monitors where status = 'enabled' and behavior_type = 'search'",
    "flt_point": "select row_no, id, url from webset_items where row_no = 1",
    "flt_ilike": "select id, name from websets where name ilike '%robot%' or search_query ilike '%robot%'",
    "flt_meta_eq": "select row_no from webset_items where json_extract_string(item_metadata, '$.lang') = 'fr'",
    "flt_time_range": f"select run_no, {_ISO('started_at')} as started from monitor_runs where started_at between timestamptz '2024-03-01 00:00:00+00' and timestamptz '2024-05-31 23:59:59+00'",
    "flt_not_null": "select row_no from webset_items where enrichments is not null",
    "flt_retention": f"select run_no, status from monitor_runs where coalesce(not (status = 'completed' and completed_at < {_T} - interval 7 day), true)",
    "flt_in": "select id, lower(entity_type) as entity_type from websets where lower(entity_type) in ('article', 'company')",
    "flt_collection": "select id, collection from ruvector_docs where collection = 'papers'",
    "join_inner_runs": "select m.webset_id, count(*) as n_runs, cast(sum(coalesce(items_added, 0)) as bigint) as n_added from monitor_runs r join monitors m on m.id = r.monitor_id group by 1",
    "join_semi_exists": "select row_no, webset_id from webset_items where webset_id in (select id from websets where id is not null)",
    "join_anti_hash": f"""select row_no from (select row_no, hash, row_number() over (partition by hash order by row_no) as r from {_HASHED} where batch_no = 12)
        where hash is null or (r = 1 and hash not in (select hash from {_HASHED} where batch_no < 12 and hash is not null))""",
    "join_anti_url": """select l.webset_id, count(*) filter (k.url is null) as n_added, count(*) filter (k.url is not null) as n_skipped
        from (select * from webset_items where batch_no = 12) l left join (select distinct webset_id, url from webset_items where batch_no < 12) k on k.webset_id = l.webset_id and k.url = l.url group by 1""",
    "join_left_merge": """with i as (select * from (select *, row_number() over (partition by url order by row_no) as r from webset_items) where r = 1),
        f as (select * from (select *, row_number() over (partition by url order by fetch_no) as r from fetch_results where status = 200 and html is not null) where r = 1)
        select i.url, coalesce(nullif(i.title, ''), regexp_extract(f.html, '<title>([^<]*)</title>', 1), i.title) as title, cast(length(coalesce(f.html, i.content)) as bigint) as n_chars,
        case when f.url is not null then 'fetch_no,id' else 'id' end as meta_keys from i left join f on f.url = i.url""",
    "join_fullouter_snapshot": f"""with o as (select url, hash from (select *, row_number() over (partition by url order by row_no desc) as r from {_HASHED} where batch_no <= 6) where r = 1),
        n as (select url, hash from (select *, row_number() over (partition by url order by row_no desc) as r from {_HASHED} where batch_no > 6) where r = 1)
        select case when o.url is null then 'added' when n.url is null then 'removed' when o.hash is not distinct from n.hash then 'unchanged' else 'updated' end as change, count(*) as n_urls
        from o full join n on o.url = n.url group by 1""",
    "agg_dashboard": f"""select 'total_websets' as metric, count(*) as n from websets union all select 'websets_created_24h', count(*) from websets where created_at >= {_T} - interval 1 day
        union all select 'total_items', count(*) from webset_items union all select 'enriched_items', count(enrichments) from webset_items union all select 'total_monitors', count(*) from monitors
        union all select 'active_monitors', count(*) from monitors where status = 'enabled' union all select 'runs_24h', count(*) from monitor_runs where started_at >= {_T} - interval 1 day
        union all select 'failed_runs', count(*) from monitor_runs where status = 'failed'""",
    "agg_stats": "select webset_id, count(*) as n_items, count(enrichments) as n_enriched, round(avg(length(content)), 6) as avg_content_length from webset_items group by 1",
    "agg_run_summary": """select monitor_id, count(*) as n_runs, count(*) filter (status = 'completed') as n_completed, count(*) filter (status = 'failed') as n_failed,
        cast(sum(coalesce(items_added, 0) + coalesce(items_updated, 0)) as bigint) as n_changed from monitor_runs group by 1""",
    "agg_trending": """select collection, n, n_before, case when n_before > 0 then round(100.0 * (n - n_before) / n_before, 6) end as change_percent from (
        select collection, count(*) filter (created_at >= timestamptz '2024-06-01 00:00:00+00') as n, count(*) filter (created_at < timestamptz '2024-06-01 00:00:00+00') as n_before
        from ruvector_docs where collection is not null and created_at >= timestamptz '2024-05-02 00:00:00+00' and created_at <= timestamptz '2024-07-01 00:00:00+00' group by 1) where n > 0 order by n desc, collection limit 10""",
    "agg_collections": "select coalesce(collection, 'default') as collection, count(*) as n_docs from ruvector_docs group by 1",
    "agg_service_stats": "select count(*) as n_docs, count(distinct collection) as n_collections, count(parent_id) as n_children from ruvector_docs",
    "agg_domain_success": """select lower(regexp_extract(url, '^[^:]+://([^/]+)', 1)) as host, count(*) as n_requests, round(count(*) filter (status = 200) / count(*), 6) as success_rate,
        round(avg(load_time_ms) filter (status = 200), 4) as mean_ms from fetch_results group by 1""",
    "agg_batch_summary": """select batch_no, count(*) as n_total, count(*) filter (length(content) > 0) as n_successful, count(*) filter (not coalesce(length(content) > 0, false)) as n_failed from webset_items group by 1""",
    "sort_page": "select id, name from websets order by updated_at desc nulls last, id limit 10 offset 5",
    "sort_nulls_last": f"select id, {_ISO('last_run_at')} as last_run from monitors order by last_run_at desc nulls last, id limit 50",
    "topn_per_group": "select monitor_id, run_no from (select *, row_number() over (partition by monitor_id order by started_at desc nulls last, run_no desc) as r from monitor_runs where monitor_id is not null) where r <= 10",
    "set_keep_first": "select min(row_no) as row_no, content_hash from webset_items where content_hash is not null group by content_hash",
    "set_timeline": f"""select * from (
        select * from (select {_ISO('created_at')} as at, 'webset_created' as kind, id as ref, coalesce(name, '') as detail from websets where created_at is not null order by 1 desc, 2, 3 limit 20)
        union all select * from (select {_ISO('started_at')}, 'monitor_run', cast(run_no as varchar), coalesce(status, '') from monitor_runs where started_at is not null order by 1 desc, 2, 3 limit 20)
        union all select * from (select {_ISO('created_at')}, 'item_added', cast(row_no as varchar), coalesce(url, '') from webset_items where created_at is not null order by 1 desc, 2, 3 limit 20)) order by 1 desc, 2, 3 limit 60""",
    "set_difference": f"select distinct hash from {_HASHED} where batch_no = 12 and hash is not null except select hash from {_HASHED} where batch_no < 12",
    "snk_upsert": "select id, max(row_no) as row_no from webset_items where id is not null group by id union all select id, row_no from webset_items where id is null",
    "snk_cascade": "select webset_id, count(*) as n_items from webset_items where webset_id is null or webset_id not in (select id from websets where lower(entity_type) = 'company') group by 1",
    "snk_patch": "select id, case when status = 'error' then 'enabled' else status end as status, case when status = 'error' then null else timezone end as timezone from monitors",
    "snk_job_state": "select id, max_by(status, run_no) as status, count(*) as n_events from monitor_runs group by id",
    "exp_csv": """select coalesce(id, '') as id, coalesce(url, '') as url, coalesce(title, '') as title, coalesce(content_hash, '') as content_hash, coalesce(item_metadata, '') as metadata,
        coalesce(enrichments, '') as enrichments, coalesce(strftime(created_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S'), '') as created_at from webset_items""",
    "exp_markdown": """with i as (select w.id, coalesce(nullif(w.name, ''), 'Untitled') as name, i.title, i.url, i.row_no, row_number() over (partition by w.id order by i.created_at desc nulls last, i.row_no) as r
        from websets w left join webset_items i on i.webset_id = w.id)
        select id as webset_id, case when row_no is null then 0 else r end as part, case when row_no is null then 'No items' else '## ' || r || '. ' || coalesce(nullif(title, ''), 'Untitled') || chr(10) || 'URL: ' || coalesce(url, '') end as section from i""",
    "exp_json": "select w.id as webset_id, count(i.row_no) as total_items from websets w left join webset_items i on i.webset_id = w.id group by 1",
}
