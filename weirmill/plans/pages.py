"""Queries of page parsing, enrichment, model answers, monitors, rate limits and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.operators import enrich, monitor
from weirmill.operators.relational import content_digest, keep_first
from weirmill.session import scratch_path
from weirmill.sources.html import parse_page
from weirmill.streaming import windows
from weirmill.tables import table


def _parsed(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "fetch_results").filter("html is not null")
    return pages.select("fetch_no", parse_page("html", "url").alias("p"))


def prs_pages(s: SparkSession, d: str) -> DataFrame:
    p = _parsed(s, d)
    return p.select(
        "fetch_no", "p.title", "p.language", "p.description", "p.site_name", F.size("p.links").alias("n_links"), F.size("p.headings").alias("n_headings"), F.size("p.tables").alias("n_tables"), F.length("p.main_text").alias("n_main")
    )


def prs_title(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fetch_results").filter("html is not null").select("fetch_no", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def prs_links(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("fetch_no", F.posexplode("p.links").alias("pos", "l")).select("fetch_no", "pos", "l.url", "l.text", "l.is_external")


def prs_link_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fetch_results").filter("html is not null").select("fetch_no", F.regexp_count("html", F.lit('<a href="[^"#]')).alias("n_links"))


def prs_headings(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("fetch_no", F.posexplode("p.headings").alias("pos", "h")).select("fetch_no", "pos", "h.level", "h.text")


def prs_tables(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("fetch_no", F.posexplode("p.tables").alias("pos", "t")).select("fetch_no", "pos", F.to_json("t.headers").alias("headers"), F.size("t.rows").alias("n_rows"))


def prs_markdown(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("fetch_no", F.md5("p.markdown").alias("digest"), F.length("p.markdown").alias("n_chars"))


def met_og(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("fetch_no", F.explode("p.og").alias("key", "value"))


def cit_all(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("fetch_no", F.explode("p.citations").alias("c")).select("fetch_no", "c.id", "c.kind", "c.position")


def cit_by_type(s: SparkSession, d: str) -> DataFrame:
    return cit_all(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def cit_inline(s: SparkSession, d: str) -> DataFrame:
    marks = F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), 1)
    return table(s, d, "documents").select("doc_id", F.size(marks).alias("n_marks"), F.array_join(marks, ",").alias("marks"))


def enr_company(s: SparkSession, d: str) -> DataFrame:
    data = enrich.company(F.col("text"))
    return table(s, d, "documents").select("doc_id", data.alias("c")).select("doc_id", "c.founded", "c.employees", "c.industry", "c.growth_rate")


def enr_person(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", enrich.person(F.col("text")).alias("p")).select("doc_id", "p.email", "p.years", "p.skills")


def enr_pipeline(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "webset_items").select("row_no", "content")
    done = enrich.enrich(items, "content", ["company", "person", "unknown"], {"person": F.get_json_object("company.data", "$.founded").isNull()})
    return done.select("row_no", F.col("company.success").alias("company_ok"), F.coalesce("person.success", F.lit(False)).alias("person_ok"), F.col("unknown.error").alias("unknown_error"))


def enr_once(s: SparkSession, d: str) -> DataFrame:
    done = enrich.enrich_once(table(s, d, "documents"), "text", ["summary"])
    return done.select("digest", F.get_json_object("summary.data", "$.n_chars").cast("long").alias("n_chars"))


def llm_list(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ruvector_docs").select("id", F.posexplode(enrich.parse_list(F.col("text"))).alias("pos", "item"))


def llm_json(s: SparkSession, d: str) -> DataFrame:
    got = enrich.parse_json(F.col("search_criteria"), "domains array<string>, keywords array<string>")
    return table(s, d, "websets").select("id", got.alias("g")).select("id", F.array_join("g.domains", ",").alias("domains"), F.size("g.keywords").alias("n_keywords"))


def llm_prompt(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "websets").select("id", enrich.prompt("List {kind} for: {query}", kind=F.col("entity_type"), query=F.col("search_query")).alias("prompt"))


def agg_llm_cost(s: SparkSession, d: str) -> DataFrame:
    names = [("small", 0.1, 0.4), ("medium", 0.5, 1.5), ("large", 3.0, 15.0)]
    models = s.createDataFrame(names, "name string, price_in double, price_out double")
    pick = F.element_at(F.array(*(F.lit(n) for n, _, _ in names)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return enrich.usage_cost(table(s, d, "documents").select(pick.alias("name"), F.col("n_chars").alias("tokens")), models)


def mon_search(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "webset_items").withColumn("mark", content_digest(F.col("content")))
    return monitor.search_run(items.filter("batch_no = 12"), items.filter("batch_no < 12"), "url", "mark", "row_no")


def mon_refresh(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "webset_items").withColumn("mark", content_digest(F.col("content")))
    first = keep_first(items, ["url"], [F.asc("row_no")])
    again = keep_first(items, ["url"], [F.desc("row_no")])
    return monitor.refresh_run(first, again, "url", "mark").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def mon_retry(s: SparkSession, d: str) -> DataFrame:
    return monitor.retriable(table(s, d, "monitor_runs").filter("monitor_id is not null"), "monitor_id", "run_no")


def rtl_backoff(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "events").select("user_id", "event_id", "event_type")
    out = monitor.error_streaks(ev, "user_id", "event_id", F.col("event_type") == "error")
    return out.select("event_id", "streak", monitor.backoff(F.col("streak")).alias("wait"))


def rtl_bucket(s: SparkSession, d: str) -> DataFrame:
    return monitor.rate_limited(table(s, d, "events"), "user_id", "event_id", "ts", 0.0001, 3.0)


def ext_windows(s: SparkSession, d: str) -> DataFrame:
    """Daily windows of the event stream, run to its end; the same as the batch."""
    path = scratch_path(s, "windows")
    counts = windows.windowed_counts(windows.event_stream(s, d)).writeStream.outputMode("complete").option("checkpointLocation", f"{path}/marks")
    # each trigger's whole result replaces the one before, as a table in the shared folder
    counts.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/result")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/result").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


_FUNCTIONS = (
    prs_pages, prs_title, prs_links, prs_link_counts, prs_headings, prs_tables, prs_markdown, met_og, cit_all, cit_by_type, cit_inline, enr_company, enr_person, enr_pipeline, enr_once, llm_list, llm_json, llm_prompt,
    agg_llm_cost, mon_search, mon_refresh, mon_retry, rtl_backoff, rtl_bucket, ext_windows,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _sql_first(patterns, flags: str = "i") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1, '{flags}'), '')" for p in patterns) + ")"


_INDUSTRY = "case " + " ".join(f"when regexp_matches(lower(text), '{'|'.join(ws)}') then '{name}'" for name, ws in enrich.INDUSTRIES) + " end"
_SKILLS = "array_to_string(list_filter([" + ", ".join(f"'{x}'" for x in enrich.SKILLS) + "], lambda x: contains(lower(text), x)), ',')"
_MARKED = "(select *, case when length(content) > 0 then sha256(content) end as mark from webset_items)"
ORACLE = {
    "prs_title": "select fetch_no, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from fetch_results where html is not null",
    "prs_link_counts": "select fetch_no, cast(len(regexp_extract_all(html, '<a href=\"[^\"#]')) as int) as n_links from fetch_results where html is not null",
    "cit_inline": r"select doc_id, cast(len(regexp_extract_all(text, '\[(\d+)\]', 1)) as int) as n_marks, array_to_string(regexp_extract_all(text, '\[(\d+)\]', 1), ',') as marks from documents",
    "enr_company": f"select doc_id, {_sql_first(enrich.FOUNDED)} as founded, replace({_sql_first(enrich.EMPLOYEES)}, ',', '') as employees, {_INDUSTRY} as industry, {_sql_first(enrich.GROWTH)} as growth_rate from documents",
    "enr_person": f"select doc_id, nullif(regexp_extract(text, '{enrich.EMAIL}', 1), '') as email, {_sql_first(enrich.YEARS)} as years, {_SKILLS} as skills from documents",
    "enr_once": "select sha256(text) as digest, any_value(length(text)) as n_chars from documents group by 1",
    "llm_json": """select id, array_to_string(from_json(json_extract(search_criteria, '$.domains'), '["VARCHAR"]'), ',') as domains, cast(json_array_length(search_criteria, '$.keywords') as int) as n_keywords from websets""",
    "llm_prompt": "select id, 'List ' || coalesce(entity_type, '') || ' for: ' || coalesce(search_query, '') as prompt from websets",
    "agg_llm_cost": """select case doc_id % 3 when 0 then 'small' when 1 then 'medium' else 'large' end as name, count(*) as n_requests, cast(sum(n_chars) as bigint) as tokens,
        round(sum(n_chars / 2000.0 * case doc_id % 3 when 0 then 0.5 when 1 then 2.0 else 18.0 end), 6) as cost from documents group by 1""",
    "mon_search": f"""with k as (select * from {_MARKED} where batch_no < 12), n as (select *, row_number() over (partition by mark order by row_no) as r from {_MARKED} where batch_no = 12)
        select row_no, case when mark is not null and (mark in (select mark from k where mark is not null) or r > 1) then 'skip_hash' when url in (select url from k where url is not null) then 'skip_url' else 'add' end as action from n""",
    "mon_refresh": f"""select case when a.mark is not distinct from b.mark then 'unchanged' else 'updated' end as change, count(*) as n from (select url, min(row_no) as f, max(row_no) as l from webset_items group by 1) u
        join {_MARKED} a on a.row_no = u.f join {_MARKED} b on b.row_no = u.l group by 1""",
    "mon_retry": "select monitor_id from (select monitor_id, max_by(status, run_no) as s from monitor_runs where monitor_id is not null group by 1) where s = 'failed'",
    "rtl_backoff": """with o as (select *, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id) as b from events),
        s as (select event_id, cast(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id, b order by event_id) as bigint) as streak from o)
        select event_id, streak, case when streak <= 0 then 0.0 else least(pow(2.0, streak), 300.0) end as wait from s""",
    "ext_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
