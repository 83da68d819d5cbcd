"""Queries of embeddings and their cache, hybrid search, single-record mutations, dates, schedules, choices and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.operators import enrich, graph, hybrid, monitor, records as K, relational as R, rerank, vector
from weirmill.operators.textops import content_sha
from weirmill.functions.text import WHITE
from weirmill.plans import pages as PP, relational as RP, search as SP
from weirmill.session import stored
from weirmill.sources import html
from weirmill.tables import table

NOW = "2024-12-31 00:00:00"


def now():
    return F.lit(f"{NOW}Z").cast("timestamp")


def vec_embed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.md5(F.to_json(F.transform(hybrid.embedded(F.col("text"), 64), lambda x: F.round(x, 4)))).alias("digest"))


def vec_cache(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text", "collected_at")
    old = docs.filter("doc_id % 2 = 0").select(F.sha2("text", 256).alias("text_sha"), F.array(F.lit(1.0)).alias("cached"), F.col("collected_at").alias("cached_at"))
    found = hybrid.cached_vectors(docs.select("doc_id", "text"), old.filter("cached_at is not null"), "text", F.lit("2024-06-07T00:00:00Z").cast("timestamp"))
    return found.select("doc_id", F.col("cached").isNotNull().alias("hit"))


def vec_zero(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    v = hybrid.or_zero(F.col("embedding"), 64)
    return docs.select("doc_id", F.round(vector.cosine(v, v), 6).alias("score"))


def vec_log(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "events")
    both = log.filter("event_id % 2 = 0").unionByName(log.filter("event_id % 2 = 1"))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def prj_vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").drop("embedding").select("vec_id")


def hyb_search(s: SparkSession, d: str) -> DataFrame:
    """Search with alpha 0, 0.5 and 1; a query's vector is the one numbered by the query's length."""
    queries = table(s, d, "websets").filter("search_query is not null").select(F.col("id").alias("query_key"), F.length("search_query").cast("long").alias("vec_id"))
    rows = table(s, d, "embeddings")
    wanted = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    near = vector.top_similar(rows, wanted, "vec_id", "embedding", 20, rows.count(), wanted.count(), exclude_self=False)
    near = near.withColumn("score", F.round("score", 6)).join(queries.withColumnRenamed("vec_id", "query_id"), "query_id")
    near = stored(near.select("query_key", F.col("id").alias("key"), "score", "rank"), "near")
    words_list = stored(SP.lex_bm25(s, d), "lexical")
    parts = [hybrid.hybrid_search(words_list, near, "query_key", "key", a, 10).select(F.lit(a).alias("alpha"), "query_key", "key", F.round("score", 6).alias("score"), "rank") for a in (0.0, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def hyb_stats(s: SparkSession, d: str) -> DataFrame:
    return hybrid.index_statistics(table(s, d, "documents"), "text", 0.5)


def qry_temporal(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "websets").filter("search_query is not null").select("id", F.concat_ws(" ", "search_query", F.when(F.col("entity_type").isNotNull(), F.lit("2024"))).alias("query"))


def qry_fetch(s: SparkSession, d: str) -> DataFrame:
    """Results known by url only are joined to crawled pages, then those whose content was seen are left out."""
    pages = table(s, d, "fetch_results").filter("status = 200 and html is not null").groupBy("url").agg(F.min_by("html", "fetch_no").alias("html"))
    rows = table(s, d, "webset_items").filter("batch_no = 12").select("row_no", "url", "content").join(pages, "url", "left")
    rows = rows.withColumn("hash", R.content_digest(F.coalesce("html", "content")))
    return R.unseen_hashes(rows, RP._hashed(s, d).filter("batch_no < 12").select("hash"), "hash", [F.asc("row_no")]).select("row_no")


def flt_first(s: SparkSession, d: str) -> DataFrame:
    items = table(s, d, "webset_items")
    row = items.filter("webset_id is not null and url is not null").orderBy("row_no").limit(1).select("webset_id", "url").first()
    return K.first_match(items, "row_no", webset_id=row.webset_id, url=row.url).select("row_no", "id") if row else items.limit(0).select("row_no", "id")


def join_feedback(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs").select(F.col("id").alias("ruvector_doc_id"), "collection")
    return table(s, d, "webset_items").select("ruvector_doc_id").join(docs, "ruvector_doc_id").groupBy("collection").agg(F.count(F.lit(1)).alias("n_items"))


def agg_workers(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "monitor_runs").filter("monitor_id is not null")
    return K.worker_stats(runs, "monitor_id", F.coalesce(F.col("status") == "completed", F.lit(False)))


def agg_tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", K.token_estimate(F.col("text")).alias("n_tokens_about"))


def agg_graph(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs")
    return docs.agg(F.count_distinct("id").alias("n_nodes"), F.count("parent_id").alias("n_edges"))


def srt_trend(s: SparkSession, d: str) -> DataFrame:
    t = RP.agg_trending(s, d)
    return t.orderBy(F.desc(F.coalesce(F.col("change_percent") > 0, F.lit(False))), F.desc("n"), "collection").limit(3)


def srt_pages(s: SparkSession, d: str) -> DataFrame:
    return R.page(table(s, d, "webset_items").filter("enrichments is not null"), [F.asc("row_no")], 20, 20).select("row_no", "id")


def snk_update(s: SparkSession, d: str) -> DataFrame:
    items = R.keep_first(table(s, d, "webset_items").filter("id is not null"), ["id"], [F.desc("row_no")])
    patches = items.filter("row_no % 3 = 0").select("id", F.concat(F.lit("New "), "title").alias("title"), F.when(F.col("row_no") % 2 == 0, F.concat("id", F.lit(" text"))).alias("content"))
    out = K.update_items(items, patches, "id", now())
    return out.select("id", "title", "content_hash", R.iso(F.col("last_crawled_at")).alias("crawled"))


def snk_runs(s: SparkSession, d: str) -> DataFrame:
    return K.record_runs(table(s, d, "monitors"), table(s, d, "monitor_runs")).select("id", R.iso(F.col("last_run_at")).alias("last_run"))


def snk_collections(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "ruvector_docs").select("collection").dropna().distinct()
    return K.without_collection(K.with_collection(names, "new ones"), "papers")


def snk_cascade_all(s: SparkSession, d: str) -> DataFrame:
    """Rows left of each table when websets are deleted with their items, monitors and runs."""
    gone = table(s, d, "websets").filter(F.lower("entity_type") == "company")
    items = R.cascade(table(s, d, "webset_items"), "webset_id", gone, "id")
    monitors = table(s, d, "monitors")
    left = R.cascade(monitors, "webset_id", gone, "id")
    dead = monitors.join(gone.select(F.col("id").alias("webset_id")).distinct(), "webset_id", "left_semi")
    runs = R.cascade(table(s, d, "monitor_runs"), "monitor_id", dead, "id")
    count = lambda df, name: df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
    return count(items, "webset_items").unionByName(count(left, "monitors")).unionByName(count(runs, "monitor_runs"))


def exp_graph(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs").filter("id is not null")
    return graph.cytoscape(docs, "id", ["collection"], docs.filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"), F.lit("CHILD_OF").alias("label")))


def grf_nodes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ruvector_docs").select("id").dropna().distinct()


def grf_mentions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ruvector_docs").select("id", F.explode(graph.entities(F.col("text"))).alias("entity")).distinct()


def chk_sliding(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.inline(K.sliding(F.col("text"), at_sentences=False)))


def chk_sliding_sentences(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.inline(K.sliding(F.col("text"))))


def dup_known(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", content_sha(F.col("text")).alias("sha"))
    return docs.filter("doc_id % 2 = 1").join(docs.filter("doc_id % 2 = 0").select("sha").distinct(), "sha", "left_semi").select("doc_id")


def dup_greedy(s: SparkSession, d: str) -> DataFrame:
    return K.greedy_unique(table(s, d, "webset_items").select("row_no", "content"), "content", "row_no").select("row_no")


def prs_dates(s: SparkSession, d: str) -> DataFrame:
    """Days written in each format and read back."""
    rows = table(s, d, "parsed_content").filter("pub_date is not null").select("parsed_no", "pub_date")
    form = F.pmod("parsed_no", F.lit(len(K.FORMATS)))
    text = F.coalesce(*(F.when(form == i, F.date_format("pub_date", f)) for i, f in enumerate(K.FORMATS)))
    return rows.select("parsed_no", F.date_format(K.page_date(text), "yyyy-MM-dd").alias("day"))


def pod_dates(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "parsed_content").filter("pub_date is not null").select("parsed_no", "pub_date")
    text = F.concat(F.lit("Mon, "), F.date_format("pub_date", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return rows.select("parsed_no", R.iso(K.feed_date(text)).alias("at"))


def mon_enabled(s: SparkSession, d: str) -> DataFrame:
    return K.to_run(table(s, d, "monitors")).select("id", "status")


def mon_check(s: SparkSession, d: str) -> DataFrame:
    return K.checked_settings(table(s, d, "monitors"), table(s, d, "websets"))


def mon_next(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "monitors").select("id", R.iso(K.next_runs(F.col("cron_expression"), F.col("timezone"), F.col("last_run_at"))).alias("next_run"))


def mon_hybrid(s: SparkSession, d: str) -> DataFrame:
    """Rows added by the search phase, then updated and unchanged ones of the refresh phase."""
    items = RP._hashed(s, d).select("row_no", "batch_no", "url", "hash")
    added = monitor.search_run(items.filter("batch_no = 12"), items.filter("batch_no < 12"), "url", "hash", "row_no").groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    old = R.keep_first(items.filter("batch_no < 12 and url is not null"), ["url"], [F.desc("row_no")])
    crawled = R.keep_first(items.filter("batch_no = 12 and url is not null"), ["url"], [F.desc("row_no")])
    return added.unionByName(monitor.refresh_run(old, crawled, "url", "hash").groupBy(F.col("change").alias("action")).agg(F.count(F.lit(1)).alias("n")))


def que_batches(s: SparkSession, d: str) -> DataFrame:
    return K.in_batches(table(s, d, "webset_items").select("row_no"), ["row_no"], 32).groupBy("batch").agg(F.count(F.lit(1)).alias("n_items"), F.min("row_no").alias("first_no"))


def llm_schema(s: SparkSession, d: str) -> DataFrame:
    """Typed values of a JSON answer, with defaults where it lacks them."""
    got = F.from_json("item_metadata", "lang string, year int, tags array<string>", {"mode": "PERMISSIVE"})
    rows = table(s, d, "webset_items").select("row_no", got.alias("v"))
    return rows.select("row_no", F.coalesce("v.lang", F.lit("unknown")).alias("lang"), F.coalesce("v.year", F.lit(0)).alias("year"), F.array_join(F.coalesce("v.tags", F.array()), ",").alias("tags"))


def rtl_proxy(s: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[^:]+://([^/]+)", 1))
    stats = table(s, d, "fetch_results").groupBy(host.alias("url")).agg(F.count(F.lit(1)).alias("total_requests"), F.avg("load_time_ms").alias("average_ms"), (F.count_if(F.col("status") == 200) * 2 > F.count(F.lit(1))).alias("healthy"), F.max("status").alias("priority"))
    stats = stored(stats, "proxies")
    picks = [K.choose_proxy(stats, k).select(F.lit(k).alias("strategy"), "url") for k in ("least-used", "fastest", "priority", "round-robin")]
    return picks[0].unionByName(picks[1]).unionByName(picks[2]).unionByName(picks[3])


def rtl_adjust(s: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^[^:]+://([^/]+)", 1))
    stats = table(s, d, "fetch_results").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("status") == 200) / F.count(F.lit(1))).alias("share"), F.count_if(F.col("status") >= 500).alias("bad"))
    return stats.select("host", F.round(K.adjusted_rate(F.lit(1.0), F.col("n") * 10, F.col("share") + 0.2, F.col("bad"), 1.0, F.lit(True)), 6).alias("rate"))


def rrk_recent(s: SparkSession, d: str) -> DataFrame:
    rows = SP._results(s, d)
    scored = rerank.hybrid_score(rows, "query_key", "score", rerank.recency(F.col("collected_at"), SP.now(), 365.0), 0.5)
    return rerank.by_score(scored.withColumn("combined", F.round("combined", 6)), "query_key", "combined", "ord", 10).select("query_key", "key", "combined", "rank")


def enr_company_all(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.inline(F.array(enrich.company(F.col("text")))))


def enr_person_all(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.inline(F.array(enrich.person(F.col("text")))))


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "fetch_results").filter("html is not null").select("fetch_no", "url", html.parse_page("html", "url").alias("p"))


def met_meta(s: SparkSession, d: str) -> DataFrame:
    """Card, Dublin Core and linked-data values of each page, its canonical address and its feeds."""
    p = F.col("p")
    return _parsed(s, d).select("fetch_no", "p.canonical", "p.author", "p.published", F.to_json(p["twitter"]).alias("twitter"), F.to_json(p["dublin_core"]).alias("dublin_core"), F.size(p["json_ld"]).alias("n_objects"), F.array_join(p["feeds"], " ").alias("feeds"), F.array_join(p["keywords"], ",").alias("keywords"))


def prs_images(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("fetch_no", F.posexplode("p.images").alias("pos", "i")).select("fetch_no", "pos", "i.src", "i.alt", "i.caption")


def cit_quotes(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, d).select("fetch_no", F.explode("p.citations").alias("c")).filter("c.kind = 'quote'").select("fetch_no", "c.id", "c.author")


def cit_context(s: SparkSession, d: str) -> DataFrame:
    """100 characters around the first number in a text."""
    rows = table(s, d, "documents").withColumn("mark", F.regexp_extract("text", "[0-9]+", 0)).filter("mark <> ''")
    return rows.select("doc_id", K.context(F.col("text"), F.col("mark"), 100).alias("c")).select("doc_id", "c.before", "c.after")


def pod_episodes(s: SparkSession, d: str) -> DataFrame:
    """Feeds written from the parsed pages and read back."""
    plain = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<item><title>"), F.coalesce(plain("title"), F.lit("")), F.lit("</title><link>"), F.coalesce(plain("url"), F.lit("")), F.lit("</link><itunes:duration>1:02:03</itunes:duration></item>"))
    xml = F.concat(F.lit('<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Show</title>'), item, F.lit("</channel></rss>"))
    rows = table(s, d, "parsed_content").select("parsed_no", html.parse_feed(xml).alias("e"))
    return rows.select("parsed_no", F.inline("e")).select("parsed_no", "show", "title", "link", "seconds")


_FUNCTIONS = (
    enr_company_all, enr_person_all, met_meta, prs_images, cit_quotes, cit_context, pod_episodes, vec_embed, vec_cache, vec_zero, vec_log, prj_vectors, hyb_search, hyb_stats, qry_temporal, qry_fetch, flt_first, join_feedback, agg_workers, agg_tokens, agg_graph, srt_trend, srt_pages,
    snk_update, snk_runs, snk_collections, snk_cascade_all, exp_graph, grf_nodes, grf_mentions, chk_sliding, chk_sliding_sentences, dup_known, dup_greedy, prs_dates, pod_dates, mon_enabled, mon_check,
    mon_next, mon_hybrid, que_batches, llm_schema, rtl_proxy, rtl_adjust, rrk_recent,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_HASHED = RP._HASHED
_ISO = RP._ISO
_HOST = "lower(regexp_extract(url, '^[^:]+://([^/]+)', 1))"


def _sql_first(patterns, group: int = 1, flags: str = "i") -> str:
    return "coalesce(" + ", ".join("nullif(regexp_extract(text, '" + p.replace("'", "''") + f"', {group}, '{flags}'), '')" for p in patterns) + ")"


def _sql_money(patterns) -> str:
    return f"'$' || {_sql_first(patterns)} || upper(left({_sql_first(patterns, 2)}, 1))"


_TRIM = f"trim({{}}, {'||'.join(f'chr({ord(c)})' for c in WHITE)})".format
_COMPANY = {"ceo": _sql_first(enrich.CEO), "revenue": _sql_money(enrich.REVENUE), "employees": f"replace({_sql_first(enrich.EMPLOYEES)}, ',', '')", "founded": _sql_first(enrich.FOUNDED), "headquarters": _sql_first(enrich.HEADQUARTERS, flags="c"), "industry": PP._INDUSTRY, "market_cap": _sql_money(enrich.MARKET_CAP), "profit": _sql_money(enrich.PROFIT), "growth_rate": _sql_first(enrich.GROWTH)}
_PERSON = {"name": _sql_first(enrich.NAME, flags="c"), "company": _TRIM(_sql_first(enrich.WORKPLACE, flags="c")), "location": _sql_first(enrich.LOCATION, flags="c"), "education": _TRIM(_sql_first(enrich.EDUCATION, flags="c")), "email": _sql_first((enrich.EMAIL,), flags="c"), "phone": _sql_first(enrich.PHONE, flags="c"), "years": _sql_first(enrich.YEARS), "skills": PP._SKILLS}
ORACLE = {
    "enr_company_all": "select doc_id, " + ", ".join(f"{v} as {k}" for k, v in _COMPANY.items()) + " from documents",
    "enr_person_all": "select doc_id, " + ", ".join(f"{v} as {k}" for k, v in _PERSON.items()) + " from documents",
    "cit_context": f"""with m as (select doc_id, text, regexp_extract(text, '[0-9]+') as mark, strpos(text, regexp_extract(text, '[0-9]+')) as p0 from documents)
        select doc_id, nullif({_TRIM("substr(text, greatest(1, p0 - 100), p0 - greatest(1, p0 - 100))")}, '') as before, nullif({_TRIM("substr(text, p0 + length(mark), 100)")}, '') as after from m where mark <> ''""",
    "pod_episodes": f"select parsed_no, 'Show' as show, {_TRIM('title')} as title, coalesce(url, '') as link, 3723 as seconds from parsed_content where {_TRIM('title')} <> ''",
    "mon_hybrid": f"""with k as (select * from {_HASHED} where batch_no < 12), n as (select *, row_number() over (partition by hash order by row_no) as r from {_HASHED} where batch_no = 12),
        a as (select case when hash is not null and (hash in (select hash from k where hash is not null) or r > 1) then 'skip_hash' when url in (select url from k where url is not null) then 'skip_url' else 'add' end as action from n),
        o as (select url, arg_max(coalesce(hash, '-'), row_no) as hash from k where url is not null group by 1), c as (select url, arg_max(coalesce(hash, '-'), row_no) as hash from n where url is not null group by 1)
        select action, count(*) as n from a group by 1 union all select case when o.hash = c.hash then 'unchanged' else 'updated' end, count(*) from o join c using (url) group by 1""",
    "vec_cache": """select d.doc_id, coalesce(d.text is not null and sha256(d.text) in (select sha256(text) from documents where doc_id % 2 = 0 and text is not null and collected_at >= timestamptz '2024-05-31 00:00:00+00'), false) as hit from documents d""",
    "vec_zero": "select d.doc_id, case when e.embedding is null or list_dot_product(e.embedding, e.embedding) = 0 then 0.0 else 1.0 end as score from documents d left join embeddings e on e.vec_id = d.doc_id",
    "vec_log": "select event_type, count(*) as n_events from events group by 1",
    "prj_vectors": "select vec_id from embeddings",
    "hyb_search": f"""with {SP._BM}, qv as (select id as query_key, length(search_query) as vec_id from websets where search_query is not null),
        sem as (select * from (select query_key, key, score, row_number() over (partition by query_key order by raw desc, key) as rank from (select qv.query_key, t.vec_id as key, {SP._COS('q.embedding', 't.embedding')} as raw, round({SP._COS('q.embedding', 't.embedding')}, 6) as score
          from qv join embeddings q on q.vec_id = qv.vec_id join embeddings t on true)) where rank <= 20),
        a as (select 0.0 as alpha, query_key, key, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as score from top window w as (partition by query_key)),
        b as (select 1.0 as alpha, query_key, key, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as score from sem window w as (partition by query_key)),
        c as (select 0.5 as alpha, query_key, key, sum(0.5 / (60 + rank)) as score from (select query_key, key, rank from top union all select query_key, key, rank from sem) group by 2, 3),
        r as (select alpha, query_key, key, score, row_number() over (partition by alpha, query_key order by score desc, key) as rank from (select * from a union all select * from b union all select * from c))
        select cast(alpha as double) as alpha, query_key, key, round(score, 6) as score, rank from r where rank <= 10""",
    "hyb_stats": f"select cast(0.5 as double) as alpha, (select count(*) from documents) as n_docs, (select count(distinct term) from (select unnest({SP._TOK('text')}) as term from documents)) as n_terms, 60 as rrf_k",
    "qry_temporal": "select id, search_query || case when entity_type is not null then ' 2024' else '' end as query from websets where search_query is not null",
    "qry_fetch": f"""with p as (select url, arg_min(html, fetch_no) as html from fetch_results where status = 200 and html is not null group by 1),
        b as (select i.row_no, case when length(coalesce(p.html, i.content)) > 0 then sha256(coalesce(p.html, i.content)) end as hash from webset_items i left join p on p.url = i.url where i.batch_no = 12)
        select row_no from (select *, row_number() over (partition by hash order by row_no) as r from b) where hash is null or (r = 1 and hash not in (select hash from {_HASHED} where batch_no < 12 and hash is not null))""",
    "flt_first": "select row_no, id from webset_items where (webset_id, url) in (select (webset_id, url) from webset_items where webset_id is not null and url is not null order by row_no limit 1) order by row_no limit 1",
    "join_feedback": "select d.collection, count(*) as n_items from webset_items i join ruvector_docs d on d.id = i.ruvector_doc_id group by 1",
    "agg_workers": "select monitor_id, count(*) as n_tasks, count(*) filter (coalesce(status = 'completed', false)) as n_ok, count(*) filter (not coalesce(status = 'completed', false)) as n_failed from monitor_runs where monitor_id is not null group by 1",
    "agg_tokens": f"select doc_id, cast(floor(len({SP._TOK(chr(39) * 2)}) * 1.3) as bigint) as n_tokens_about from documents".replace(SP._TOK("''"), SP._TOK("coalesce(text, '')")),
    "agg_graph": "select count(distinct id) as n_nodes, count(parent_id) as n_edges from ruvector_docs",
    "srt_trend": f"select * from ({RP.ORACLE['agg_trending']}) order by coalesce(change_percent > 0, false) desc, n desc, collection limit 3",
    "srt_pages": "select row_no, id from webset_items where enrichments is not null order by row_no limit 20 offset 20",
    "snk_update": f"""with l as (select * from (select *, row_number() over (partition by id order by row_no desc) as r from webset_items where id is not null) where r = 1)
        select id, case when row_no % 3 = 0 and title is not null then 'New ' || title else title end as title, case when row_no % 6 = 0 then sha256(id || ' text') else content_hash end as content_hash,
        case when row_no % 6 = 0 then '{NOW}' else {_ISO('last_crawled_at')} end as crawled from l""",
    "snk_runs": f"select m.id, {_ISO('greatest(m.last_run_at, r.at)')} as last_run from monitors m left join (select monitor_id, max(started_at) as at from monitor_runs group by 1) r on r.monitor_id = m.id",
    "snk_collections": "select distinct collection from (select collection from ruvector_docs union select 'new ones') where collection is not null and collection <> 'papers'",
    "snk_cascade_all": """with g as (select id from websets where lower(entity_type) = 'company' and id is not null), m as (select id from monitors where webset_id in (select id from g) and id is not null)
        select 'webset_items' as table_name, count(*) as n_rows from webset_items where webset_id is null or webset_id not in (select id from g)
        union all select 'monitors', count(*) from monitors where webset_id is null or webset_id not in (select id from g) union all select 'monitor_runs', count(*) from monitor_runs where monitor_id is null or monitor_id not in (select id from m)""",
    "exp_graph": """select 'node' as kind, '{"data":{"id":"' || id || '"' || case when collection is not null then ',"collection":"' || collection || '"' else '' end || '}}' as element from ruvector_docs where id is not null
        union all select 'edge', '{"data":{"source":"' || id || '","target":"' || parent_id || '","label":"CHILD_OF"}}' from ruvector_docs where id is not null and parent_id is not null""",
    "grf_nodes": "select distinct id from ruvector_docs where id is not null",
    "chk_sliding": """with n as (select doc_id, text, length(text) as n, unnest(range(0, case when length(text) <= 512 then 1 else cast(1 + ceil((length(text) - 512) / 462.0) as int) end)) as no from documents where text is not null)
        select doc_id, cast(row_number() over (partition by doc_id order by no) - 1 as int) as no, cast(no * 462 as int) as start_pos, substr(text, cast(no * 462 + 1 as int), 512) as piece from n where n <= 512 or length(substr(text, cast(no * 462 + 1 as int), 512)) >= 100""",
    "dup_greedy": "select min(row_no) as row_no from webset_items where length(content) > 0 group by sha256(content) union all select row_no from webset_items where coalesce(length(content), 0) = 0",
    "prs_dates": "select parsed_no, strftime(pub_date at time zone 'UTC', '%Y-%m-%d') as day from parsed_content where pub_date is not null",
    "pod_dates": f"select parsed_no, {_ISO('pub_date')} as at from parsed_content where pub_date is not null",
    "mon_enabled": "select id, status from monitors where coalesce(status <> 'disabled', true)",
    "mon_check": """select id, error is null as valid, error from (select id, case when webset_id is null or webset_id not in (select id from websets where id is not null) then 'Webset ' || coalesce(webset_id, 'None') || ' not found'
        when coalesce(behavior_type, '') not in ('search', 'refresh', 'hybrid') then 'Unknown behavior ' || coalesce(behavior_type, 'None') end as error from monitors)""",
    "que_batches": "select cast(floor((r - 1) / 32) as bigint) as batch, count(*) as n_items, min(row_no) as first_no from (select row_no, row_number() over (order by row_no) as r from webset_items) group by 1",
    "llm_schema": """select row_no, coalesce(json_extract_string(item_metadata, '$.lang'), 'unknown') as lang, coalesce(cast(json_extract(item_metadata, '$.year') as int), 0) as year,
        coalesce(array_to_string(from_json(json_extract(item_metadata, '$.tags'), '["VARCHAR"]'), ','), '') as tags from webset_items""",
    "rtl_adjust": f"select host, round(case when bad >= 3 then 0.5 when n * 10 >= 100 and share + 0.2 > 0.95 then 1.1 else 1.0 end, 6) as rate from (select {_HOST} as host, count(*) as n, count(*) filter (status = 200) / count(*) as share, count(*) filter (status >= 500) as bad from fetch_results group by 1)",
    "rtl_proxy": f"""with s as (select {_HOST} as url, count(*) as total_requests, avg(load_time_ms) as average_ms, count(*) filter (status = 200) * 2 > count(*) as healthy, max(status) as priority from fetch_results group by 1),
        h as (select * from s where healthy or not (select bool_or(healthy) from s))
        select * from (select 'least-used' as strategy, url from h order by total_requests, url limit 1) union all select * from (select 'fastest', url from h order by average_ms nulls last, url limit 1)
        union all select * from (select 'priority', url from h order by priority desc, url limit 1) union all select * from (select 'round-robin', list_sort(list(url))[1 % len(list(url)) + 1] from h)""",
    "rrk_recent": SP.ORACLE["rrk_hybrid"].replace("0.7 * (score", "0.5 * (score").replace("+ 0.3 * rec", "+ 0.5 * rec"),
}
