"""Vector, lexical, fusion, rerank and graph queries. Query sets: websets' search queries, and vectors whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.operators import graph, lexical, rerank, vector
from weirmill.tables import table

NOW = "2024-12-31T00:00:00Z"
#: Cosine from which two test vectors are linked.
LINK = 0.4


def now():
    return F.lit(NOW).cast("timestamp")


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int, int]:
    rows = table(s, d, "embeddings")
    queries = rows.filter("vec_id % 20 = 0")
    return rows, queries, rows.count(), queries.count()


def vec_topk(s: SparkSession, d: str) -> DataFrame:
    rows, queries, n, m = _vectors(s, d)
    return vector.top_similar(rows, queries, "vec_id", "embedding", 10, n, m).withColumn("score", F.round("score", 6))


def vec_links(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embeddings")
    return vector.similar_pairs(rows, "vec_id", "embedding", LINK, rows.count()).withColumn("score", F.round("score", 6))


def vec_norms(s: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.round(vector.cosine(e, F.reverse(e)), 6).alias("score"), F.size(e).alias("dim"))


def _weights(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs")
    m = F.pmod(F.coalesce("lineage_depth", F.lit(0)) * 3 + F.length(F.coalesce("text", F.lit(""))), F.lit(10)) / 10.0
    return docs.select("id", "created_at", m.alias("m"))


def vec_weighted(s: SparkSession, d: str) -> DataFrame:
    return _weights(s, d).select("id", F.round(vector.weighted(F.lit(0.8), F.col("m") * 1.5), 6).alias("score"))


def vec_decay(s: SparkSession, d: str) -> DataFrame:
    return _weights(s, d).select("id", F.round(vector.decayed(F.col("m"), F.col("created_at"), now(), 720.0), 6).alias("weight"))


def vec_stats(s: SparkSession, d: str) -> DataFrame:
    return vector.weight_stats(_weights(s, d), "m")


def vec_feedback(s: SparkSession, d: str) -> DataFrame:
    ev = table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "grounded").when(F.col("event_type") == "error", "ignored").otherwise("retrieved")
    log = ev.select("user_id", "event_id", kind.alias("kind"), F.when(F.col("event_type") == "purchase", F.lit(0.75)).alias("quality"))
    return vector.feedback_fold(log, "user_id", "event_id", 0.3).withColumn("weight", F.round("weight", 6))


def lex_term_stats(s: SparkSession, d: str) -> DataFrame:
    tf = lexical.term_frequencies(table(s, d, "documents"), "doc_id", "text")
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


def _queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "websets").filter("search_query is not null").select(F.col("id").alias("query_id"), "search_query")


def _bm25(s: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(table(s, d, "documents"), "doc_id", "text", _queries(s, d), "query_id", "search_query").withColumn("score", F.round("score", 6))


def lex_bm25(s: SparkSession, d: str) -> DataFrame:
    return lexical.ranked(_bm25(s, d), "query_key", "key", "score", 20)


def hyb_minmax(s: SparkSession, d: str) -> DataFrame:
    return lexical.min_max(lex_bm25(s, d), "query_key", "score").select("query_key", "key", F.round("scaled", 6).alias("scaled"))


def hyb_rrf(s: SparkSession, d: str) -> DataFrame:
    """The second ranked list: the documents a query hits, longest first."""
    by_score, by_length = lexical.bm25_lists(table(s, d, "documents"), "doc_id", "text", "n_chars", _queries(s, d), "query_id", "search_query", 20)
    fused = lexical.fuse(by_score, by_length, "query_key", "key", 0.5).withColumn("score", F.round("score", 9))
    return lexical.ranked(fused, "query_key", "key", "score", 10)


def hyb_multiquery(s: SparkSession, d: str) -> DataFrame:
    n = F.lit(_queries(s, d).count())
    return lexical.fuse_queries(lex_bm25(s, d), "key", "score", n).withColumn("score", F.round("score", 6))


def qry_synonyms(s: SparkSession, d: str) -> DataFrame:
    forms = lexical.expand_synonyms(F.col("search_query"), {"robots": ["machines", "automata"], "papers": ["articles"]})
    return _queries(s, d).select("query_id", F.posexplode(forms).alias("pos", "form"))


def qry_suggestions(s: SparkSession, d: str) -> DataFrame:
    return _queries(s, d).select("query_id", F.posexplode(lexical.suggestions(F.col("search_query"), 3)).alias("pos", "form"))


def qry_entity(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "websets")
    words = F.from_json(F.get_json_object("search_criteria", "$.keywords"), "array<string>")
    q = lexical.entity_query(F.lower("entity_type"), F.lit("Berlin"), F.lit(None).cast("string"), F.coalesce(words, F.array().cast("array<string>")))
    return w.select("id", q.alias("query"))


def rrk_recency(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.round(rerank.recency(F.col("collected_at"), now()), 9).alias("recency"))


def _results(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.col("doc_id").alias("key"), "text", "collected_at")
    return lex_bm25(s, d).join(docs, "key").withColumn("ord", F.col("rank"))


def rrk_hybrid(s: SparkSession, d: str) -> DataFrame:
    scored = rerank.hybrid_score(_results(s, d), "query_key", "score", rerank.recency(F.col("collected_at"), now(), 365.0))
    return rerank.by_score(scored.withColumn("combined", F.round("combined", 6)), "query_key", "combined", "ord", 10).select("query_key", "key", "combined", "rank")


def rrk_custom(s: SparkSession, d: str) -> DataFrame:
    return rerank.custom(_results(s, d), "query_key", lambda df: F.round(F.col("score") / F.log(F.lit(2.0) + F.length("text")), 6), "ord", 10).select("query_key", "key", "rank")


def rrk_diversity(s: SparkSession, d: str) -> DataFrame:
    return rerank.by_diversity(_results(s, d), "query_key", "key", "text")


def rrk_mmr(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    top = vec_topk(s, d).join(e, "id").withColumn("ord", F.col("rank"))
    return rerank.by_marginal_relevance(top, "query_id", "id", "score", "embedding")


def rrk_dedup(s: SparkSession, d: str) -> DataFrame:
    return rerank.without_repeats(_results(s, d), "query_key", "key", "text")


def _edges(s: SparkSession, d: str) -> DataFrame:
    return vec_links(s, d).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def grf_build(s: SparkSession, d: str) -> DataFrame:
    return vec_links(s, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("SIMILAR_TO").alias("edge_type"), F.col("score").alias("similarity"))


def grf_edges(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs")
    edges = docs.filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst"))
    return graph.edges_with_nodes(edges, docs, "id").select("src", "dst")


def grf_stubs(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs")
    return graph.missing_nodes(docs.filter("parent_id is not null").select(F.col("id").alias("src"), F.col("parent_id").alias("dst")), docs, "id")


def grf_neighbours(s: SparkSession, d: str) -> DataFrame:
    starts = table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("start"))
    return graph.neighbours(_edges(s, d), starts, 2)


def grf_components(s: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(s, d))


def grf_paths(s: SparkSession, d: str) -> DataFrame:
    edges = _edges(s, d)
    ends = table(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("source"))
    pairs = ends.select("source", (F.col("source") + 20).alias("target")).unionByName(ends.select("source", F.col("source").alias("target")))
    paths = graph.shortest_paths(edges, pairs, 5)
    return paths.select("source", "target", F.size("path").alias("n_nodes"))


def grf_lineage(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs")
    return graph.lineage(docs, "id", "parent_id", docs.select(F.col("id").alias("start")))


def grf_depths(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "ruvector_docs").withColumn("at", F.unix_micros("loaded_at"))
    return graph.lineage_depths(docs, "id", "parent_id", "at")


def grf_entities(s: SparkSession, d: str) -> DataFrame:
    found = table(s, d, "ruvector_docs").select("id", F.explode(graph.entities(F.col("text"))).alias("entity"))
    return found.groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs"))


_FUNCTIONS = (
    vec_topk, vec_links, vec_norms, vec_weighted, vec_decay, vec_stats, vec_feedback, lex_term_stats, lex_bm25, hyb_minmax, hyb_rrf, hyb_multiquery, qry_synonyms, qry_suggestions, qry_entity,
    rrk_recency, rrk_hybrid, rrk_custom, rrk_diversity, rrk_mmr, rrk_dedup, grf_build, grf_edges, grf_stubs, grf_neighbours, grf_components, grf_paths, grf_lineage, grf_depths, grf_entities,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_COS = "coalesce(list_dot_product(cast({0} as double[]), cast({1} as double[])) / nullif(sqrt(list_dot_product(cast({0} as double[]), cast({0} as double[]))) * sqrt(list_dot_product(cast({1} as double[]), cast({1} as double[]))), 0), 0)".format
_LINKS = f"(select a.vec_id as a, b.vec_id as b, {_COS('a.embedding', 'b.embedding')} as score from embeddings a join embeddings b on a.vec_id < b.vec_id)"
_M = "((coalesce(lineage_depth, 0) * 3 + length(coalesce(text, ''))) % 10) / 10.0::double"
_TOK = "list_filter(str_split_regex(lower({0}), '[\\x09-\\x0d\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '')".format
_BM = f"""tok as (select doc_id as key, {_TOK('text')} as w from documents where text is not null), tf as (select key, term, count(*) as tf, any_value(dl) as dl from (select key, len(w) as dl, unnest(w) as term from tok) group by 1, 2),
  df as (select term, count(*) as df from tf group by 1), st as (select (select count(*) from documents) as n, (select avg(len(coalesce(w, []))) from (select {_TOK("coalesce(text, '')")} as w from documents)) as avgdl),
  q as (select id as query_key, unnest({_TOK('search_query')}) as term from websets where search_query is not null), qf as (select query_key, term, count(*) as qf from q group by 1, 2),
  bm as (select query_key, key, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from qf join tf using (term) join df using (term), st group by 1, 2),
  top as (select * from (select *, row_number() over (partition by query_key order by score desc, key) as rank from bm where score > 0) where rank <= 20)"""
_AGE = "floor((epoch(timestamptz '2024-12-31 00:00:00+00') - floor(epoch(collected_at))) / 86400)"
ORACLE = {
    "vec_topk": f"""select query_id, id, round(score, 6) as score, rank from (select q.vec_id as query_id, t.vec_id as id, {_COS('q.embedding', 't.embedding')} as score,
        row_number() over (partition by q.vec_id order by {_COS('q.embedding', 't.embedding')} desc, t.vec_id) as rank from embeddings q join embeddings t on t.vec_id <> q.vec_id where q.vec_id % 20 = 0) where rank <= 10""",
    "vec_links": f"select a, b, round(score, 6) as score from {_LINKS} where score >= {LINK}",
    "vec_norms": f"select vec_id, round({_COS('embedding', 'list_reverse(embedding)')}, 6) as score, cast(len(embedding) as int) as dim from embeddings",
    "vec_weighted": f"select id, round(0.8 * (1 - least(greatest({_M} * 1.5, 0), 1)), 6) as score from ruvector_docs",
    "vec_decay": f"select id, round(case when created_at is null then {_M} else {_M} * pow(0.5, (epoch(timestamptz '2024-12-31 00:00:00+00') - floor(epoch(created_at))) / 3600.0 / 720.0) end, 6) as weight from ruvector_docs",
    "vec_stats": f"select count(*) as total, round(avg(m), 3) as mean, count(*) filter (m < 0.05) as low, count(*) filter (m >= 0.05 and m < 0.5) as medium, count(*) filter (m >= 0.5) as high from (select {_M} as m from ruvector_docs)",
    "vec_feedback": """with e as (select user_id, list(event_type order by event_id) as ev from events group by 1)
        select user_id, cast(len(ev) as int) as n_events, round(list_reduce(list_prepend(0.3::double, list_transform(ev, lambda x: case x when 'purchase' then -1.0 when 'error' then -2.0 else -3.0 end)),
          lambda m, x: case when x = -1.0 then greatest(m * 0.75, 0) when x = -2.0 then least(m + 0.05, 1.0) else m end), 6) as weight from e""",
    "lex_term_stats": f"select term, count(*) as df, cast(sum(tf) as bigint) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TOK('text')}) as term from documents) group by 1, 2) group by 1",
    "lex_bm25": f"with {_BM} select * from top",
    "hyb_minmax": f"with {_BM} select query_key, key, round(case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 6) as scaled from top window w as (partition by query_key)",
    "hyb_rrf": f"""with {_BM}, len as (select * from (select bm.query_key, bm.key, row_number() over (partition by query_key order by n_chars desc, key) as rank from bm join documents on doc_id = bm.key where n_chars > 0) where rank <= 20),
        f as (select query_key, key, round(sum(0.5 / (60 + rank)), 9) as score from (select query_key, key, rank from top union all select query_key, key, rank from len) group by 1, 2)
        select * from (select *, row_number() over (partition by query_key order by score desc, key) as rank from f) where rank <= 10""",
    "hyb_multiquery": f"with {_BM} select key, round(cast(sum(cast(score as decimal(26,12))) as double) / (select count(*) from websets where search_query is not null), 6) as score from top group by 1",
    "rrk_recency": f"select doc_id, round(coalesce(exp(-{_AGE} / 30.0), 0), 9) as recency from documents",
    "rrk_hybrid": f"""with {_BM}, r as (select query_key, key, rank as o, score, coalesce(exp(-{_AGE} / 365.0), 0) as rec from top join documents on doc_id = key),
        c as (select query_key, key, o, round(0.7 * (score - min(score) over w) / case when max(score) over w = min(score) over w then 1.0 else max(score) over w - min(score) over w end + 0.3 * rec, 6) as combined from r window w as (partition by query_key))
        select query_key, key, combined, rank from (select *, row_number() over (partition by query_key order by combined desc, o) as rank from c) where rank <= 10""",
    "grf_build": f"select a as src, b as dst, 'SIMILAR_TO' as edge_type, round(score, 6) as similarity from {_LINKS} where score >= {LINK}",
    "grf_edges": "select c.id as src, c.parent_id as dst from ruvector_docs c where c.parent_id in (select id from ruvector_docs where id is not null) and c.id is not null",
    "grf_stubs": "select distinct parent_id as id from ruvector_docs where parent_id is not null and parent_id not in (select id from ruvector_docs where id is not null)",
    "grf_components": f"""with recursive e as (select a as s, b as t from {_LINKS} where score >= {LINK} union all select b, a from {_LINKS} where score >= {LINK}),
        r(node, hit) as (select distinct s, s from e union select r.node, e.t from r join e on e.s = r.hit) select node, min(hit) as component from r group by 1""",
    "grf_neighbours": f"""with e as (select a as s, b as t from {_LINKS} where score >= {LINK} union all select b, a from {_LINKS} where score >= {LINK}),
        h as (select s as start, t as node, 1 as depth from e where s % 20 = 0 union all select x.s, y.t, 2 from e x join e y on y.s = x.t where x.s % 20 = 0 and y.t <> x.s) select start, node, min(depth) as depth from h group by 1, 2""",
    "grf_lineage": """with recursive r(start, depth, node, found, up) as (select id, 0, id, true, parent_id from ruvector_docs where id is not null
        union all select r.start, r.depth + 1, r.up, d.id is not null, d.parent_id from r left join ruvector_docs d on d.id = r.up where r.up is not null and r.depth < 64) select start, depth, node, found from r""",
    "qry_synonyms": """select query_id, cast(i - 1 as int) as pos, forms[i] as form from (select query_id, forms, unnest(range(1, len(forms) + 1)) as i from (select id as query_id, list_filter([search_query,
        case when contains(lower(search_query), 'robots') then replace(lower(search_query), 'robots', 'machines') end, case when contains(lower(search_query), 'robots') then replace(lower(search_query), 'robots', 'automata') end,
        case when contains(lower(search_query), 'papers') then replace(lower(search_query), 'papers', 'articles') end], lambda x: x is not null) as forms from websets where search_query is not null))""",
    "rrk_custom": f"with {_BM} select query_key, key, rank from (select query_key, key, row_number() over (partition by query_key order by round(score / ln(2.0 + length(text)), 6) desc, top.rank) as rank from top join documents on doc_id = key) where rank <= 10",
    "qry_suggestions": "select id as query_id, cast(i as int) as pos, search_query || (['company', 'person', 'technology'])[i + 1] as form from (select id, search_query, unnest([0, 1, 2]) as i from websets where length(search_query) >= 2)".replace("['company', 'person', 'technology']", "[' company', ' person', ' technology']"),
    "qry_entity": """select id, array_to_string(list_filter([nullif(lower(entity_type), ''), 'in Berlin', nullif(array_to_string(from_json(json_extract(search_criteria, '$.keywords'), '["VARCHAR"]'), ' '), '')], lambda x: x is not null), ' ') as query from websets""",
}
