"""Core operators on small fixtures: nulls, empty tables, ties, repeated rows, extra columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weirmill.functions.urls import canonical_url
from weirmill.operators import graph, lexical, monitor, rerank, textops as X, vector
from weirmill.operators.components import linked_classes
from weirmill.operators.references import orphan_references
from weirmill.operators.skew import lookup_join
from weirmill.sources.html import duration_seconds, read_feed, read_page


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_canonical_url(spark):
    same = ["http://www.A.example/x%2Dy/?utm_source=q&b=2&a=1#top", "https://a.example:443/x-y/index.html?a=1&b=2", "  https://A.example/x-y?b=2&a=1&gclid=7 ", "a.example/x-y?a=1&b=2"]
    rows = spark.createDataFrame([(u,) for u in [*same[:3], "https://a.example/x-y?a=1&b=3", "https://a.example/X-y?a=1&b=2", "https://a.example/x%2Fy", "", None]], "u string")
    got = [r.c for r in rows.select(canonical_url(F.col("u")).alias("c")).collect()]
    assert got[0] == got[1] == got[2] == "a.example/x-y?a=1&b=2"
    assert len(set(got[:6])) == 4 and got[5] == "a.example/x%2Fy" and got[6:] == [None, None]


def test_lookup_join_keeps_every_row(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(150)] + [(None, 1)], "k string, n int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, v int")
    out = lookup_join(left, right, ["k"])
    assert out.count() == 451 and out.filter("v = 1").count() == 300 and out.filter("v = 2").count() == 1
    assert lookup_join(left.limit(0), right, ["k"]).count() == 0 and lookup_join(left, right.limit(0), ["k"]).count() == 451


def _t(day):
    return dt.datetime(2024, 1, day)


def test_orphans_single_key(spark):
    kids = spark.createDataFrame([(1, " A ", _t(5)), (2, "b", _t(5)), (3, "c", _t(5)), (4, "d", _t(5)), (5, None, _t(5)), (6, " ", _t(5)), (7, "b", None), (4, "d", _t(5))], "rec long, k string, at timestamp")
    parents = spark.createDataFrame([("a", _t(1), 0), ("A", _t(9), 0), ("b", _t(6), 1)], "k string, at timestamp, rec int")
    gone = spark.createDataFrame([("C",), ("a",)], "k string")
    found = orphan_references(kids, parents, ["k"], ["k"], rec="rec", child_time="at", parent_time="at", deleted=gone, deleted_keys=["k"])
    assert values(found, "rec", "kind") == [(2, "late"), (3, "deleted"), (4, "missing"), (4, "missing")]
    assert orphan_references(kids.limit(0), parents, ["k"], ["k"], rec="rec").count() == 0
    assert orphan_references(kids, parents.limit(0), ["k"], ["k"], rec="rec").count() == 6


@pytest.mark.parametrize("match, expected", [("simple", [(2, "missing")]), ("full", [(2, "missing"), (3, "partial"), (4, "partial")]), ("partial", [(2, "missing"), (4, "missing")])])
def test_orphans_composite_keys(spark, match, expected):
    kids = spark.createDataFrame([(1, "x", "1"), (2, "x", "9"), (3, "x", None), (4, None, "7"), (5, None, None)], "rec long, a string, b string")
    parents = spark.createDataFrame([("x", "1"), ("y", "2"), ("y", "2")], "a string, b string")
    assert values(orphan_references(kids, parents, ["a", "b"], ["a", "b"], rec="rec", match=match), "rec", "kind") == expected


def test_components_and_chains(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7)]
    edges = spark.createDataFrame(pairs + [(None, 3)], "src long, dst long")
    got = dict(values(graph.components(edges), "node", "component"))
    assert {got[i] for i in range(1, 41)} == {1} and got[100] == got[101] == 100
    assert linked_classes(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_paths_neighbours_lineage(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 5), (9, 9)], "source long, target long")
    assert values(graph.shortest_paths(edges, pairs, 5), "source", "path") == [(1, [1, 2, 3, 4, 5]), (9, [9])]
    assert values(graph.shortest_paths(edges, pairs, 4), "source", "path") == [(9, [9])]
    starts = spark.createDataFrame([(1,)], "start long")
    assert values(graph.neighbours(edges, starts, 2), "node", "depth") == [(2, 1), (3, 2)] and graph.neighbours(edges, starts, 0).count() == 0
    nodes = spark.createDataFrame([("a", "b"), ("b", "gone"), ("c", "d"), ("d", "c")], "id string, up string")
    chain = graph.lineage(nodes, "id", "up", spark.createDataFrame([("a",), ("zz",)], "start string"))
    assert values(chain, "depth", "node", "found") == [(0, "a", True), (1, "b", True), (2, "gone", False)]
    assert graph.lineage(nodes, "id", "up", spark.createDataFrame([("c",)], "start string"), 5).count() == 5


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "id long, v array<double>")
    one = F.array(F.lit(1.0), F.lit(0.0))
    assert [r.s for r in df.orderBy("id").select(vector.cosine(F.col("v"), one).alias("s")).collect()] == [1.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(60)], "id long, v array<float>")
    top = vector.top_similar(rows, rows.filter("id = 0"), "id", "v", 3, 60, 1)
    assert values(top, "rank", "id") == [(1, 5), (2, 10), (3, 15)]
    assert vector.similar_pairs(rows, "id", "v", 0.9999999, 60, block_rows=7).count() == 5 * (12 * 11 // 2)


def test_feedback_weights(spark):
    log = spark.createDataFrame([(1, 1, "grounded", None), (1, 2, "ignored", None), (2, 1, "retrieved", 0.3)], "k int, at int, kind string, quality double")
    assert values(vector.feedback_fold(log, "k", "at", 0.5).select("k", F.round("weight", 6).alias("w")), "k", "w") == [(1, 0.5), (2, 0.5)]


def test_bm25_counts_repeated_query_terms(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, ""), (4, None)], "id long, text string")
    queries = spark.createDataFrame([("x", "A"), ("y", "a a")], "q string, text string")
    got = dict(values(lexical.bm25(docs, "id", "text", queries, "q", "text"), "query_key", "score"))
    assert got["y"] == pytest.approx(2 * got["x"]) and got["x"] > 0


def test_greedy_orders():
    assert rerank.diverse_order(["a b", "a b", "c d"]) == [0, 2, 1] and rerank.diverse_order([]) == []
    import numpy as np

    assert rerank.marginal_order(np.array([1.0, 0.9, 0.1]), np.array([[1.0, 0], [1, 0], [0, 1]])) == [0, 2, 1]


def test_text_functions(spark):
    df = spark.createDataFrame([("a\r\nb​c",), ("hellooooooo",), ("A\na\nb\nB\na",)], "t string")
    got = df.select(X.clean(F.col("t")).alias("c"), X.short_runs(F.col("t")).alias("s"), X.no_repeated_lines(F.col("t")).alias("l")).collect()
    assert got[0].c == "a bc" and got[1].s == "helloooo" and got[2].l == "A\nb\na"
    assert X.sentences("Dr. Smith left. He ran! Why?") == ["Dr. Smith left.", "He ran!", "Why?"]
    assert X.simhash([]) == "0" * 16 and X.minhash([]) == "0" * 32 and int(X.simhash(["a b c"])[0], 16) >= 8
    urls = spark.createDataFrame([("http://a.b/?utm_source=x&y=1",), ("HTTP://a.b",), ("http://a.b/x?utm_a=1#top",)], "u string")
    assert [r.u for r in urls.select(X.simple_url(F.col("u")).alias("u")).collect()] == ["a.b/&y=1", "http://a.b", "a.b/x"]
    long = spark.createDataFrame([(" ".join(f"w{i}" for i in range(300)),), ("x" * 1100,)], "t string")
    assert [len(r.w) for r in long.select(X.word_windows(F.col("t")).alias("w")).collect()] == [2, 1]
    assert long.select(F.size(X.fixed_chunks(F.col("t"))).alias("n")).collect()[1].n == 2


PAGE = """<html lang="en"><head><title>T</title><meta property="og:title" content="OG"><meta name="DC.Creator" content="Ann"><link rel="canonical" href="/c"><link rel="alternate" type="application/rss+xml" href="/f">
<script type="application/ld+json">{"datePublished": "2024-01-02"}</script><script type="application/ld+json">{bad</script></head><body><nav><a href="/x">X</a></nav><article><h1>Head</h1><p>Text [1] (Smith et al. 2020)</p>
<table><thead><tr><th>A</th></tr></thead><tr><td>1</td></tr></table><figure><img src="i.png" alt="alt" width="3"><figcaption>Cap</figcaption></figure><blockquote cite="u">Quote<footer>Bob</footer></blockquote>
<pre><code class="language-py">print('hello')</code></pre></article></body></html>"""


def test_page_parsing():
    p = read_page(PAGE, "https://e.example/p")
    assert (p["title"], p["language"], p["author"], p["published"], p["canonical"], p["feeds"]) == ("OG", "en", "Ann", "2024-01-02", "https://e.example/c", ["https://e.example/f"])
    assert p["tables"] == [{"caption": None, "headers": ["A"], "rows": [["1"]]}] and p["images"][0]["caption"] == "Cap" and p["images"][0]["width"] == 3
    assert [c["kind"] for c in p["citations"]] == ["quote", "figure", "code", "reference", "reference"] and p["citations"][2]["language"] == "py"
    assert read_page(None, None) is None and read_page("<p>un<b>closed", "")["main_text"] == "unclosed"


def test_feeds():
    assert [duration_seconds(x) for x in ("1:02:03", "62:03", "3723", "x", None)] == [3723, 3723, 3723, None, None]
    feed = "<rss><channel><title>S</title><item><title>E</title><enclosure url='a.mp3' type='audio/mpeg'/></item><item><title/></item></channel></rss>"
    assert [(e["show"], e["title"], e["audio"]) for e in read_feed(feed)] == [("S", "E", "a.mp3")] and read_feed("<broken") == []


def test_depths_of_long_chains(spark):
    docs = spark.createDataFrame([(f"d{i}", f"d{i - 1}" if i else None, i) for i in range(69)], "id string, parent_id string, at long")
    assert {r.id: r.depth for r in graph.lineage_depths(docs, "id", "parent_id", "at").collect()} == {f"d{i}": i for i in range(69)}


def test_rate_limits(spark):
    assert monitor.token_bucket([0, 0, 0, 10], 0.1, 2) == [True, True, False, True]
    df = spark.createDataFrame([(0,), (2,), (20,)], "n long")
    assert [r.w for r in df.select(monitor.backoff(F.col("n")).alias("w")).collect()] == [0.0, 4.0, 300.0]


def test_stream_limits_equal_batch(spark, tmp_path):
    from weirmill.streaming import windows

    ev = windows.event_stream(spark, "/root/testdata/sf0.001")
    windows.run_once(windows.limited(ev, "user_id", "event_id", 0.0001, 3.0), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = monitor.rate_limited(spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_id", "ts", 0.0001, 3.0)
    assert values(spark.read.parquet(str(tmp_path / "o")), "event_id", "passed") == values(batch, "event_id", "passed")


def test_bm25_lists_equal_all_scores_and_store_no_pairs(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i * k % 7}" for k in range(i % 9 + 1)), None if i % 11 == 0 else i % 5 * 10) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string, size long").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", f"W{i % 7} w{i * 2 % 5} w0 w{i % 3}" if i else "none such") for i in range(40)], "q string, query string")
    scores = lexical.bm25(docs, "id", "text", queries, "q", "query").withColumn("score", F.round("score", 6)).cache()
    sizes = scores.join(docs.select(F.col("id").alias("key"), F.col("size").alias("other")), "key").select("query_key", "key", F.col("other").alias("score"))
    plain = lambda df: sorted((r.query_key, r.rank, r.key, round(r.score, 6)) for r in df.collect())
    wanted = [plain(lexical.ranked(x, "query_key", "key", "score", 3)) for x in (scores, sizes)]
    held, stored = [], lexical.stored
    monkeypatch.setattr(lexical, "stored", lambda df, name: held.append(stored(df, name)) or held[-1])
    for most, chunk in ((100_000, 20_000), (30, 20_000), (100_000, 9)):  # as it is, in blocks of queries, with few documents at once
        monkeypatch.setattr(lexical, "MAX_TERMS", most)
        monkeypatch.setattr(lexical, "DOCS", chunk)
        assert [plain(x) for x in lexical.bm25_lists(docs, "id", "text", "size", queries, "q", "query", 3)] == wanted
    assert wanted[0] and wanted[1] and max(t.count() for t in held) < scores.count()
    assert [x.count() for x in lexical.bm25_lists(docs.limit(0), "id", "text", "size", queries, "q", "query", 3)] == [0, 0]
