"""Single-record mutations, numbering, dates, schedules, choices, embeddings: nulls, ties, empty tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirmill.operators import components, graph, hybrid, records


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("cron, zone, after, expected", [
    ("15 7 * * 1", "Europe/Berlin", (2024, 8, 9, 20, 54), (2024, 8, 12, 5, 15)), ("0 */6 * * *", None, (2024, 11, 7, 22, 58), (2024, 11, 8, 0, 0)), ("0 0 29 2 *", "UTC", (2023, 1, 1), (2024, 2, 29)),
    ("*/20 9-10 * * *", "UTC", (2024, 1, 1, 9, 40), (2024, 1, 1, 10, 0)), ("0 0 13 * 5", "UTC", (2024, 9, 1), (2024, 9, 6)), ("0 0 31 2 *", "UTC", (2024, 1, 1), None), ("bad", "UTC", (2024, 1, 1), None),
    ("0 0 * * *", "No/Where", (2024, 1, 1), None), (None, None, (2024, 1, 1), None), ("61 * * * *", "UTC", (2024, 1, 1), None),
])
def test_next_run(cron, zone, after, expected):
    assert records.next_run(cron, zone, dt.datetime(*after)) == (dt.datetime(*expected) if expected else None)


def test_sliding_chunks():
    assert records.sliding_chunks(None) == [] and records.sliding_chunks("") == [(0, 0, "")] and records.sliding_chunks("x" * 512) == [(0, 0, "x" * 512)]
    text = "word " * 60 + "End. " + "more " * 200
    first = records.sliding_chunks(text)[0]
    assert first == (0, 0, text[:304].strip()) and [p[1] for p in records.sliding_chunks(text, at_sentences=False)] == [0, 462, 924]
    assert all(100 <= len(p) <= 512 for _, _, p in records.sliding_chunks(text * 9))


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)] + [(None, 100)], "a int, number int").repartition(5)
    rows = records.numbered(df, ["a"]).orderBy("no").collect()
    assert [r.no for r in rows] == list(range(101)) and [r.a for r in rows] == [None, *range(100)]
    assert records.in_batches(df, ["a"], 32).groupBy("batch").count().count() == 4 and records.numbered(df.limit(0), ["a"]).count() == 0


def test_updates(spark):
    items = spark.createDataFrame([("a", "t", "c", "h", None, 1), ("b", None, None, None, None, 2), (None, "n", None, None, None, 3)], "id string, title string, content string, content_hash string, last_crawled_at timestamp, rank int")
    patches = spark.createDataFrame([("a", None, "new"), ("b", "u", None), ("gone", "x", "y")], "id string, title string, content string")
    out = {r.id: r for r in records.update_items(items, patches, "id", F.lit("2024-01-01").cast("timestamp")).collect()}
    assert out["a"].title == "t" and out["a"].content == "new" and len(out["a"].content_hash) == 64 and out["a"].last_crawled_at and out["b"].title == "u" and out["b"].last_crawled_at is None and out[None].title == "n"
    assert values(records.greedy_unique(spark.createDataFrame([(1, "x"), (2, None), (3, ""), (4, "x"), (5, "")], "n int, t string"), "t", "n").select("n")) == [(1,), (2,), (3,), (5,)]
    with pytest.raises(ValueError):
        records.content_hash(F.col("x"), "none")


def test_proxies(spark):
    stats = spark.createDataFrame([("a", False, 1, 5.0, 9), ("b", True, 7, None, 1), ("c", True, 7, 9.0, 1)], "url string, healthy boolean, total_requests int, average_ms double, priority int")
    assert [values(records.choose_proxy(stats, k)) for k in ("least-used", "fastest", "priority", "round-robin")] == [[("b",)], [("c",)], [("b",)], [("c",)]]
    assert values(records.choose_proxy(stats.filter("not healthy"), "fastest")) == [("a",)] and values(records.choose_proxy(stats.limit(0), "round-robin")) == []
    with pytest.raises(ValueError):
        records.choose_proxy(stats, "any")


def test_dates(spark):
    texts = ["2024-02-01", "2024/02/01", "01-02-2024", "01/02/2024", "February 1, 2024", "Feb 1, 2024", "2024-02-01 00:00:00", "2024-02-01T00:00:00Z", "2024-02-01T02:00:00+02:00"]
    df = spark.createDataFrame([(t,) for t in [*texts, "soon", "", None]], "t string")
    assert [r[0] for r in df.select(F.date_format(records.page_date(F.col("t")), "yyyy-MM-dd")).collect()] == ["2024-02-01"] * 9 + [None] * 3
    feed = spark.createDataFrame([("Thu, 01 Feb 2024 10:00:00 GMT",), ("1 Feb 2024 12:00:00 +0200",), ("2024-02-01T10:00:00Z",), ("x",)], "t string")
    assert [r[0] for r in feed.select(F.date_format(records.feed_date(F.col("t")), "yyyy-MM-dd HH:mm")).collect()] == ["2024-02-01 10:00"] * 3 + [None]


def test_vectors(spark):
    v = hybrid.hash_vector("One two, one", 16)
    assert np.isclose(np.linalg.norm(v), 1) and not hybrid.hash_vector(" .,", 16).any() and (v == hybrid.hash_vector("one TWO one", 16)).all()
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "n int, t string")
    rows = {r.n: r.v for r in df.select("n", hybrid.embedded(F.col("t"), 8).alias("v")).collect()}
    assert len(rows[1]) == 8 and rows[2] is None and not any(rows[3])
    now = F.lit("2024-01-10T00:00:00Z").cast("timestamp")
    cache = hybrid.cache_entries(df.select("n", "t", hybrid.embedded(F.col("t"), 8).alias("v")), "t", "v", now)
    assert cache.count() == 2
    hit = hybrid.cached_vectors(df, cache, "t", now).filter("cached is not null")
    late = hybrid.cached_vectors(df, cache, "t", now + F.expr("INTERVAL 8 DAYS")).filter("cached is not null")
    assert values(hit.select("n")) == [(1,), (3,)] and late.count() == 0


def test_graph_patterns(spark):
    assert graph.read_pattern("MATCH (n) RETURN n") == "nodes" and graph.read_pattern("MATCH (a)-[r]->(b) RETURN a, r, b") == "edges"
    with pytest.raises(ValueError):
        graph.read_pattern("CREATE (n)")
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (6, 6), (None, 1)], "src long, dst long")
    assert values(components.linked_classes(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long")
    assert components.linked_classes(chain).filter("label = 0").count() == 71
