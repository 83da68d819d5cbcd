"""Vector search, feedback weighting and their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in a block of the table and in a block of the query set; a task holds one of each.
TABLE_BLOCK, QUERY_BLOCK = 20_000, 500


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if the lengths differ, either is null or empty, or either norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def weighted(score: Column, m: Column) -> Column:
    """A score lowered by a methylation weight between 0 and 1; null counts as 0."""
    return score * (1 - clamp(F.coalesce(m.cast("double"), F.lit(0.0)), 0.0, 1.0))


def decayed(m: Column, adjusted: Column, now: Column, halflife_hours: float) -> Column:
    """A weight halved every ``halflife_hours`` since it was adjusted; unchanged without a time or a positive half-life."""
    if halflife_hours <= 0:
        return m
    hours = (F.unix_timestamp(now) - F.unix_timestamp(adjusted)) / 3600.0
    return F.when(adjusted.isNotNull(), m * F.pow(F.lit(0.5), hours / halflife_hours)).otherwise(m)


def feedback_step(m: Column, kind: Column, quality: Column, resistance: Column) -> Column:
    """One feedback event: grounded lowers the weight, ignored raises it up to the resistance, others leave it."""
    grounded = F.greatest(m * clamp(F.coalesce(quality, F.lit(0.9)), 0.5, 0.99), F.lit(0.0))
    ignored = F.least(m + F.coalesce(quality * 0.1, F.lit(0.05)), clamp(F.coalesce(resistance, F.lit(1.0)), 0.0, 1.0))
    return F.when(kind == "grounded", grounded).when(kind == "ignored", ignored).otherwise(m)


def feedback_fold(log: DataFrame, key: str, order: str, start: float = 0.0) -> DataFrame:
    """The weight of each key after its events in order; ``log``: key, order, kind, quality. Keys' event lists are folded in the JVM."""
    events = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("kind").alias("kind"), F.col("quality").alias("quality"))))
    folded = F.aggregate("events", F.lit(start), lambda m, e: feedback_step(m, e["kind"], e["quality"], F.lit(1.0)))
    return log.groupBy(key).agg(events.alias("events")).select(key, F.size("events").alias("n_events"), folded.alias("weight"))


def weight_stats(df: DataFrame, m: str) -> DataFrame:
    """Count, mean and buckets below 0.05, below 0.5 and above of a weight column."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg(m), 3).alias("mean"), F.count_if(F.col(m) < 0.05).alias("low"),
        F.count_if((F.col(m) >= 0.05) & (F.col(m) < 0.5)).alias("medium"), F.count_if(F.col(m) >= 0.5).alias("high"),
    )


_TOP = "query_id long, id long, score double"


def _block_top(k: int, exclude_self: bool):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        out = []
        for size, q in queries.groupby(queries["v"].map(len)):
            t = rows[rows["v"].map(len) == size]
            if not size or not len(t):
                continue
            a, b = np.stack(q["v"].to_numpy()).astype(np.float64), np.stack(t["v"].to_numpy()).astype(np.float64)
            norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
            score = np.divide(a @ b.T, norms, out=np.zeros(norms.shape), where=norms > 0)
            ids = t["id"].to_numpy()
            if exclude_self:
                score[q["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            for i, qid in enumerate(q["id"].to_numpy()):
                out.append(pd.DataFrame({"query_id": qid, "id": ids[order[i]], "score": score[i, order[i]]}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})
        return found[found["score"] > -np.inf]

    return run


def top_similar(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, n_rows: int, n_queries: int, exclude_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows most similar to each query by cosine, ties by id, against all rows.

    Table and query set are cut into blocks; a task multiplies one block of each and keeps k a query, so no task holds more than
    TABLE_BLOCK + QUERY_BLOCK vectors. Null and empty vectors are left out.
    """
    n_tables, n_sets = max(1, -(-n_rows // TABLE_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    flat = lambda df: df.filter(F.size(vector) > 0).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = flat(rows).withColumn("tb", block(n_tables)).withColumn("qb", spread(n_sets))
    q = flat(queries).withColumn("qb", block(n_sets)).withColumn("tb", spread(n_tables))
    best = q.groupBy("tb", "qb").cogroup(t.groupBy("tb", "qb")).applyInPandas(lambda a, b: _block_top(k, exclude_self)(a, b), _TOP)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, key: str, vector: str, threshold: float, n_rows: int, block_rows: int = 2_000) -> DataFrame:
    """(a, b, score): all pairs a < b with cosine of at least ``threshold``, by multiplying block against block once."""
    n = max(1, -(-n_rows // block_rows))
    flat = rows.filter(F.size(vector) > 0).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    own = flat.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    left = own.select("id", "v", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("j"))
    right = own.select(F.col("id").alias("rid"), F.col("v").alias("rv"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            same = int(a["i"].iloc[0]) == int(a["j"].iloc[0])
            for size, x in a.groupby(a["v"].map(len)):
                y = b[b["rv"].map(len) == size]
                if not len(y):
                    continue
                p, q = np.stack(x["v"].to_numpy()).astype(np.float64), np.stack(y["rv"].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(p, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
                score = np.divide(p @ q.T, norms, out=np.zeros(norms.shape), where=norms > 0)
                ia, ib = x["id"].to_numpy(), y["rid"].to_numpy()
                for r, c in zip(*np.nonzero(score >= threshold)):
                    if not same and ia[r] != ib[c] or ia[r] < ib[c]:
                        out.append((min(ia[r], ib[c]), max(ia[r], ib[c]), float(score[r, c])))
        return pd.DataFrame(out, columns=["a", "b", "score"])

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "a long, b long, score double")
