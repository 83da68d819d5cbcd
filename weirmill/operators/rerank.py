"""Reranking of results: by score, recency, both, diversity and marginal relevance, and removal of near repeats.

Greedy operators work a query at a time on its result list, whose length is the caller's top-k; they keep the order of ``ord``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_score(df: DataFrame, query: str, score: str = "score", order: str = "ord", top_k: int | None = None) -> DataFrame:
    """Ranked by score, ties in input order; top_k of None or 0 keeps all."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), F.asc(order))))
    return ranked.filter(F.col("rank") <= top_k) if top_k else ranked


def recency(time: Column, now: Column, scale_days: float = 30.0) -> Column:
    """exp(-age in whole days / scale); 0 without a time; more than 1 for future times."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(time)) / 86400)
    return F.coalesce(F.exp(-age / scale_days), F.lit(0.0))


def hybrid_score(df: DataFrame, query: str, score: str, recent: Column, weight: float = 0.7) -> DataFrame:
    """``weight`` times the min-max scaled score (0 where all are equal) plus the rest of recency, as ``combined``."""
    own = Window.partitionBy(query)
    low, high = F.min(score).over(own), F.max(score).over(own)
    scaled = (F.col(score) - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return df.withColumn("combined", F.lit(weight) * scaled + F.lit(1 - weight) * recent)


def custom(df: DataFrame, query: str, score: Callable[[DataFrame], Column], order: str = "ord", top_k: int | None = None) -> DataFrame:
    """Ranked by a column the caller builds."""
    return by_score(df.withColumn("custom_score", score(df)), query, "custom_score", order, top_k)


def _overlap(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def diverse_order(texts: list[str]) -> list[int]:
    """Starts at the first, then always takes the text least like those taken, on average; ties to the earliest."""
    sets = [set((t or "").lower().split()) for t in texts]
    left, taken, sums = list(range(1, len(sets))), [0] if sets else [], [0.0] * len(sets)
    while left:
        for i in left:
            sums[i] += _overlap(sets[i], sets[taken[-1]])
        best = min(left, key=lambda i: (round(sums[i] / len(taken), 12), i))
        taken.append(best)
        left.remove(best)
    return taken


def marginal_order(scores: np.ndarray, vectors: np.ndarray, trade: float = 0.5) -> list[int]:
    """Starts at the first, then takes the greatest trade * score - (1 - trade) * max(0, nearest taken); ties to the earliest."""
    if not len(scores):
        return []
    norms = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, norms[:, None], out=np.zeros_like(vectors), where=norms[:, None] > 0)
    nearest, taken, free = np.zeros(len(scores)), [0], np.ones(len(scores), bool)
    free[0] = False
    while free.any():
        nearest = np.maximum(nearest, unit @ unit[taken[-1]])
        value = np.where(free, np.round(trade * scores - (1 - trade) * nearest, 12), -np.inf)
        taken.append(int(np.argmax(value)))
        free[taken[-1]] = False
    return taken


def _grouped(df: DataFrame, query: str, key: str, order: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
        at = order(rows)
        return pd.DataFrame({query: rows[query].iloc[at].to_numpy(), key: rows[key].iloc[at].to_numpy(), "rank": np.arange(1, len(at) + 1)})

    return df.groupBy(query).applyInPandas(run, f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, rank long")


def by_diversity(df: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """(query, key, rank) in diverse order."""
    return _grouped(df.select(query, key, "ord", text), query, key, lambda rows: diverse_order(rows[text].tolist()))


def by_marginal_relevance(df: DataFrame, query: str, key: str, score: str, vector: str, text: str | None = None, trade: float = 0.5) -> DataFrame:
    """(query, key, rank) by marginal relevance; a list in which a vector is missing falls back to diverse order of ``text``."""

    def order(rows: pd.DataFrame) -> list[int]:
        if rows[vector].isna().any():
            return diverse_order(rows[text].tolist()) if text else list(range(len(rows)))
        return marginal_order(rows[score].to_numpy(float), np.stack(rows[vector].to_numpy()).astype(float), trade)

    return _grouped(df.select(query, key, "ord", score, vector, *([text] if text else [])), query, key, order)


def without_repeats(df: DataFrame, query: str, key: str, text: str, limit: float = 0.9) -> DataFrame:
    """(query, key, rank) of results that are less than ``limit`` alike to every one kept before."""

    def order(rows: pd.DataFrame) -> list[int]:
        sets = [set((t or "").lower().split()) for t in rows[text]]
        kept: list[int] = []
        for i, s in enumerate(sets):
            if all(_overlap(s, sets[j]) < limit for j in kept):
                kept.append(i)
        return kept

    return _grouped(df.select(query, key, "ord", text), query, key, order)
