"""Embedding columns, their cache, and search that joins lexical and vector lists."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmill.functions.text import words
from weirmill.operators import lexical

#: Days an embedding stays in the cache, and how many texts are embedded at once.
TTL_DAYS, BATCH = 7, 32
_WORD = re.compile(r"\w+")


def hash_vector(text: str, dim: int) -> np.ndarray:
    """A unit vector of signed word hashes; zeros for a text without words. Stands in where no model is at hand."""
    out = np.zeros(dim, np.float32)
    for w in _WORD.findall(text.lower()):
        h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out[h % dim] += 1.0 if h >> 31 else -1.0
    norm = float(np.linalg.norm(out))
    return out / np.float32(norm) if norm else out


def embedded(text: Column, dim: int = 384, embed=hash_vector) -> Column:
    """The vectors of a text column, by ``embed(text, dim)``, in Arrow batches; null stays null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else embed(x, dim) for x in batch], dtype=object)

    return run(text)


def cached_vectors(docs: DataFrame, cache: DataFrame, text: str, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """``docs`` with ``cached``: the vector kept for the text's SHA-256, if it is at most ``ttl_days`` old; else null.

    ``cache``: (text_sha, cached, cached_at); the newest entry of a text counts.
    """
    fresh = cache.filter(F.col("cached_at") >= now - F.expr(f"INTERVAL {ttl_days} DAYS"))
    newest = fresh.groupBy("text_sha").agg(F.max_by("cached", "cached_at").alias("cached"))
    return docs.withColumn("text_sha", F.sha2(F.col(text), 256)).join(newest, "text_sha", "left")


def cache_entries(docs: DataFrame, text: str, vector: str, now: Column) -> DataFrame:
    """What is appended to the cache: one entry for each text that was embedded."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(vector).isNotNull())
    return rows.groupBy(F.sha2(F.col(text), 256).alias("text_sha")).agg(F.first(vector).alias("cached")).withColumn("cached_at", now)


def or_zero(vector: Column, dim: int) -> Column:
    """A missing vector becomes zeros, which are similar to nothing."""
    return F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dim))


def hybrid_search(lexical_list: DataFrame, vector_list: DataFrame, query: str, key: str, alpha: float, k: int) -> DataFrame:
    """(query, key, score, rank) of the ``k`` best: by words alone (alpha 0) or vectors alone (alpha 1), scaled to 0..1, else both
    ranked lists fused. The lists: (query, key, score, rank), already cut to 2 k each."""
    if alpha == 0:
        scores = lexical.min_max(lexical_list, query, "score").select(query, key, F.col("scaled").alias("score"))
    elif alpha == 1:
        scores = lexical.min_max(vector_list, query, "score").select(query, key, F.col("scaled").alias("score"))
    else:
        scores = lexical.fuse(lexical_list, vector_list, query, key, alpha)
    return lexical.best(scores, query, key, "score", k)


def index_statistics(docs: DataFrame, text: str, alpha: float) -> DataFrame:
    """One row: alpha, documents, vocabulary size and the constant of rank fusion."""
    terms = docs.select(F.posexplode_outer(F.array_distinct(words(F.col(text)))).alias("pos", "term"))
    counted = terms.agg(F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("n_docs"), F.count_distinct("term").alias("n_terms"))
    return counted.select(F.lit(alpha).alias("alpha"), "n_docs", "n_terms", F.lit(lexical.RRF).alias("rrf_k"))
