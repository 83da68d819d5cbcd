"""Table loading: one Parquet table (file or folder) per name below a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "websets", "webset_items", "monitors", "monitor_runs", "ruvector_docs", "fetch_results", "parsed_content",
    "deleted_keys", "source_targets", "known_names",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table; zone-less timestamps become TIMESTAMP so that watermarks and intervals work on them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(zoneless) if zoneless else df
