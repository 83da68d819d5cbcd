"""Exports of websets: CSV rows, Markdown sections, JSON documents. One row a piece, so that no export gathers a webset in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmill.operators.records import numbered_within
from weirmill.operators.skew import lookup_join


def csv_rows(items: DataFrame) -> DataFrame:
    """The seven columns of a CSV export; nulls are empty texts."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return items.select(
        text("id").alias("id"), text("url").alias("url"), text("title").alias("title"), text("content_hash").alias("content_hash"), text("item_metadata").alias("metadata"),
        text("enrichments").alias("enrichments"), F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"),
    )


def write_csv(items: DataFrame, path: str) -> None:
    csv_rows(items).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def markdown(websets: DataFrame, items: DataFrame) -> DataFrame:
    """(webset_id, part, section): an item's section, numbered from 1, newest first; part 0 for a webset without items."""
    own = items.select(F.col("webset_id"), "row_no", "title", "url", "created_at")
    numbered = numbered_within(own.filter("webset_id is not null"), "webset_id", [F.desc_nulls_last("created_at"), F.asc("row_no")], "part")
    kept = lookup_join(numbered, websets.select(F.col("id").alias("webset_id"), F.lit(True).alias("known")), ["webset_id"]).filter("known")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled"))
    sections = kept.select("webset_id", "part", F.concat(F.lit("## "), "part", F.lit(". "), title, F.lit("\nURL: "), F.coalesce("url", F.lit(""))).alias("section"))
    empty = websets.select(F.col("id").alias("webset_id")).join(own.select("webset_id").distinct(), "webset_id", "left_anti")
    return sections.unionByName(empty.select("webset_id", F.lit(0).alias("part"), F.lit("No items").alias("section")))


def json_documents(websets: DataFrame, items: DataFrame) -> DataFrame:
    """(webset_id, row_no, document): a JSON line for each item beside its webset; a webset without items has one with item null."""
    head = F.struct(F.col("w.id").alias("id"), F.col("w.name").alias("name"), F.col("w.search_query").alias("search_query"), F.col("w.entity_type").alias("entity_type"))
    item = F.when(F.col("i.row_no").isNotNull(), F.struct(F.col("i.id").alias("id"), F.col("i.url").alias("url"), F.col("i.title").alias("title"), F.col("i.item_metadata").alias("metadata")))
    joined = websets.alias("w").join(items.alias("i"), F.col("i.webset_id") == F.col("w.id"), "left")
    return joined.select(F.col("w.id").alias("webset_id"), F.col("i.row_no").alias("row_no"), F.to_json(F.struct(head.alias("webset"), item.alias("item"))).alias("document"))


def json_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("webset_id").agg(F.count("row_no").alias("total_items"))
