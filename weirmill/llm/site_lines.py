"""Lines repeated across the documents of one source, and their removal.

The documents of a line are a bitmap over document numbers, compressed by storing only its non-zero 64-bit words: a row
(site, line, word) -> bits. Words are built and variant lines' words are united by bitwise or inside one aggregation that
combines before the shuffle, so a line of a third of all documents costs one row for 64 documents. Cardinality is the exact
sum of the words' bits; a document's line is deleted if its bit is set in the word of a line over the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.functions.text import WHITE_CLASS, squash, strip
from weirmill.session import stored

#: A line must be in this many documents of its source.
LEAST_DOCUMENTS = 8


def line_key(line: Column) -> Column:
    """What variant lines share: no case, runs of white space as one blank, runs of digits as one zero, nothing at either
    end that is neither letter nor digit. Null for lines without a letter."""
    text = F.regexp_replace(F.regexp_replace(F.lower(line), f"[{WHITE_CLASS}]+", " "), r"\p{N}+", "0")
    text = F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.when(line.rlike(r"\p{L}"), text)


def source_key(source: Column) -> Column:
    """A source without case, outer and repeated white space; null if blank."""
    return F.nullif(F.lower(squash(source)), F.lit(""))


def keyed_lines(docs: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    """(doc, line_no, key): each line with a letter of each document with a source; key is a digest of source and line key."""
    lines = docs.filter(strip(F.col(source)) != "").select(
        F.col(doc).alias("doc"),
        source_key(F.col(source)).alias("source"),
        F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"),
    )
    return lines.select("doc", "line_no", "source", line_key(F.col("line")).alias("line")).filter(F.col("line").isNotNull()).select(
        "doc", "line_no", F.unhex(F.md5(F.concat_ws("\n", "source", "line"))).alias("key")
    )


def line_bitmaps(lines: DataFrame) -> DataFrame:
    """(key, word, bits): the non-zero words of each line's bitmap of documents, variants united."""
    bit = F.expr("shiftleft(1L, cast(doc & 63 as int))")
    return lines.groupBy("key", F.shiftright("doc", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def frequent_bitmaps(bitmaps: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The bitmaps whose exact cardinality reaches ``least``."""
    enough = bitmaps.groupBy("key").agg(F.sum(F.bit_count("bits")).alias("n_docs")).filter(F.col("n_docs") >= least)
    return bitmaps.join(enough, "key")


def repeated_lines(docs: DataFrame, doc: str = "parsed_no", text: str = "text", source: str = "site_name", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(doc, line_no) of every line that occurs in at least ``least`` documents of its source.

    Several times in one document count once; ``doc`` must be a non-negative integer unique to the row. Null or blank
    sources, null texts, and lines without a letter are left out. Lines count from 0 and are split at line feeds.
    """
    lines = stored(keyed_lines(docs, doc, text, source), "site-lines")
    over = frequent_bitmaps(line_bitmaps(lines), least).select("key", "word", "bits")
    hit = F.expr("(shiftright(bits, cast(doc & 63 as int)) & 1L) = 1L")
    probe = lines.withColumn("word", F.shiftright("doc", 6))
    return probe.join(over, ["key", "word"]).filter(hit).select("doc", "line_no")


def without_repeated_lines(docs: DataFrame, doc: str = "parsed_no", text: str = "text", source: str = "site_name", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The documents with ``text`` cut of its repeated lines, and their number as ``n_removed``; other rows are unchanged.

    All columns are kept. A document whose lines are all repeated gets an empty text; a null text stays null.
    """
    drop = repeated_lines(docs, doc, text, source, least).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line_no").alias("__drop"))
    kept = F.expr(f"filter(split(`{text}`, '\\n'), (x, i) -> not array_contains(__drop, i))")
    return (
        docs.join(drop, doc, "left")
        .withColumn(text, F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_removed", F.coalesce(F.size("__drop"), F.lit(0)))
        .drop("__drop")
    )
