"""Queries of the subpackage and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.llm import batch_dedup, boilerplate, mixing, packing, pii, residue, scan, site_lines, splitting, survivors
from weirmill.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivor_fields(table(spark, sf_dir, "webset_items"))


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.merged_pages(table(spark, sf_dir, "webset_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = scan.scanned(table(spark, sf_dir, "webset_items"), furniture=True)
    return boilerplate.page_furniture(read, table(spark, sf_dir, "fetch_results"), residue.faulty_contents(read))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, sf_dir, "parsed_content")).withColumnRenamed("doc", "parsed_no")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = site_lines.without_repeated_lines(table(spark, sf_dir, "parsed_content"))
    return docs.select("parsed_no", "text", "n_removed")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of problem 5: (table_name, rec_no, text)."""
    items = table(spark, sf_dir, "webset_items").select(
        F.lit("webset_items").alias("table_name"), F.col("row_no").alias("rec_no"), F.col("content").alias("text")
    )
    parsed = table(spark, sf_dir, "parsed_content").select(
        F.lit("parsed_content").alias("table_name"), F.col("parsed_no").alias("rec_no"), "text"
    )
    return items.unionByName(parsed)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_texts(spark, sf_dir), ["table_name", "rec_no"], "text")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(_texts(spark, sf_dir), ["table_name", "rec_no"], "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "webset_items")
    return residue.faulty_fields(items, scan.scanned(items))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "webset_items")
    return residue.real_items(items, scan.scanned(items)).select("row_no", "id", "url", "title")


def _prints(items: DataFrame) -> DataFrame:
    read = scan.scanned(items, prints=True)
    return batch_dedup.prints(read, residue.faulty_contents(read))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_dedup.batch_repeats(_prints(table(spark, sf_dir, "webset_items")))


def p7_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "webset_items")
    return batch_dedup.new_items(items, _prints(items)).select("row_no", "batch_no", "url", "title")


def _tokens() -> Column:
    """Size of a document: its count of word-and-punctuation tokens, computed where it is missing."""
    return F.coalesce(F.col("n_tokens"), packing.token_count(F.col("text")))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", _tokens())


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, sf_dir))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"), "doc_id", "source", _tokens())


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def _tempered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A mix of as many tokens as there are: the exponent is bisected against the sources' repeats."""
    docs = table(spark, sf_dir, "documents")
    total = docs.filter("source is not null").agg(F.sum(_tokens())).first()[0]
    return mixing.mix(docs, table(spark, sf_dir, "source_targets"), "doc_id", "source", _tokens(), int(total or 0))


def p9_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tempered(spark, sf_dir)[0]


def p9_tempered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tempered(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.personal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))
    return spans.select("doc_id", "kind", "start_pos").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.without_personal(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_names"))
    return docs.select("doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pages, p2_found, p4_found, p4_cleaned, p5_found, p5_pieces, p6_found, p6_kept, p7_found, p7_new, p8_packed, p8_report, p9_draws, p9_report, p9_tempered, p9_tempered_report, p10_found, p10_redacted)}

_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(8195)||chr(8201)||chr(8239)||chr(12288)"

ORACLE = {
    "p5_found": f"""
        select 'webset_items' as table_name, row_no as rec_no from webset_items where length(trim(content, {_WS})) > 2000
        union all select 'parsed_content', parsed_no from parsed_content where length(trim(text, {_WS})) > 2000""",
    "p4_found": r"""
        with l as (
            select parsed_no, cast(i - 1 as int) as line_no, lines[i] as line, lower(regexp_replace(trim(site_name), '\s+', ' ', 'g')) as site
            from (select parsed_no, site_name, str_split(text, chr(10)) as lines, unnest(generate_series(1, len(str_split(text, chr(10))))) as i
                  from parsed_content where trim(site_name) <> '')),
        k as (
            select parsed_no, line_no, site, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '[\s\x{a0}]+', ' ', 'g'),
                   '\pN+', '0', 'g'), '^[^\pL\pN]+', ''), '[^\pL\pN]+$', '') as key
            from l where regexp_matches(line, '\pL'))
        select k.parsed_no, k.line_no from k
        join (select site, key from k group by 1, 2 having count(distinct parsed_no) >= 8) using (site, key)""",
}
