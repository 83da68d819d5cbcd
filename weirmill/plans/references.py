"""Queries of problem 3: orphan references per table and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirmill.operators.references import orphan_references, orphans_by_period
from weirmill.tables import table

#: referring table, key column, row key, parent table, entity name in the log of deleted keys
REFERENCES = (
    ("webset_items", "webset_id", "row_no", "websets", "webset"),
    ("webset_items", "ruvector_doc_id", "row_no", "ruvector_docs", "ruvector_doc"),
    ("monitor_runs", "monitor_id", "run_no", "monitors", "monitor"),
)


def _one(spark: SparkSession, sf_dir: str, child: str, key: str, rec: str, parent: str, entity: str) -> DataFrame:
    gone = table(spark, sf_dir, "deleted_keys").filter(F.col("entity") == entity)
    found = orphan_references(
        table(spark, sf_dir, child), table(spark, sf_dir, parent), [key], ["id"],
        rec=rec, child_time="loaded_at", parent_time="loaded_at", deleted=gone, deleted_keys=["key_id"],
    )
    return found.select(F.lit(f"{child}.{key}").alias("ref_field"), F.col("rec").alias("rec_no"), "kind")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan reference of the three fields."""
    parts = [_one(spark, sf_dir, *ref) for ref in REFERENCES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references counted per field, month of arrival and kind."""
    parts = []
    for child, key, rec, parent, entity in REFERENCES:
        times = table(spark, sf_dir, child).select(F.col(rec).alias("rec_no"), "loaded_at")
        parts.append(_one(spark, sf_dir, child, key, rec, parent, entity).join(times, "rec_no"))
    return orphans_by_period(parts[0].unionByName(parts[1]).unionByName(parts[2]), "ref_field", "kind", "loaded_at")


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_KEY = "nullif(lower(trim({0}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160))), '')"


def _sql(child: str, key: str, rec: str, parent: str, entity: str) -> str:
    k = _KEY.format
    return f"""select '{child}.{key}' as ref_field, c.rec_no, c.arrived, case when p.k is not null then 'late' when d.k is not null then 'deleted' else 'missing' end as kind
    from (select {rec} as rec_no, loaded_at as arrived, {k(key)} as k from {child}) c
    left join (select {k("id")} as k, min(loaded_at) as first_at from {parent} group by 1) p on p.k = c.k
    left join (select distinct {k("key_id")} as k from deleted_keys where entity = '{entity}') d on d.k = c.k
    where c.k is not null and (p.k is null or p.first_at > c.arrived)"""


_ALL = " union all ".join(_sql(*ref) for ref in REFERENCES)
ORACLE = {
    "p3_found": f"select ref_field, rec_no, kind from ({_ALL})",
    "p3_report": f"select ref_field, strftime(date_trunc('month', arrived at time zone 'UTC'), '%Y-%m-%d') as period, kind, count(*) as n_refs from ({_ALL}) group by 1, 2, 3",
}
