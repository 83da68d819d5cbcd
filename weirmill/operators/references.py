"""References to records that do not exist, or that arrive later."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmill.functions.text import key_text
from weirmill.operators.skew import lookup_join

MATCH = ("simple", "full", "partial")




def orphan_references(
    children: DataFrame,
    parents: DataFrame,
    child_keys: list[str],
    parent_keys: list[str],
    *,
    rec: str,
    match: str = "simple",
    child_time: str | None = None,
    parent_time: str | None = None,
    deleted: DataFrame | None = None,
    deleted_keys: list[str] | None = None,
    text_keys: bool = True,
) -> DataFrame:
    """Orphan references of ``children``: columns (rec, kind).

    References are grouped by null mask (which key columns are null); the rows of a mask are joined to the parents on the
    mask's non-null columns. ``match`` declares what a partly null key means: ``simple`` - no reference; ``full`` - a
    violation, kind ``partial``; ``partial`` - it needs a parent that agrees on the non-null columns. A key that is null
    throughout is no reference. kind is ``late`` if the earliest parent's time is after the child's (a null time is never
    late), ``deleted`` if there is no parent but the key is in ``deleted``, else ``missing``. With ``text_keys`` keys are
    compared without case and outer white space, and blank ones are null. Repeated children give repeated rows; repeated
    parents count as their earliest. Parents are reduced to one row a key before any shuffle of children, and children
    with hot keys are joined by a broadcast of at most 100 rows.
    """
    if match not in MATCH:
        raise ValueError(f"match must be one of {MATCH}")
    keyed = (lambda c: key_text(F.col(c))) if text_keys else F.col
    names = [f"k{i}" for i in range(len(child_keys))]
    kids = children.select(
        F.col(rec).alias("rec"),
        (F.col(child_time) if child_time else F.lit(None).cast("timestamp")).alias("child_time"),
        *(keyed(c).alias(n) for c, n in zip(child_keys, names)),
    )
    full = parents.select(
        (F.col(parent_time) if parent_time else F.lit(None).cast("timestamp")).alias("parent_time"),
        *(keyed(c).alias(n) for c, n in zip(parent_keys, names)),
    )
    gone = deleted.select(*(keyed(c).alias(n) for c, n in zip(deleted_keys, names))) if deleted is not None else None
    found = []
    for mask in product((True, False), repeat=len(names)):
        held = [n for n, there in zip(names, mask) if there]
        if not held:
            continue
        rows = kids
        for n, there in zip(names, mask):
            rows = rows.filter(F.col(n).isNotNull() if there else F.col(n).isNull())
        if not all(mask):
            if match == "simple":
                continue
            if match == "full":
                found.append(rows.select("rec", F.lit("partial").alias("kind")))
                continue
        known = full.dropna(subset=held).groupBy(*held).agg(F.min("parent_time").alias("first_time"), F.lit(True).alias("exists"))
        if gone is not None:
            erased = gone.dropna(subset=held).select(*held).distinct().withColumn("erased", F.lit(True))
            known = known.join(erased, held, "full")
        else:
            known = known.withColumn("erased", F.lit(None).cast("boolean"))
        kind = (
            F.when(F.col("exists") & (F.col("first_time") > F.col("child_time")), "late")
            .when(F.col("exists"), None)
            .when(F.col("erased"), "deleted")
            .otherwise("missing")
        )
        joined = lookup_join(rows.select("rec", "child_time", *held), known, held)
        found.append(joined.select("rec", kind.alias("kind")).filter(F.col("kind").isNotNull()))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def orphans_by_period(orphans: DataFrame, field: str, kind: str, time: str, period: str = "month") -> DataFrame:
    """Counts of orphan references per field, period (of the referring row's ``time``; null kept as its own) and kind."""
    return orphans.groupBy(
        F.col(field).alias("ref_field"), F.date_format(F.date_trunc(period, F.col(time)), "yyyy-MM-dd").alias("period"), F.col(kind).alias("kind")
    ).agg(F.count(F.lit(1)).alias("n_refs"))
