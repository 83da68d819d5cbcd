"""String expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the code points that count as white space (Unicode White_Space and the four ASCII separators).
WHITE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
#: The same as a Java regex class body.
WHITE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0  -     　"


def strip(text: Column) -> Column:
    """``text`` without white space (Unicode) at both ends."""
    return F.trim(text, F.lit(WHITE))


def squash(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WHITE_CLASS}]+", " "))


def words(text: Column) -> Column:
    """Lower-cased white-space tokens without empties; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{WHITE_CLASS}]+"), lambda w: w != "")


def key_text(key: Column) -> Column:
    """A key without case and outer white space; null if nothing is left."""
    return F.nullif(F.lower(strip(key)), F.lit(""))


def digest(*cols: Column) -> Column:
    """128-bit digest of the columns, nulls told apart from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x00", *parts)))
