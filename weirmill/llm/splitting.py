"""Splitting oversized texts at natural boundaries, by packing a structure tree.

A text is a tree: sections by heading, blocks between blank lines, lines and list items, sentences, clauses, words and, last,
characters. Only a node over the limit is opened, at the coarsest boundary it has; its children's pieces are merged with their
siblings, bottom-up and from the left, as long as they stay under the limit. Texts within the limit never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.functions.text import strip

#: Default size limit of a piece and overlap of consecutive pieces, in code points.
LIMIT, OVERLAP = 2000, 100

_HEADINGS = [re.compile(rf"(?m)^(?=[ \t]{{0,3}}#{{{n}}}[ \t]|[ \t]*<h{n}\b)", re.I) for n in range(1, 7)]
#: Boundaries from coarse to fine; a match's end is where the next child begins.
_LEVELS = [
    *_HEADINGS,
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"</(?:p|li|tr|ul|ol|table|blockquote|div|section|article)\s*>\s*|\n(?=[ \t]*(?:[-*•+]|\d{1,3}[.)])[ \t])", re.I),
    re.compile(r"\n+|\r+"),
    re.compile(r"[.!?…](?:[\"'”’»)\]]*)\s+|[。！？]+"),
    re.compile(r"[;:,–—]\s+|[，；、]"),
    re.compile(r"\s+"),
]
_JOINS = re.compile(r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︀-️︠-︯‍\U0001F3FB-\U0001F3FF\U000E0020-\U000E007F]")


def _children(text: str, start: int, stop: int, level: int) -> tuple[list[int], int]:
    """Boundaries (start and stop included) at the first level from ``level`` on that cuts the node, and the next level."""
    for k in range(level, len(_LEVELS)):
        cuts = [m.end() for m in _LEVELS[k].finditer(text, start, stop) if start < m.end() < stop]
        if cuts:
            return [start, *dict.fromkeys(cuts), stop], k + 1
    return [start, stop], len(_LEVELS)


def _characters(text: str, start: int, stop: int, size: int) -> list[int]:
    """Ends of pieces of an unbroken run; no cut inside a composed character if a cut before it exists."""
    ends = []
    while stop - start > size:
        end = start + size
        while end > start + 1 and (_JOINS.match(text[end]) or text[end - 1] == "‍"):
            end -= 1
        if end == start + 1 and size > 1 and (_JOINS.match(text[end]) or text[end - 1] == "‍"):
            end = start + size
        ends.append(end)
        start = end
    return [*ends, stop]


def piece_ends(text: str, size: int) -> list[int]:
    """Ends of consecutive pieces of at most ``size`` code points that cover ``text``."""

    def pack(start: int, stop: int, level: int) -> list[int]:
        if stop - start <= size:
            return [stop]
        cuts, below = _children(text, start, stop, level)
        if len(cuts) == 2:
            return _characters(text, start, stop, size)
        ends: list[int] = []
        begin = start  # of the last piece
        for a, b in zip(cuts, cuts[1:]):
            for end in pack(a, b, below) if b - a > size else (b,):
                if ends and end - begin <= size:
                    ends[-1] = end
                else:
                    begin = ends[-1] if ends else start
                    ends.append(end)
        return ends

    return pack(0, len(text), 0)


def _cuts(size: int):
    @F.pandas_udf("array<int>")
    def ends(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: piece_ends(t, size))

    return ends


def pieces(docs: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``limit`` code points: (keys, piece_no, start_pos, core_pos, end_pos, piece).

    White space at both ends of the text is dropped first; positions count code points of what is left. The cores
    [core_pos, end_pos) cover the text without gap; each piece but the first also repeats the ``overlap`` code points before its
    core, so its start_pos is core_pos - overlap. A text within the limit is one piece. Null and blank texts have no piece.
    Repeated rows give repeated pieces. Cuts never fall inside a composed character unless it is longer than a piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and smaller than limit")
    body = docs.select(*keys, strip(F.col(text)).alias("__text")).filter(F.col("__text") != "")
    whole = body.filter(F.char_length("__text") <= limit).withColumn("__ends", F.array(F.char_length("__text")))
    cut = body.filter(F.char_length("__text") > limit).withColumn("__ends", _cuts(limit - overlap)(F.col("__text")))
    spans = F.transform(
        "__ends",
        lambda e, i: F.struct(
            i.alias("piece_no"),
            F.when(i == 0, 0).otherwise(F.get("__ends", i - 1)).cast("int").alias("core_pos"),
            e.alias("end_pos"),
        ),
    )
    rows = whole.unionByName(cut).select(*keys, "__text", F.inline(spans))
    start: Column = F.greatest(F.lit(0), F.col("core_pos") - overlap)
    return rows.select(
        *keys, "piece_no", start.alias("start_pos"), "core_pos", "end_pos",
        F.substring(F.col("__text"), start + 1, F.col("end_pos") - start).alias("piece"),
    )


def oversized(docs: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The keys of texts that were cut: those with a second piece."""
    return pieces(docs, keys, text, limit, overlap).filter(F.col("piece_no") == 1).select(*keys)
