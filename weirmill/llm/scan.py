"""One pass over the items' texts for the operators that read them: line by line, each line's words are taken once.

Residue looks for evidence and counts lines by host, the page model needs the lines' classes, and the batch hashes the words of the
main body; all of it is made here in one Arrow pass, and written once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmill.functions.text import key_text, strip
from weirmill.functions.urls import canonical_url
from weirmill.llm import boilerplate, residue
from weirmill.llm.hashing import line_key, parities, word_numbers
from weirmill.session import stored

_WORD = re.compile(r"\w+")


def _facts(t: str, shaped: bool) -> tuple[str | None, str | None, list[str], int]:
    low = t.lower()
    words = _WORD.findall(low)
    return boilerplate.shape(t, low, words) if shaped else None, residue.evidence(t, low, words), words, line_key(words)


_facts_short = lru_cache(maxsize=50_000)(_facts)


class Text:
    """What one text holds: evidence of residue, keys of its lines, furniture line numbers, numbers of the main body's words."""

    def __init__(self, text: str, title: str, shaped: bool):
        texts, numbers, facts = [], [], []
        for i, line in enumerate(text.split("\n")):
            t = line.strip()
            if t:
                texts.append(t)
                numbers.append(i)
                facts.append(_facts_short(t, shaped) if len(t) < 120 else _facts(t, shaped))
        self.evidence = any(f[1] for f in facts)
        self.keys = [f[3] for f in facts if f[2]]
        self.furniture: list[int] = []
        self.body: list[list[str]] = []
        if shaped:
            labels = boilerplate.model().decode(boilerplate.features(texts, title, read=[(f[0], f[2]) for f in facts]))
            self.furniture = [n for n, y in zip(numbers, labels) if y]
            # words without html escapes; an escape never goes over a line's end
            self.body = [_WORD.findall(unescape(unescape(t)).lower()) if "&" in t else f[2] for t, f, y in zip(texts, facts, labels) if not y]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if len(rows) and ends[-1] else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


_KEPT = "row_no long, batch_no int, page binary, stated string, host long, text_id long, title string"
_MADE = ", content string, evidence boolean, keys array<long>"


def scanned(items: DataFrame, furniture: bool = False, prints: bool = False) -> DataFrame:
    """(row_no, batch_no, page, stated, host, text_id, title, content, evidence, keys) of each row, written once.

    page, stated: the page the url leads to, and the row's content_hash, with ``prints`` only; host, text_id: hashes of the url's
    host and of the content; content and title stay only where a line has evidence; keys: of the lines, for counting. Null and
    blank contents have no text_id. With ``furniture``: the numbers of the lines outside the main body. With ``prints``: exact (a
    digest of the main body's words), words (16 bits each), n_words and bits (see hashing.parities).
    Missing batch numbers count as 0. Extra columns are ignored.
    """
    columns = set(items.columns)
    none = F.lit(None)
    url = F.col("url") if "url" in columns else none.cast("string")
    text = F.when(F.col("content").rlike(r"\S"), F.col("content"))
    page = canonical_url(url)
    base = items.select(
        "row_no", (F.coalesce("batch_no", F.lit(0)) if "batch_no" in columns else F.lit(0)).cast("int").alias("batch_no"),
        (F.when(strip(url) != "", F.unhex(F.md5(page))) if prints else none.cast("binary")).alias("page"),
        (key_text(F.col("content_hash")) if prints else none.cast("string")).alias("stated"),
        F.xxhash64(F.coalesce(F.regexp_extract(page, r"^([^/?]*)", 1), F.lit(""))).alias("host"), F.when(text.isNotNull(), F.xxhash64("content")).alias("text_id"),
        F.coalesce(F.col("title") if "title" in columns else none.cast("string"), F.lit("")).alias("title"), text.alias("content"),
    )
    shaped = furniture or prints

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, titles = batch["content"].to_pylist(), batch["title"].to_pylist()
            reads = [None if x is None else Text(x, t, shaped) for x, t in zip(contents, titles)]
            held = [bool(r and r.evidence) for r in reads]
            out = [c for name, c in zip(batch.schema.names, batch.columns) if name not in ("content", "title")]
            out += [pa.array([t if h else None for t, h in zip(titles, held)], pa.string()), pa.array([x if h else None for x, h in zip(contents, held)], pa.string())]
            out += [pa.array(held), _lists([r.keys if r else [] for r in reads], pa.int64())]
            if furniture:
                out.append(_lists([r.furniture if r else [] for r in reads], pa.int32()))
            if prints:
                made = [word_numbers(r.body) if r else None for r in reads]
                raw = [None if w is None else w.tobytes() for w in made]
                short = [None if w is None else w.astype(np.uint16) for w in made]
                out.append(pa.array([blake2b(x, digest_size=16).digest() if x else None for x in raw], pa.binary()))
                out.append(pa.array([None if w is None else w.tobytes() for w in short], pa.binary()))
                out.append(pa.array([0 if w is None else len(w) for w in short], pa.int32()))
                out.append(pa.array([None if w is None else parities(w) for w in short], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = _KEPT + _MADE + (", furniture array<int>" if furniture else "") + (", exact binary, words binary, n_words int, bits binary" if prints else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return stored(base.mapInArrow(run, schema), "scan")
