"""Text cleaning, chunking and hashing."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirmill.functions.text import WHITE_CLASS, strip, words

# Boilerplate phrases, navigation words and footers that cleaning removes.
BOILERPLATE = (
    r"Skip to (main )?content", r"Click here to (subscribe|sign up|login)", r"Sign up for (our|the) newsletter", r"Follow us on (Facebook|Twitter|Instagram|LinkedIn)", r"Share this (article|post|page)",
    r"This (site|website) uses cookies", r"By continuing to use", r"Cookie (Policy|Settings|Preferences)", r"Advertisement|Sponsored Content|Promoted", r"© \d{4}.*?All rights reserved",
    r"Terms (of Use|and Conditions)|Privacy Policy",
)
NAVIGATION = (
    "home", "menu", "search", "login", "logout", "register", "signin", "signout", "subscribe", "unsubscribe", "previous", "next", "back", "forward", "close", "open", "expand", "collapse", "toggle", "more", "less",
)
FOOTERS = (r"copyright \d{4}.*$", r"all rights reserved.*$", r"privacy policy.*$", r"terms of service.*$", r"cookie policy.*$")
ABBREVIATIONS = "Dr|Mr|Mrs|Ms|Prof|Sr|Jr|vs|etc|Inc|Ltd|Corp"


@F.pandas_udf(T.StringType())
def unescape_normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Entities decoded, NFKC, characters of the categories C* removed except line feed and tab."""
    for text in batches:
        yield text.map(
            lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", html.unescape(t)) if c in "\n\t" or not unicodedata.category(c).startswith("C"))
        )


def no_urls(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, r"https?://\S+", ""), r"www\.\S+", "")


def no_emails(t: Column) -> Column:
    return F.regexp_replace(t, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "")


def no_boilerplate(t: Column) -> Column:
    for p in BOILERPLATE:
        t = F.regexp_replace(t, f"(?i){p}", "")
    return t


def plain_marks(t: Column) -> Column:
    """Zero-width characters removed; quotes, ellipsis and dashes as ASCII."""
    t = F.regexp_replace(t, "[​-‍﻿]", "")
    return F.replace(F.translate(t, "“”‘’–—―", "\"\"''---"), F.lit("…"), F.lit("..."))


def flat(t: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(t, f"[{WHITE_CLASS}]+", " ")


def short_runs(t: Column, most: int = 4) -> Column:
    """A character is repeated at most ``most`` times in a row."""
    return F.regexp_replace(t, r"(.)\1{" + str(most) + ",}", "$1" * most)


def clean(text: Column, urls: bool = False, emails: bool = False, boilerplate: bool = True, most: int = 4) -> Column:
    """Entities and characters normalised, what the flags name removed, white space flattened, repetition cut; '' for null."""
    t = unescape_normal(F.coalesce(text, F.lit("")))
    t = no_urls(t) if urls else t
    t = no_emails(t) if emails else t
    t = no_boilerplate(t) if boilerplate else t
    return strip(short_runs(flat(plain_marks(t)), most))


def _lines(t: Column) -> Column:
    return F.split(t, "\n")


def no_navigation(t: Column) -> Column:
    """Without lines that are a navigation word, or shorter than ten characters and contain one."""
    low = lambda x: F.lower(strip(x))
    is_nav = lambda x: low(x).isin(*NAVIGATION) | ((F.length(low(x)) < 10) & low(x).rlike("|".join(NAVIGATION)))
    return F.array_join(F.filter(_lines(t), lambda x: ~is_nav(x)), "\n")


def main_paragraphs(t: Column, least: int = 50) -> Column:
    """Paragraphs of at least ``least`` characters, without short ones about cookies, privacy or terms."""
    p = F.filter(F.transform(F.split(t, "\n\n"), strip), lambda x: F.length(x) >= least)
    return F.array_join(F.filter(p, lambda x: (F.length(x) >= 200) | ~F.lower(x).rlike("cookie|privacy policy|terms of use")), "\n\n")


def no_repeated_lines(t: Column) -> Column:
    """Without lines that equal the line before but for case; blank lines stay."""
    keep = lambda lines: F.filter(lines, lambda x, i: (i == 0) | (F.get(lines, i - 1) == "") | (F.lower(x) != F.lower(F.get(lines, i - 1))))
    return F.array_join(F.transform(F.array(_lines(t)), keep)[0], "\n")


def for_embedding(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``text`` cleaned of urls, e-mails and repetition, then of navigation, short and repeated lines.

    Cleaning leaves one line, so the last steps keep a text of at least 30 characters or drop it whole.
    """
    done = docs.withColumn(text, clean(F.col(text), urls=True, emails=True, most=3))
    return done.withColumn(text, no_repeated_lines(main_paragraphs(no_navigation(F.col(text)), 30)))


def for_display(text: Column) -> Column:
    return clean(text, boilerplate=False)


def text_stats(text: Column) -> Column:
    """Words, reading minutes (200 words each, at least 1) and an excerpt of 200 characters."""
    n = F.size(words(text))
    excerpt = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    return F.struct(n.alias("n_words"), F.greatest(F.lit(1), F.floor(n / 200)).cast("int").alias("minutes"), excerpt.alias("excerpt"))


def summary_words(text: Column, most: int = 200) -> Column:
    w = F.split(strip(text), f"[{WHITE_CLASS}]+")
    return F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("..."))).otherwise(text)


# chunks: arrays of structs (no, start_pos, piece)


def fixed_chunks(text: Column, size: int = 512, least: int = 100) -> Column:
    """Cuts every ``size`` characters; pieces shorter than ``least`` after stripping are dropped, and numbers count the kept."""
    def cut(t: Column) -> Column:
        starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(starts, lambda i: F.struct(i.alias("start_pos"), strip(F.substring(t, i + 1, F.lit(size))).alias("piece")))
        return F.filter(pieces, lambda c: F.length(c["piece"]) >= least)

    kept = F.transform(F.array(strip(F.coalesce(text, F.lit("")))), cut)[0]
    return F.transform(kept, lambda c, i: F.struct(i.alias("no"), c["start_pos"].alias("start_pos"), c["piece"].alias("piece")))


def word_windows(text: Column, size: int = 256, overlap: int = 50) -> Column:
    """Windows of ``size`` words that overlap; the last ends with the text."""
    step = size - overlap

    def windows(w: Column) -> Column:
        n = F.size(w)
        count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
        every = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("no"), (i * step).alias("start_word"), F.array_join(F.slice(w, i * step + 1, F.lit(size)), " ").alias("piece")))
        return F.when(n > 0, every).otherwise(F.array().cast("array<struct<no:int,start_word:int,piece:string>>"))

    return F.transform(F.array(words_kept(text)), windows)[0]


def words_kept(text: Column) -> Column:
    """White-space tokens in their own case."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITE_CLASS}]+"), lambda w: w != "")


_HOLD = re.compile(rf"\b({ABBREVIATIONS})\.\s")
_END = re.compile(r"([.!?]+[\s\n]+|\n{2,})")


def sentences(text: str) -> list[str]:
    """Sentences with their end marks; abbreviations don't end one."""
    held = _HOLD.sub(lambda m: f"{m[1]}\x00 ", text)
    parts = _END.split(held)
    joined = [parts[i] + (parts[i + 1] if i + 1 < len(parts) else "") for i in range(0, len(parts), 2)]
    return [s for s in (j.replace("\x00", ".").strip() for j in joined) if s]


def sentence_chunks(text: str, most: int = 2000, overlap: int = 50, least: int = 100) -> list[tuple[int, str]]:
    """Sentences packed up to ``most`` characters; the trailing sentences of at most ``overlap`` characters are repeated."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    size = 0
    for s in sentences(text.strip()):
        if held and size + len(s) > most:
            out.append((len(out), " ".join(held)))
            back: list[str] = []
            room = 0
            for t in reversed(held):
                if room + len(t) > overlap:
                    break
                back.insert(0, t)
                room += len(t)
            held, size = back, room
        held.append(s)
        size += len(s)
    if held and len(" ".join(held)) >= least:
        out.append((len(out), " ".join(held)))
    return out


_CHUNK = T.ArrayType(T.StructType([T.StructField("no", T.IntegerType()), T.StructField("piece", T.StringType())]))


@F.pandas_udf(_CHUNK)
def split_sentences(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        yield text.map(lambda t: [] if t is None else [{"no": i, "piece": s} for i, s in enumerate(sentences(t))])


def sentence_chunker(most: int = 2000, overlap: int = 50, least: int = 100):
    @F.pandas_udf(_CHUNK)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield text.map(lambda t: [] if t is None else [{"no": i, "piece": s} for i, s in sentence_chunks(t, most, overlap, least)])

    return run


def paragraph_chunks(text: str, size: int = 512, most: int = 2000, least: int = 100) -> list[tuple[int, str]]:
    """Paragraphs packed up to ``size``; one over ``most`` is cut by sentences; a last piece under ``least`` is dropped."""
    out: list[str] = []
    held: list[str] = []
    for p in (q.strip() for q in re.split(r"\n\n+", text.strip())):
        if not p:
            continue
        if len(p) > most:
            if held:
                out.append("\n\n".join(held))
                held = []
            out.extend(s for _, s in sentence_chunks(p, most))
            continue
        if held and sum(map(len, held)) + len(p) > size:
            out.append("\n\n".join(held))
            held = []
        held.append(p)
    if held and len("\n\n".join(held)) >= least:
        out.append("\n\n".join(held))
    return list(enumerate(out))


# hashes


def normal_content(text: Column) -> Column:
    """One line of lower-case text without footers and outer blanks."""
    t = F.lower(flat(text))
    for p in FOOTERS:
        t = F.regexp_replace(t, p, "")
    return strip(t)


def content_sha(text: Column) -> Column:
    return F.sha2(normal_content(text), 256)


def shingles(text: Column, n: int = 3) -> Column:
    """Word n-grams of the normalised text, repeats kept; none for fewer than n words."""
    def grams(w: Column) -> Column:
        all_of_them = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, all_of_them).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words(normal_content(text))), grams)[0]  # the words are computed once


def simhash(grams: list[str]) -> str:
    """64-bit fingerprint in hex: a bit is set if more grams have it than not; a gram's bits are those of its md5 without leading zeros."""
    if not grams:
        return "0" * 16
    numbers = [int.from_bytes(md5(g.encode()).digest()) for g in grams]
    tops = np.array([h >> h.bit_length() - 64 if h.bit_length() >= 64 else h << 64 - h.bit_length() for h in numbers], ">u8")
    ones = np.unpackbits(tops.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(grams)).tobytes().hex()


def minhash(grams: list[str], n: int = 128) -> str:
    """Digest of the n least md5 numbers, one for each seed; zeros without grams."""
    if not grams:
        return "0" * 32
    return sha256(str([min(int(md5(f"{i}:{g}".encode()).hexdigest(), 16) for g in grams) for i in range(n)]).encode()).hexdigest()


def _grams(text: str | None, n: int = 3) -> list[str]:
    w = (text or "").split()
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


@F.pandas_udf(T.StringType())
def _simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        yield text.map(lambda t: simhash(_grams(t)))


@F.pandas_udf(T.StringType())
def _minhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        yield text.map(lambda t: minhash(sorted(set(_grams(t)))))


def simhash_of(text: Column) -> Column:
    """SimHash of the word 3-grams of the normalised text; all zeros for fewer than three words and for null."""
    return _simhash(F.coalesce(normal_content(text), F.lit("")))


def minhash_of(text: Column) -> Column:
    """MinHash digest of the word 3-grams of the normalised text."""
    return _minhash(F.coalesce(normal_content(text), F.lit("")))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 16-digit hex fingerprints."""
    number = lambda x: F.conv(x, 16, -10).cast("long")
    return F.bit_count(number(a).bitwiseXOR(number(b)))


def simhash_links(prints: DataFrame, key: str, mark: str, most: int = 3) -> DataFrame:
    """(a, b, distance): pairs of different fingerprints at most ``most`` bits apart, by the smallest key of each fingerprint.

    Equal fingerprints are one class, so copies never form pairs. Two fingerprints within ``most`` bits agree in one of most + 1
    bands; bands are joined on equality.
    """
    reps = prints.groupBy(mark).agg(F.min(key).alias("id"))
    width = 16 // (most + 1) if 16 % (most + 1) == 0 else 4
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.substring(mark, 1 + i * width, width).alias("part")) for i in range(16 // width)))
    rows = reps.select("id", F.col(mark).alias("m"), F.inline(bands))
    other = rows.select(F.col("id").alias("b"), F.col("m").alias("mb"), "band", "part")
    pairs = rows.join(other, ["band", "part"]).filter(F.col("id") < F.col("b")).withColumn("distance", hamming(F.col("m"), F.col("mb")))
    return pairs.filter(F.col("distance") <= most).select(F.col("id").alias("a"), "b", "distance").distinct()


def simple_url(url: Column) -> Column:
    """A url without protocol, www, final slash and campaign parameters, in lower case; in that fixed order."""
    t = F.regexp_replace(F.regexp_replace(url, r"^https?://", ""), r"^www\.", "")
    t = F.regexp_replace(t, r"/+$", "")
    return F.lower(F.regexp_replace(t, r"[?&](utm_|ref=|source=)[^&]*", ""))
