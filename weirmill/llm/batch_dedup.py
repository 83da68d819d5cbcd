"""Deduplication of new batches against all history, by hashes in bucketed tables.

Each text becomes its normalised main body: an exact hash of its words, and its rarest words, just over a tenth of them, so that
no two texts that are nearly the same can do without one in common. A batch's hashes and rare words are appended to tables bucketed
by them, and rows of one key meet there, in their bucket: equal pages and exact hashes are full copies; any two texts that share a
rare word, and whose lengths and word parities allow near equality, are checked word by word. Texts of the history are never read
again, only the word numbers of the few rows a rare word leads to, by a semi-join in buckets of row numbers.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weirmill.llm.hashing import BITS
from weirmill.operators.components import linked_classes
from weirmill.operators.skew import spread_join
from weirmill.session import scratch_path, stored

#: Rows of a bucket of a fresh history, as long as the session's shuffle partitions are enough.
BUCKET_ROWS = 20_000
#: Share of the longer text's words that must agree in order.
NEAR = 0.9
#: Rows of one rare word's join that are held at once; a longer group is worked off in parts.
CHUNK = 200_000
#: Texts of a rare word from which its pairs are made in several tasks, SLICE texts against SLICE.
HOT, SLICE = 50_000, 25_000
#: Entries a row is compared to from which it is compared to all of a stretch at once, ROWS rows and STRETCH entries at a time.
WIDE, ROWS, STRETCH = 96, 16, 8192
#: Words are told apart by 16 bits, and repeats of a word in a text by their number, up to 15.
TOKENS = 1 << 20


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def nearly_same(a: bytes, b: bytes) -> bool:
    """Whether NEAR of the longer text's words agree in order. Words are told apart by 16 bits; chance equals of two words, one
    in 65,536, can only add to agreement."""
    x, y = np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)
    longer, shorter = max(len(x), len(y)), min(len(x), len(y))
    if shorter < NEAR * longer:
        return False
    # words in common, in any order and in classes, are as many at least; so are pairs of words that stay side by side
    lost = len(x) + len(y) - 2 * NEAR * longer
    if _in_common(x, y) < NEAR * longer - 1e-9 or shorter > 1 and _in_common(x[1:] * _TWO + x[:-1], y[1:] * _TWO + y[:-1]) < NEAR * longer - 1 - lost - 1e-9:
        return False
    # words at both ends that agree are part of some longest common subsequence
    same = x[:shorter] == y[:shorter]
    head = shorter if same.all() else int(same.argmin())
    rest = shorter - head
    same = x[len(x) - rest :][::-1] == y[len(y) - rest :][::-1]
    tail = rest if same.all() else int(same.argmin())
    middle = common_words(x[head : len(x) - tail], y[head : len(y) - tail])
    return head + tail + middle >= NEAR * longer - 1e-9


_TWO = np.uint16(40_503)


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Entries two rows of numbers have in common, whatever their order; by 1,024 classes, so never too few."""
    return int(np.minimum(np.bincount(x & 1023, minlength=1024), np.bincount(y & 1023, minlength=1024)).sum())


@F.pandas_udf(T.BooleanType())
def _same(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([nearly_same(x, y) for x, y in zip(a, b)], dtype=bool)


def prints(scan: DataFrame, faulty: DataFrame) -> DataFrame:
    """(row_no, batch_no, page, exact, n_words, bits, words) of each row of ``scan`` (scan.scanned(items, prints=True)).

    page: the page its url leads to; exact is null without text: null and blank contents, contents in ``faulty`` (row_no) and
    contents without main body are no text. A content_hash is not needed: any two texts nearly the same meet by their words.
    """
    marks = scan.join(faulty.select("row_no", F.lit(True).alias("no_text")).distinct(), "row_no", "left")
    return marks.select("row_no", "batch_no", "page", F.when(F.col("no_text").isNull(), F.col("exact")).alias("exact"), "n_words", "bits", "words")


def _tokens(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text each token is of, in order, and the token: word + 65,536 * how many of the word are before it in the text (15 at most)."""
    raw = [w or b"" for w in words.to_pylist()]
    own = np.repeat(np.arange(len(raw), dtype=np.int64), [len(w) // 2 for w in raw])
    both = np.sort(own << 16 | np.frombuffer(b"".join(raw), np.uint16))
    starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
    before = np.arange(len(both)) - np.repeat(starts, np.diff(np.append(starts, len(both))))
    return both >> 16, both & 0xFFFF | np.minimum(before, 15) << 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): how often each token occurs."""
    total = np.zeros(TOKENS, np.int64)
    for batch in batches:
        total += np.bincount(_tokens(batch["words"])[1], minlength=TOKENS)
    key = np.flatnonzero(total)
    yield pa.record_batch({"key": pa.array(key, pa.int32()), "n": pa.array(total[key])})


def rarest(words: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, at): each text's rarest tokens, by their ``place`` in one order for all texts; ``at``: how many are rarer.

    If NEAR of the longer text's n words agree in order, ceil(NEAR * n) tokens are common to both texts; so the first common one has
    at most n - ceil(NEAR * n) others before it in either text, and not more than a text's n - at tokens are common from it on.
    """
    own, token = _tokens(words)
    both = np.sort(own << 20 | place[token])
    n = np.bincount(own, minlength=len(words))
    at = np.arange(len(both)) - np.repeat(np.cumsum(n) - n, n)
    kept = at <= np.repeat(n - np.ceil(NEAR * n - 1e-9).astype(np.int64), n)
    return both[kept] >> 20, both[kept] & (TOKENS - 1), at[kept]


def close_pairs(key: np.ndarray, n: np.ndarray, bits: pa.Array, old: int = 0, fresh: np.ndarray | None = None, at_token: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of rows with one key that may be nearly the same; the rows are ordered by key and n.

    Left out are only pairs that cannot be: if NEAR of the n_j >= n_i words agree in order, at most
    n_i + n_j - 2 * ceil(NEAR * n_j) words are added or taken away, and no more parity bits differ. Pairs of the first ``old``
    rows are left out, and pairs neither of which is ``fresh``, and pairs with a rarer token in common than the key's, which have
    ``at_token`` others before it (see rarest), if they cannot be by it.
    """
    begins = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64) // 8  # all are whole words
    held = np.frombuffer(bits.buffers()[2], np.uint8) if len(bits) else np.empty(0, np.uint8)
    held = held[: len(held) // 8 * 8].view(np.uint64)
    level = np.log2(np.maximum(np.diff(begins) * 64 // BITS, 1)).round().astype(np.int64)
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    span = int(n.max()) + 2 if len(n) else 1
    at_n = group * span + n
    upto = np.searchsorted(at_n, group * span + np.minimum(np.floor((n - at_token) / NEAR + 1e-9).astype(np.int64), span - 1), "right")  # rows long enough at most
    less = (n - 2 * np.ceil(NEAR * n - 1e-9)).astype(np.int32)
    fresh = np.ones(len(key), bool) if fresh is None else fresh
    new = np.flatnonzero(fresh)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for at in np.unique(level):
        width = (BITS << at) // 64
        mine = np.flatnonzero((level == at) | (level == at + 1))
        table = np.zeros((width, len(key)), np.uint64)
        same = level[mine] == at
        for k in range(width):
            table[k][mine[same]] = held[begins[mine[same]] + k]
        if not same.all():  # longer texts: the same class of a word modulo half as many, so both halves are one
            for k in range(width):
                table[k][mine[~same]] = held[begins[mine[~same]] + k] ^ held[begins[mine[~same]] + width + k]
        own = np.flatnonzero(level == at)
        for i, to in ((own[fresh[own]], None), (own[~fresh[own]], new)):  # fresh ones with all, the others with fresh ones
            low = np.maximum(i + 1, old)
            high = np.maximum(upto[i], low)
            if to is not None:
                low, high = np.searchsorted(to, low), np.searchsorted(to, high)
            wide = high - low >= WIDE
            if wide.any():
                beside, room_of = (table, less) if to is None else (table[:, to], less[to])
                for first, j in _stretches(table, beside, n, room_of, i[wide], low[wide], high[wide]):
                    found.append((first, j if to is None else to[j]))
            for first, j in _ranges(i[~wide], low[~wide], high[~wide]):
                j = j if to is None else to[j]
                room = n[first] + less[j]
                apart = np.bitwise_count(table[0][first] ^ table[0][j]).astype(np.int64)
                for k in range(1, width):
                    ok = apart <= room
                    first, j, room, apart = first[ok], j[ok], room[ok], apart[ok]
                    apart = apart + np.bitwise_count(table[k][first] ^ table[k][j])
                ok = apart <= room
                found.append((first[ok], j[ok]))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def _ranges(i: np.ndarray, low: np.ndarray, high: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each entry of i with each number of its range, at most so many pairs at once (or one entry's)."""
    size = high - low
    ends = np.cumsum(size)
    begin = 0
    while begin < len(i):
        done = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        part = size[begin:stop]
        if part.any():
            shift = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            yield np.repeat(i[begin:stop], part), np.repeat(low[begin:stop], part) + shift
        begin = stop


def _stretches(table: np.ndarray, beside: np.ndarray, n: np.ndarray, less: np.ndarray, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each entry of i with those numbers of its range whose bits in ``beside`` differ in n_i + less_j at most."""
    for begin in range(0, len(i), ROWS):
        rows, a, b = (x[begin : begin + ROWS, None] for x in (i, low, high))
        own = table[:, rows[:, 0], None]
        for start in range(int(a.min()), int(b.max()), STRETCH):
            stop = min(start + STRETCH, int(b.max()))
            apart = np.bitwise_count(own[0] ^ beside[0, start:stop]).astype(np.uint8 if len(beside) < 4 else np.uint16)
            for k in range(1, len(beside)):
                apart += np.bitwise_count(own[k] ^ beside[k, start:stop])
            first, j = np.nonzero(apart <= n[rows] + less[start:stop])
            j += start
            ok = (j >= a[first, 0]) & (j < b[first, 0])
            yield rows[first[ok], 0], j[ok]


_PAIR = "a long, b long, batch_a int, batch_b int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one key, a < b; of a group that goes on, the rows that later, longer ones may be near to are carried over.

    ``side``: 0 where a group's rows are all paired, else 1 and 2, and only rows of two sides are.
    """
    held: list[pa.RecordBatch] = []
    old = 0

    def work() -> pa.RecordBatch:
        nonlocal held, old
        rows = pa.Table.from_batches(held)
        key, n, row_no, batch_no, fresh, side = (rows[c].to_numpy() for c in ("group", "n", "row_no", "batch_no", "fresh", "side"))
        at_token = rows["at"].to_numpy() if "at" in rows.column_names else 0
        i, j = close_pairs(key, n, pa.concat_arrays(rows["bits"].chunks), old, fresh, at_token)
        across = (side[i] == 0) | (side[i] != side[j])
        i, j = i[across], j[across]
        swap = row_no[i] > row_no[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        order = np.lexsort((row_no[j], row_no[i]))
        i, j = i[order], j[order]
        once = np.ones(len(i), bool)
        once[1:] = (row_no[i[1:]] != row_no[i[:-1]]) | (row_no[j[1:]] != row_no[j[:-1]])
        i, j = i[once], j[once]
        rest = np.flatnonzero((key == key[-1]) & (n >= NEAR * n[-1] - 1e-9))
        held, old = rows.slice(rest[0]).to_batches(), len(rest)
        return pa.record_batch({"a": pa.array(row_no[i]), "b": pa.array(row_no[j]), "batch_a": pa.array(batch_no[i], pa.int32()), "batch_b": pa.array(batch_no[j], pa.int32())})

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(h.num_rows for h in held) - old >= CHUNK:
                yield work()
    if sum(h.num_rows for h in held) > old:
        yield work()


def candidate_pairs(units: DataFrame) -> DataFrame:
    """(a, b, batch_a, batch_b): all pairs of rows of one key that may be nearly the same, at least one of them fresh.

    ``units``: (key, n_key, at, row_no, n, bits, batch_no, fresh), n_key the rows of the key, at as in rarest. A key of more than HOT rows is cut by
    length, into doublings that overlap by what NEAR allows, and each of these into slices that meet two by two in tasks of
    their own; every pair still meets.
    """
    few = units.filter(F.col("n_key") <= HOT).select(F.xxhash64("key").alias("group"), F.lit(0).alias("side"), "at", "row_no", "n", "bits", "batch_no", "fresh")
    low = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    bands = F.when(F.col("n") >= NEAR * F.pow(F.lit(2.0), low + 1) - 1, F.array(low, low + 1)).otherwise(F.array(low))
    slices = F.ceil(F.col("n_key") / SLICE).cast("int")
    own = F.pmod(F.xxhash64("row_no"), slices).cast("int")
    hot = units.filter(F.col("n_key") > HOT).withColumns({"slices": slices, "own": own}).withColumn("band", F.explode(bands))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    group = F.xxhash64("key", "band", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    many = hot.select(group.alias("group"), side.alias("side"), "at", "row_no", "n", "bits", "batch_no", "fresh")
    met = few.unionByName(many).repartition("group").sortWithinPartitions("group", "n")
    return met.mapInArrow(_pairs, _PAIR).distinct()


class History:
    """Tables of all rows seen so far, in a folder all executors share, bucketed by what they are joined on.

    ``groups`` (by key): for each load and page or exact hash its first row, first batch and number of rows, so that a page with a
    third of all rows is one line. ``rare`` (by key): the rarest tokens of each text's first row. ``counts``: how often tokens occur
    in the first load's texts; later loads keep this order of rarity. ``texts`` (by row_no): the word numbers of these rows. ``firsts`` (by row_no): the first row of rows that were found to have one; a load that
    joins two classes adds a line for the later first row, which is followed when labels are read.

    A load counts once its mark is written, as the last step: what a failed load left behind is never read, and it can be run
    again. A reopened history goes on where it ended. ``buckets`` is fixed by the first load (the session's shuffle partitions).
    """

    _TABLES = {
        "groups": ("key binary, first_no long, first_batch int, n long, load string", "key"),
        "rare": ("key int, row_no long, at int, load string", "key"),
        "counts": ("key int, n long, load string", "key"),
        "texts": ("row_no long, batch_no int, n int, bits binary, words binary, load string", "row_no"),
        "firsts": ("row_no long, label long, load string", "row_no"),
    }

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/loads")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        marks = [f.getPath().getName() for f in self._fs.listStatus(path)]
        self.loads = [m.split("-")[1] for m in marks]
        known = {int(m.split("-")[0]) for m in marks}
        self.buckets = known.pop() if known else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._prefix = "weirmill_" + hashlib.md5(self.folder.encode()).hexdigest()[:16]

    def _table(self, name: str) -> DataFrame:
        columns, by = self._TABLES[name]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._prefix}_{name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}-{self.buckets}'"
        )
        return self.spark.table(f"{self._prefix}_{name}")

    def _append(self, name: str, rows: DataFrame, load: str) -> None:
        by = self._TABLES[name][1]
        rows = rows.withColumn("load", F.lit(load)).select(self._table(name).columns)
        rows.write.format("parquet").bucketBy(self.buckets, by).sortBy(by).mode("append").saveAsTable(f"{self._prefix}_{name}")
        self.spark.catalog.refreshTable(f"{self._prefix}_{name}")

    def _read(self, name: str, load: str) -> DataFrame:
        """The table's rows of finished loads and this one; fresh tells them apart."""
        rows = self._table(name)
        return rows.filter(F.col("load").isin([*self.loads, load])).withColumn("fresh", F.col("load") == load)

    def check_and_append(self, marks: DataFrame) -> DataFrame:
        """(first_no, row_no) of the rows of ``marks`` that repeat a row of an earlier batch, and the first row of all that repeat it;
        then their hashes are appended.

        ``marks`` (see prints) holds one batch or several; rows of one batch are no repeats of each other by themselves. Rows repeat
        each other if they have one page or nearly the same text; the first row is the smallest reached over such links, known with
        this load: what a later load joins does not change it. Rows whose row_no was loaded before must not come again.
        """
        load = uuid.uuid4().hex
        b = self.buckets
        kinds = F.array_compact(F.array(F.when(F.col("page").isNotNull(), F.concat(F.lit(b"u"), "page")), F.when(F.col("exact").isNotNull(), F.concat(F.lit(b"t"), "exact"))))
        keyed = marks.select("row_no", "batch_no", F.explode(kinds).alias("key"))
        own = keyed.groupBy("key").agg(F.min("row_no").alias("first_no"), F.min("batch_no").alias("first_batch"), F.count(F.lit(1)).alias("n"))
        self._append("groups", own, load)
        # rows of one key lie in one bucket: no shuffle
        groups = self._read("groups", load).groupBy("key").agg(
            F.min("first_no").alias("first_no"), F.min("first_batch").alias("first_batch"), F.sum("n").alias("n"), F.max("fresh").alias("hit"),
            F.min(F.when(~F.col("fresh"), F.col("first_no"))).alias("old_no"),
        )
        groups = stored(groups.filter("hit").drop("hit"), "groups")
        near = self._near(marks, groups, load)
        linked = near.select(F.inline(F.array(F.struct(F.col("a").alias("first_no"), F.col("batch_b").alias("batch")), F.struct(F.col("b").alias("first_no"), F.col("batch_a").alias("batch")))))
        linked = linked.groupBy("first_no").agg(F.min("batch").alias("near_batch"))
        is_text = F.substring("key", 1, 1) == F.lit(b"t")
        texts = groups.filter(is_text).join(linked, "first_no", "left").withColumn("first_batch", F.least("first_batch", "near_batch"))
        shared = stored(
            texts.filter("n > 1 or near_batch is not null").select("key", "first_no", "first_batch", "n").unionByName(groups.filter(~is_text & (F.col("n") > 1)).select("key", "first_no", "first_batch", "n")), "shared"
        )
        met = spread_join(keyed, shared, ["key"]).filter("first_no is not null")
        ends = met.groupBy("row_no").agg(
            F.min("first_no").alias("low"), F.max("first_no").alias("high"), (F.min("first_batch") < F.min("batch_no")).alias("late")
        )
        ends = stored(ends, "ends")
        links = (
            ends.select(F.col("low").alias("src"), F.col("high").alias("dst"))
            .unionByName(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
            .unionByName(groups.filter("old_no <> first_no").select(F.col("old_no").alias("src"), F.col("first_no").alias("dst")))
        )
        if self.loads:
            links = stored(links.filter("src <> dst").distinct(), "links")
            links = links.unionByName(self._known(links.select(F.explode(F.array("src", "dst")).alias("row_no")).unionByName(ends.select(F.explode(F.array("low", "high")).alias("row_no"))).distinct(), load))
        classes = linked_classes(links)
        found = ends.join(classes.withColumnRenamed("node", "low"), "low", "left").select(F.coalesce("label", "low").alias("first_no"), "row_no", "late")
        found = stored(found.filter("first_no < row_no"), "found")
        firsts = classes.filter("label < node").select(F.col("node").alias("row_no"), "label").unionByName(found.select("row_no", F.col("first_no").alias("label")))
        self._append("firsts", firsts.distinct(), load)
        self._fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/loads/{b}-{load}")).close()
        self.loads.append(load)
        return found.filter("late").select("first_no", "row_no")

    def _near(self, marks: DataFrame, groups: DataFrame, load: str) -> DataFrame:
        """(a, b, batch_a, batch_b): first rows of texts that are nearly the same, at least one of them new.

        A text that the history has stands for itself once, by its first row there. Of the rare tokens, read in their buckets, only
        those that a new text shares with another are joined to lengths and parities, in buckets of rows.
        """
        first = groups.filter((F.substring("key", 1, 1) == F.lit(b"t")) & F.col("old_no").isNull()).select(F.col("first_no").alias("row_no"), F.col("first_batch").alias("text_batch"))
        reps = marks.join(first, "row_no")
        self._append("texts", reps.select("row_no", F.col("text_batch").alias("batch_no"), F.col("n_words").alias("n"), "bits", "words"), load)
        new = self._table("texts").filter(F.col("load") == load)
        self._append("rare", self._rare(new, load), load)
        same = Window.partitionBy("key")
        shared = self._read("rare", load).withColumns({"n_key": F.count(F.lit(1)).over(same), "hit": F.max("fresh").over(same)}).filter("n_key > 1 and hit")
        texts = self._read("texts", load)
        units = shared.select("key", "n_key", "at", "row_no").join(texts.select("row_no", "n", "bits", "batch_no", "fresh"), "row_no")
        pairs = stored(candidate_pairs(units), "pairs")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("row_no")).groupBy("row_no").agg(F.count(F.lit(1)).alias("n"))
        words = stored(texts.drop("n").join(wanted, "row_no").select("row_no", "words", "n"), "words")
        both = spread_join(pairs, words.select(F.col("row_no").alias("a"), F.col("words").alias("x"), "n"), ["a"])
        both = spread_join(both, words.select(F.col("row_no").alias("b"), F.col("words").alias("y"), "n"), ["b"])
        return stored(both.filter(_same("x", "y")).select("a", "b", "batch_a", "batch_b"), "near")

    def _rare(self, texts: DataFrame, load: str) -> DataFrame:
        """(key, row_no, at): the rarest tokens of each text. The first load counts them; what reaches the driver is a line a token,
        TOKENS at most."""
        if not self.loads:
            self._append("counts", texts.select("words").mapInArrow(_counted, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")), load)
        counts = self._read("counts", load).select("key", "n").toArrow()
        n = np.zeros(TOKENS, np.int64)
        n[counts["key"].to_numpy()] = counts["n"].to_numpy()
        place = np.empty(TOKENS, np.int64)
        place[np.argsort(n, kind="stable")] = np.arange(TOKENS)
        places = self.spark.sparkContext.broadcast(place.astype(np.int32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, key, at = rarest(batch["words"], places.value)
                yield pa.record_batch({"key": pa.array(key, pa.int32()), "row_no": batch["row_no"].take(pa.array(text)), "at": pa.array(at, pa.int32())})

        return texts.select("row_no", "words").mapInArrow(run, "key int, row_no long, at int")

    def _known(self, front: DataFrame, load: str) -> DataFrame:
        """(src, dst): what is kept of the rows, of their first rows, and so on; each step leads to smaller rows, so it ends."""
        firsts = self._table("firsts").filter(F.col("load").isin(self.loads)).select("row_no", "label")
        out, seen = None, front
        while True:
            step = stored(firsts.join(front, "row_no", "left_semi").distinct(), "known")
            rows = step.select(F.col("row_no").alias("src"), F.col("label").alias("dst"))
            out = rows if out is None else out.unionByName(rows)
            front = stored(step.select(F.col("label").alias("row_no")).distinct().join(seen, "row_no", "left_anti"), "front")
            if front.isEmpty():
                return out
            seen = seen.unionByName(front)

    def close(self) -> None:
        """Takes the tables out of the session's catalog; the folder stays."""
        for name in self._TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._prefix}_{name}")


def batch_repeats(marks: DataFrame) -> DataFrame:
    """(first_no, row_no) of all batches: the earlier ones are loaded into a fresh history, then the newest is checked against it.

    Null urls, contents and hashes link nothing; repeated rows of one batch are no case by themselves. Extra columns are ignored.
    """
    spark = marks.sparkSession
    least, newest, n = marks.agg(F.min("batch_no"), F.max("batch_no"), F.count(F.lit(1))).first()
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    history = History(spark, scratch_path(spark, "history"), max(8, min(most, n // BUCKET_ROWS)))
    parts = [marks] if least == newest else [marks.filter(F.col("batch_no") < newest), marks.filter(F.col("batch_no") == newest)]
    found = [history.check_and_append(p) for p in parts]
    history.close()
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def new_items(items: DataFrame, marks: DataFrame) -> DataFrame:
    """The items that bring a new page and a new text: those that repeat no row of an earlier batch."""
    return items.join(batch_repeats(marks).select("row_no"), "row_no", "left_anti")
