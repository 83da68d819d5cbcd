"""Filling containers of one capacity with items of varying size, whole wherever they fit.

The plan is made on the histogram of sizes alone, which has at most ``capacity`` entries however many items there are: sums of
one, two and three sizes are hashed by value, so a gap is closed exactly by looking up its complement among what is still
available; what no exact combination uses is placed by best fit. A third part or more that is used up is looked for among one
pair a sum, so a triple may be passed over; it is placed by best fit then. The plan is a list of runs (size, ranks from-to, containers
from-to), and items find their container by their rank within their size.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmill.functions.text import WHITE_CLASS
from weirmill.session import stored

#: Capacity in tokens. The plan's size is bounded by it; see MAX_CAPACITY.
CAPACITY = 2048
MAX_CAPACITY = 65_536
#: Items of one block, within which items of one size are numbered by a sort; there are as many blocks as the items need.
BLOCK_ITEMS = 100_000
#: Tokens of the public word-and-punctuation tokenizer: runs of word characters, runs of other visible characters.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WHITE_CLASS}]+"


def token_count(text: Column) -> Column:
    """Tokens of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("int")


class SumIndex:
    """Which sizes add up to a sum: tables by sum of single sizes, pairs and triples, each with one combination a sum.

    A table entry is checked against what is left when it is looked up, and sought anew, over all sizes left, once it fails. Tables
    are made again whenever half of the sizes are used up. Building takes sizes x capacity steps on arrays, a search one row of it.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for size, n in counts.items():
            self.left[size] = n
        self.build()

    def build(self) -> None:
        self.sizes = np.flatnonzero(self.left)
        self.pair = np.zeros(self.capacity + 1, np.int32)  # the larger of two sizes with this sum, or 0
        for a in self.sizes.tolist():
            other = self.sizes[: np.searchsorted(self.sizes, min(a, self.capacity - a), "right")]
            self.pair[a + other] = a
        sums = np.flatnonzero(self.pair)
        self.triple = np.zeros(self.capacity + 1, np.int32)  # one of three sizes with this sum, the pair table has the others
        for a in self.sizes.tolist():
            self.triple[a + sums[: np.searchsorted(sums, self.capacity - a, "right")]] = a

    def lasts(self, parts: tuple[int, ...]) -> int:
        return min(int(self.left[s]) // parts.count(s) for s in set(parts))

    def take(self, parts: tuple[int, ...], times: int) -> None:
        for s in parts:
            self.left[s] -= times
        if 2 * np.count_nonzero(self.left[self.sizes]) < len(self.sizes) and len(self.sizes) > 32:
            self.build()

    def two(self, gap: int, beside: int) -> tuple[int, int] | None:
        a = int(self.pair[gap])
        if a and self.lasts((beside, a, gap - a)):
            return a, gap - a
        if not a:
            return None
        own = self.sizes[np.searchsorted(self.sizes, (gap + 1) // 2) : np.searchsorted(self.sizes, gap)]
        own = own[(self.left[own] > 0) & (self.left[gap - own] > 0)]
        for a in own[::-1].tolist():  # only equal or large parts that are scarce can fail
            if self.lasts((beside, a, gap - a)):
                self.pair[gap] = a
                return a, gap - a
        return None

    def three(self, gap: int, beside: int) -> tuple[int, int, int] | None:
        a = int(self.triple[gap])
        if not a:
            return None
        b = int(self.pair[gap - a])
        if b and self.lasts((beside, a, b, gap - a - b)):
            return a, b, gap - a - b
        own = self.sizes[: np.searchsorted(self.sizes, gap)]
        b = self.pair[gap - own]
        c = gap - own - b
        for i in np.flatnonzero((self.left[own] > 0) & (b > 0) & (self.left[b] > 0) & (self.left[c] > 0))[::-1].tolist():
            parts = (int(own[i]), int(b[i]), int(c[i]))
            if self.lasts((beside, *parts)):
                self.triple[gap] = parts[0]
                return parts
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first rank, number of items, first container, items a container) that place every item.

    Containers are numbered from 0. For each size from the largest: the gap beside it is closed by one, two or three sizes whose
    sum is exactly the gap, looked up in the index; a combination is used as often as its sizes last, which uses one of them up, so
    there are no more combinations than sizes. Rests go by best fit to the container with the smallest room that takes them.
    """
    index = SumIndex(counts, capacity)
    left = index.left
    taken = dict.fromkeys(counts, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    containers = 0
    sizes = sorted(counts, reverse=True)

    for big in sizes:
        while left[big]:
            gap = capacity - big
            found: tuple[int, ...] | None = ()
            if gap:
                found = (gap,) if left[gap] and index.lasts((big, gap)) else index.two(gap, big) or index.three(gap, big)
            if found is None:
                break
            parts = (big, *found)
            times = index.lasts(parts)
            for size in set(parts):
                k = parts.count(size)
                runs.append((size, taken[size], k * times, containers, k))
                taken[size] += k * times
            index.take(parts, times)
            containers += times
    left = {size: int(left[size]) for size in counts}

    rooms: list[int] = []  # rooms that occur, ascending; boxes of each: [first container, number]
    boxes: dict[int, list[list[int]]] = {}

    def add(room: int, first: int, number: int) -> None:
        if room <= 0 or number <= 0:
            return
        if room not in boxes:
            rooms.insert(bisect_left(rooms, room), room)
            boxes[room] = []
        boxes[room].append([first, number])

    for size in sizes:
        while left[size]:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(left[size], each)
                if full:
                    runs.append((size, taken[size], full * each, containers, each))
                    add(capacity - each * size, containers, full)
                    containers += full
                    taken[size] += full * each
                if rest:
                    runs.append((size, taken[size], rest, containers, rest))
                    add(capacity - rest * size, containers, 1)
                    containers += 1
                    taken[size] += rest
                left[size] = 0
                break
            room = rooms[at]
            first, number = boxes[room].pop()
            if not boxes[room]:
                del boxes[room]
                rooms.pop(at)
            each = min(room // size, left[size])
            times = min(number, left[size] // each)
            runs.append((size, taken[size], each * times, first, each))
            add(room - each * size, first, times)
            add(room, first + times, number - times)
            taken[size] += each * times
            left[size] -= each * times
    return runs


def pack(items: DataFrame, item: str, size: Column, capacity: int = CAPACITY) -> DataFrame:
    """(item, part, start_unit, n_units, container): every item whole in one container, if it fits.

    Items of more than ``capacity`` units are cut into full containers and a rest that is placed like an item; part counts from 0
    and start_unit is where the part begins. Items of size 0 or null use no room and get no container (null). ``item`` must be
    unique. Equal sizes are told apart by a fixed order of hashes; the result is the same for the same input.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be 1 to {MAX_CAPACITY}")
    sized = items.select(F.col(item).alias("item"), F.coalesce(size.cast("long"), F.lit(0)).alias("units"))
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("units") / capacity)).cast("int")
    parts = sized.select(
        "item", "units", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part")
    ).select("item", "part", (F.col("part").cast("long") * capacity).alias("start_unit"), F.least(F.lit(capacity), F.col("units") - F.col("part") * F.lit(capacity).cast("long")).cast("int").alias("n_units"))
    # ranks within a size: rows of a block are numbered in the block, blocks of a size by a running sum of their counts
    parts = stored(parts, "parts")
    n_blocks = max(16, -(-parts.count() // BLOCK_ITEMS))
    blocked = parts.withColumn("block", F.pmod(F.xxhash64("item", "part"), F.lit(n_blocks)).cast("int"))
    filled = blocked.filter("n_units > 0")
    per_block = filled.groupBy("n_units", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.n_units: r.n for r in per_block.groupBy("n_units").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = plan(counts, capacity)
    spark = items.sparkSession
    shift = per_block.withColumn("before", F.sum("n").over(Window.partitionBy("n_units").orderBy("block")) - F.col("n"))
    numbered = filled.withColumn("in_block", F.row_number().over(Window.partitionBy("n_units", "block").orderBy(F.xxhash64("item", "part"), "item", "part")) - 1)
    ranked = numbered.join(shift.select("n_units", "block", "before"), ["n_units", "block"]).withColumn("rank", F.col("before") + F.col("in_block"))
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1)], "n_units int, first_rank long, n_run long, first_container long, each long")
    by_size = table.groupBy("n_units").agg(F.array_sort(F.collect_list(F.struct("first_rank", "n_run", "first_container", "each"))).alias("runs"))
    # bounded: a run list for each of at most `capacity` sizes, none longer than the plan made on those sizes
    placed = ranked.join(F.broadcast(by_size), "n_units")
    run = F.expr("filter(runs, r -> r.first_rank <= rank and rank < r.first_rank + r.n_run)[0]")
    placed = placed.withColumn("run", run).withColumn("container", F.expr("run.first_container + (rank - run.first_rank) div run.each"))
    columns = ["item", "part", "start_unit", "n_units", "container"]
    empty = blocked.filter("n_units <= 0").withColumn("container", F.lit(None).cast("long"))
    return placed.select(*columns).unionByName(empty.select(*columns))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, units placed, share of the room used, containers filled exactly, items split."""
    boxes = packed.filter("container is not null").groupBy("container").agg(F.sum("n_units").alias("used"), F.count_if(F.col("part") == 1).alias("seconds"))
    total = boxes.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_units"), F.count_if(F.col("used") == capacity).alias("n_exact"),
        F.max("used").alias("most_used"), F.coalesce(F.sum("seconds"), F.lit(0)).alias("n_split"),
    )
    return total.withColumn("used_share", F.round(F.col("n_units") / (F.col("n_containers") * F.lit(capacity)), 6))
