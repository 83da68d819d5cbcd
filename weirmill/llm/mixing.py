"""Mixing sources to target weights, with a cap on repetition.

Weights come from temperature mixing: shares raised to an exponent and normalised, the exponent found by bisection. They are made
real as budgeted block permutations: a source's documents are spread over blocks by a hash, an epoch is a permutation of the
blocks, and whole blocks are taken until the source's budget ends inside one, of which only its first documents are taken.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmill.session import stored

#: Blocks of a source; a budget ends in one of them, so that only its documents are put in order.
BLOCKS = 4096
#: More sources than this are not a mix but data; the plan of sources is made by the driver.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Source:
    name: str
    tokens: int
    target: float | None
    max_repeats: int


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to ``exponent`` and normalised; zero shares stay zero."""
    top = max((s for s in shares.values() if s > 0), default=1.0)
    raised = {k: (s / top) ** exponent if s > 0 else 0.0 for k, s in shares.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(s * math.log(s) for s in shares.values() if s > 0)


def bisect(low: float, high: float, holds, steps: int = 80) -> float:
    """The greatest value in [low, high] for which ``holds``, which holds up to some value; low if nowhere."""
    if holds(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def exponent_for_entropy(shares: dict[str, float], wanted: float) -> float:
    """The exponent at which the tempered shares have the wanted entropy: 1 leaves them, 0 makes them equal."""
    return bisect(0.0, 64.0, lambda e: entropy(tempered(shares, e)) >= wanted)


def weights(sources: list[Source], total: int | None = None, wanted_entropy: float | None = None) -> tuple[dict[str, float], int, float]:
    """(weight of each source, total budget in tokens, exponent).

    Sources with documents and a positive target take part; targets are normalised over them. Without ``total`` the budget is the
    largest at which every source meets its target within its repeats, and the exponent is 1. With a larger ``total`` the ratio
    of target to own size, which is how often a source is repeated, is raised to the greatest exponent that keeps every source
    within its repeats; exponent 0 draws by size. If not even that fits, the budget is what all repeats give. Without targets
    the sources' own token shares are tempered: to ``wanted_entropy``, if given, else not at all.
    """
    able = [s for s in sources if s.tokens > 0 and s.max_repeats > 0 and (s.target or 0) > 0]
    if not able:
        able = [s for s in sources if s.tokens > 0 and s.max_repeats > 0] if all(s.target is None for s in sources) else []
        if not able:
            return {}, 0, 1.0
        own = {s.name: s.tokens / sum(t.tokens for t in able) for s in able}
        goal, exponent = (own, 1.0) if wanted_entropy is None else (tempered(own, e := exponent_for_entropy(own, wanted_entropy)), e)
    else:
        sum_target = sum(s.target for s in able)
        goal, exponent = {s.name: s.target / sum_target for s in able}, 1.0
    room = {s.name: s.tokens * s.max_repeats for s in able}
    most = math.floor(min(room[k] / w for k, w in goal.items()))
    if total is None or total <= most:
        return goal, most if total is None else total, exponent
    size = sum(s.tokens for s in able)
    own = {s.name: s.tokens / size for s in able}

    def mixed(e: float) -> dict[str, float]:
        raw = {k: own[k] * (goal[k] / own[k]) ** e for k in goal}
        return {k: v / sum(raw.values()) for k, v in raw.items()}

    fits = lambda e: all(total * w <= room[k] * (1 + 1e-12) for k, w in mixed(e).items())
    if fits(0.0):
        e = bisect(0.0, 1.0, fits)
        return mixed(e), total, e
    full = sum(room.values())
    return {k: r / full for k, r in room.items()}, full, 0.0


def source_sizes(docs: DataFrame, targets: DataFrame, source: str, size: str) -> list[Source]:
    """Each source's tokens, target and cap: of those with documents and those with a target. Null sources are no source."""
    sizes = docs.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("name")).agg(F.sum(size).alias("tokens"))
    wanted = targets.filter(F.col("source").isNotNull()).groupBy(F.col("source").alias("name")).agg(
        F.max("target_share").alias("target"), F.max("max_repeats").alias("max_repeats"), F.lit(True).alias("named")
    )
    rows = sizes.join(wanted, "name", "full").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return sorted((Source(r.name, int(r.tokens or 0), None if r.target is None else float(r.target), int(r.max_repeats if r.max_repeats is not None else 1)) for r in rows), key=lambda s: s.name)


def sized_blocks(docs: DataFrame, doc: str, source: str, size: Column, seed: int) -> DataFrame:
    """(doc, source, tokens, block, place): the place in a block is a hash, ties by doc."""
    mark = F.xxhash64(F.lit(seed), F.col(doc))
    return docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), F.coalesce(size.cast("long"), F.lit(0)).alias("tokens")).filter(
        F.col("source").isNotNull() & (F.col("tokens") > 0)
    ).withColumns({"block": F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc")), F.lit(BLOCKS)).cast("int"), "place": F.xxhash64(F.lit(seed), F.col("doc"))})


def mix(docs: DataFrame, targets: DataFrame, doc: str, source: str, size: Column, total: int | None = None, seed: int = 17, wanted_entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(draws, report).

    draws: (doc, source, tokens, epoch), a row for each time a document is drawn, never more than max_repeats times. report:
    (source, own_tokens, target_share, weight, budget, drawn_tokens, n_draws, reached_share), a row for each source that has
    documents or a target; a source without documents reaches 0, one without a target is not drawn, unless no source has one:
    then the sources' own shares are tempered to ``wanted_entropy``. Every source ends within one
    document of its budget. Documents without source or tokens are not drawn. ``doc`` must be unique; the result is the same for
    the same input and seed.
    """
    spark = docs.sparkSession
    rows = stored(sized_blocks(docs, doc, source, size, seed), "sized")
    sources = source_sizes(rows, targets, "source", "tokens")
    share, budget_all, _ = weights(sources, total, wanted_entropy)
    budgets = [(s.name, s.tokens, s.target or 0.0, share.get(s.name, 0.0), int(budget_all * share.get(s.name, 0.0))) for s in sources]
    wanted = spark.createDataFrame(budgets, "source string, own_tokens long, target_share double, weight double, budget long")
    goal = F.broadcast(wanted.filter("budget > 0").select("source", "own_tokens", "budget"))  # at most MAX_SOURCES rows
    # epochs: 0 .. full - 1 take everything, epoch `full` takes blocks in its own order up to what is left
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    split = goal.select("source", (F.expr("budget div own_tokens")).cast("int").alias("full"), (F.expr("budget % own_tokens")).alias("rest"))
    shuffled = blocks.join(F.broadcast(split), "source").withColumn("turn", F.xxhash64(F.lit(seed + 2), "full", "block"))
    order = Window.partitionBy("source").orderBy("turn", "block")  # at most BLOCKS rows a source
    ends = shuffled.withColumn("upto", F.sum("block_tokens").over(order)).withColumn(
        "inside", F.greatest(F.lit(0), F.least("block_tokens", F.col("rest") - (F.col("upto") - F.col("block_tokens"))))
    ).select("source", "block", "full", "inside", "block_tokens")
    placed = rows.join(ends, ["source", "block"])
    whole = placed.filter("full > 0").select("doc", "source", "tokens", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"))
    last_whole = placed.filter("inside = block_tokens").select("doc", "source", "tokens", F.col("full").alias("epoch"))
    cut = placed.filter("inside > 0 and inside < block_tokens")
    in_block = Window.partitionBy("source", "block").orderBy("place", "doc")
    last_part = (
        cut.withColumn("before", F.sum("tokens").over(in_block) - F.col("tokens"))
        .filter(F.col("before") + F.expr("tokens div 2") < F.col("inside"))
        .select("doc", "source", "tokens", F.col("full").alias("epoch"))
    )
    draws = whole.unionByName(last_whole).unionByName(last_part)
    drawn = draws.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.count(F.lit(1)).alias("n_draws"))
    everything = Window.partitionBy()
    report = F.broadcast(wanted).join(drawn, "source", "left").na.fill(0, ["drawn_tokens", "n_draws"])
    report = report.withColumn("reached_share", F.round(F.col("drawn_tokens") / F.nullif(F.sum("drawn_tokens").over(everything), F.lit(0)), 6))
    return draws, report
