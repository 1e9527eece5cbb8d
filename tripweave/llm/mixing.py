"""Mixing sources to target weights with a proportionate-fair schedule.

Time is divided into slots of one block of documents. The i-th block of a source of weight w is released at slot
floor(i / w) and due by slot ceil((i + 1) / w); earliest deadline first then keeps every source within less than one block of
its target at every slot. Releases and deadlines come from the exact weights over the whole run, so no error adds up; the
schedule has a number per block, and rows find theirs by a join.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def slots_per_period(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers that sum to ``period``, near the weights by largest remainders, at least 1 each."""
    if any(w <= 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be positive")
    if len(weights) > period:
        raise ValueError("a period needs a slot for every source")
    total, free = sum(weights.values()), period - len(weights)
    exact = {s: max(0.0, period * w / total - 1) for s, w in weights.items()}
    scale = free / sum(exact.values()) if sum(exact.values()) else 0
    exact = {s: x * scale for s, x in exact.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def slots_of_blocks(weights: dict[str, float], blocks: dict[str, int]) -> dict[str, list[int]]:
    """The slot of every block of every source: earliest deadline first over released blocks, ties by name.

    Weights are relative and exact. The slots of a source that has run out stay empty, those without a block are skipped in one step.
    """
    if any(w <= 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    # One over the weight of a source, as numerator and denominator.
    gaps = {s: (total / w).as_integer_ratio() for s, w in exact.items()}
    out: dict[str, list[int]] = {s: [] for s in blocks}
    waiting = [(0, s, 0) for s in blocks if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            n, d = gaps[s]
            heapq.heappush(ready, (-(-(i + 1) * n // d), s))
            if i + 1 < blocks[s]:
                heapq.heappush(waiting, ((i + 1) * n // d, s, i + 1))
        due, s = heapq.heappop(ready)
        assert due > slot
        out[s].append(slot)
        slot += 1
    return out


def schedule(shares: dict[str, int]) -> list[str]:
    """The source of each slot when every source has as many blocks as its share."""
    order = [""] * sum(shares.values())
    for s, slots in slots_of_blocks(shares, shares).items():
        for slot in slots:
            order[slot] = s
    return order


def _key(source_col: str) -> Column:
    """Sources as text; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))


#: The columns that a mix adds.
MADE = ("weight", "block", "slot", "place")

#: Blocks of a schedule, about: 8 bytes each and some seconds to make. Tables of more rows get larger blocks, so that neither grows with them.
MOST_BLOCKS = 2_000_000


def _placed(docs: DataFrame, weights: dict[str | None, float] | None, alpha: float, block: int, period: int, bucket: int, source_col: str) -> DataFrame:
    """``_doc`` (a row of ``docs``) and where it is placed."""
    spark, whole = docs.sparkSession, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    counts = {r.k: r.n for r in docs.groupBy(_key(source_col).alias("k")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.select(whole, F.lit(0.0).alias("weight"), *(F.lit(0).cast("long").alias(c) for c in MADE[1:]))
    target = {"" if s is None else f"={s}": w for s, w in weights.items()} if weights else {s: n**alpha for s, n in counts.items()}
    if missing := set(counts) - set(target):
        raise ValueError(f"no weight for sources {sorted(missing)}")
    target = {s: w for s, w in target.items() if s in counts}
    total = sum(map(Fraction, target.values()))
    block = max(block, -(-sum(counts.values()) // MOST_BLOCKS))
    placed_at = slots_of_blocks(target, {s: -(-n // block) for s, n in counts.items()})
    rows = [(s, at // period, slots[at : at + period], float(Fraction(target[s]) / total)) for s, slots in placed_at.items() for at in range(0, len(slots), period)]
    plan = spark.createDataFrame(rows, "_source string, _part long, _slots array<long>, weight double")

    salts = max(1, -(-sum(counts.values()) // bucket))
    # By content, not by position: both uses below see the same salts whatever the input's partitions are.
    content = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)))
    numbered = docs.select(whole, _key(source_col).alias("_source"), content.alias("_id")).withColumn("_salt", F.pmod("_id", F.lit(salts)))
    inside = Window.partitionBy("_source", "_salt").orderBy(F.xxhash64("_id"), "_id")
    before = Window.partitionBy("_source").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("_source", "_salt").agg(F.count("*").alias("_n")).select("_source", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = (
        numbered.withColumn("_rank", F.row_number().over(inside))
        .join(sizes, ["_source", "_salt"])
        .withColumn("_index", F.col("_before") + F.col("_rank") - 1)
        .withColumn("block", F.floor(F.col("_index") / block))
        .withColumn("place", F.col("_index") % block)
    )
    parts = placed.withColumn("_part", F.floor(F.col("block") / period))
    timed = parts.join(F.broadcast(plan), ["_source", "_part"])
    slot = F.get("_slots", (F.col("block") % period).cast("int"))
    return timed.select("_doc", "weight", "block", slot.alias("slot"), "place")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, block: int = 32, period: int = 1000, bucket: int = 5_000, source_col: str = "source") -> DataFrame:
    """All rows with ``weight``, ``block`` (of its source), ``slot`` and ``place`` (in its block); (slot, place) is the mixed order.

    ``weights`` has the target of each source; without it, a source's target is its row count to the power ``alpha``. Sources
    without a weight raise. Every row appears once: a source that has run out leaves its slots empty, which keeps the others
    in proportion. Rows of a source come in a random order that follows from their content. Null sources are a source
    of their own; repeated rows are rows of their own; an empty table gives no rows. An input column with the name of a new one gives way to it.

    No row goes through Python. Rows are numbered within (source, salt) and shifted by the counts of earlier salts, so a source
    with a third of all rows is numbered by many tasks. The counts of the sources, one number each, come to the driver, which makes
    the schedule, a number per block; ``period`` blocks of a source are a row of it. A block has ``block`` rows, more only in tables of over ``MOST_BLOCKS`` times
    as many, so that the schedule has at most about ``MOST_BLOCKS`` blocks and one for each source.
    """
    placed = _placed(docs, weights, alpha, block, period, bucket, source_col)
    return placed.select(*(F.col(f"_doc.`{c}`") for c in docs.columns if c not in MADE), *MADE)


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = 0.7, block: int = 32, period: int = 1000, bucket: int = 5_000, source_col: str = "source") -> DataFrame:
    """``docs``, all rows and columns, in the mixed order over partitions and within them."""
    return _placed(docs, weights, alpha, block, period, bucket, source_col).orderBy("slot", "place").select("_doc.*")
