"""Most frequent items in bounded memory: lossy counting.

Each task keeps entries (count, undercount) and prunes them at bucket boundaries;
the summaries of the tasks are merged by adding counts and undercounts, an absent
item standing for the task's whole undercount. Every item then has a guaranteed
interval [low, high] that holds its true total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.runtime import checkpointed

SUMMARY = "item string, low long, under long"


class LossyCounter:
    """Weighted lossy counting with bucket width ``width``.

    ``bucket`` is the most that any item not held may have occurred so far.
    """

    def __init__(self, width: int):
        self.width = width
        self.entries: dict[str, list[int]] = {}
        self.weight = 0
        self.bucket = 0

    def add_all(self, pairs: Iterator[tuple[str, int]]) -> None:
        entries, bucket, w = self.entries, self.bucket, 0
        for item, n in pairs:
            w += n
            e = entries.get(item)
            if e is None:
                entries[item] = [n, bucket]
            else:
                e[0] += n
        self.weight += w
        if (now := self.weight // self.width) > bucket:
            self.bucket = now
            self.entries = {k: e for k, e in entries.items() if e[0] + e[1] > now}


def _summarise(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LossyCounter(width)
        for b in batches:
            t = pa.Table.from_batches([b]).group_by("item").aggregate([("weight", "sum")])
            counter.add_all(zip(t["item"].to_pylist(), t["weight_sum"].to_pylist(), strict=True))
        rows = [(None, counter.weight, counter.bucket), *((k, e[0], counter.bucket - e[1]) for k, e in counter.entries.items())]
        for i in range(0, len(rows), 20_000):
            item, low, under = zip(*rows[i : i + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(low, pa.int64()), pa.array(under, pa.int64())],
                names=["item", "low", "under"],
            )

    return run


def lossy_intervals(rows: DataFrame, epsilon: float) -> tuple[DataFrame, int]:
    """(item, low, high) of every item that may hold more than ``epsilon`` of the weight.

    ``rows`` has item (no nulls) and weight (long, not negative), spread over its
    partitions in any way. Also returned: the most that an item not listed may have.
    A task keeps at most about ``1 / epsilon * log(epsilon * its weight)`` entries.
    """
    parts = checkpointed(rows.select("item", "weight").mapInArrow(_summarise(math.ceil(1 / epsilon)), SUMMARY))
    missing = parts.where(F.col("item").isNull()).agg(F.coalesce(F.sum("under"), F.lit(0)).alias("u")).first().u
    merged = (
        parts.where(F.col("item").isNotNull())
        .groupBy("item")
        .agg(F.sum("low").alias("low"), F.sum("under").alias("known"))
        .select("item", "low", (F.col("low") + F.lit(missing) - F.col("known")).alias("high"))
    )
    return merged, missing


def top_candidates(rows: DataFrame, k: int, *, epsilon: float = 1e-5, least_epsilon: float = 1e-6) -> DataFrame | None:
    """Items that can be among the ``k`` heaviest, with guaranteed intervals; none is missed.

    If the interval bounds can't separate the k-th item from those not listed, counting is
    repeated with a tenth of ``epsilon``, not below ``least_epsilon``, which bounds a task's
    entries. None if that doesn't separate them either. Empty input gives no rows.
    """
    while True:
        items, missing = lossy_intervals(rows, epsilon)
        lows = items.orderBy(F.desc("low")).limit(k).agg(F.count("*").alias("n"), F.min("low").alias("least")).first()
        if missing == 0 or (lows.n == k and lows.least > missing):
            return items if lows.n < k else items.where(F.col("high") >= lows.least)
        if epsilon <= least_epsilon:
            return None
        epsilon = max(epsilon / 10, least_epsilon)


def heavy_items(
    df: DataFrame, *, item: str, weight: str, row_id: str, k: int = 50, epsilon: float = 1e-5, least_epsilon: float = 1e-6
) -> DataFrame:
    """The ``k`` items with the highest total weight, exact, ties by item.

    Rows alike in (row_id, item, weight) count once; null and empty items and null or
    negative weights don't count. Returns item, low, high, total and rank; [low, high]
    is the interval that counting guaranteed, total the exact recount of the candidates.
    Where counting with ``least_epsilon`` separates nothing, all items are summed exactly.
    """
    rows = df.select(
        F.col(row_id).alias("row_id"), F.col(item).cast("string").alias("item"), F.col(weight).cast("long").alias("weight")
    ).where((F.col("item") != "") & (F.col("weight") >= 0))
    found = top_candidates(rows.distinct(), k, epsilon=epsilon, least_epsilon=least_epsilon)
    if found is None:
        # a head too flat for bounded counting: every item is summed, by a shuffle that spills
        totals = rows.distinct().groupBy("item").agg(F.sum("weight").alias("total"))
        exact = totals.select("item", F.col("total").alias("low"), F.col("total").alias("high"), "total")
    else:
        exact = (
            rows.join(F.broadcast(found) if _small(found) else found.hint("merge"), "item")
            .select("row_id", "item", "weight", "low", "high")
            .distinct()
            .groupBy("item", "low", "high")
            .agg(F.sum("weight").alias("total"))
        )
    best = exact.orderBy(F.desc("total"), "item").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "item")))


def _small(found: DataFrame, most: int = 20_000) -> bool:
    return found.limit(most + 1).count() <= most
