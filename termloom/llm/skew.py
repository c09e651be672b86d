"""Joins that stay balanced where single keys hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.runtime import checkpointed

WAYS = 32


def spread_over(key: Column, ways: Column | int) -> Column:
    """One of 0 to ``ways`` - 1, the same for equal keys."""
    return F.pmod(F.xxhash64(key, F.lit(7)), ways if isinstance(ways, Column) else F.lit(ways)).cast("int")


def grid_join(left: DataFrame, right: DataFrame, on: list[str], *, left_id: str, right_id: str, limit: int) -> DataFrame:
    """Inner join on ``on`` by which no task meets more than about ``limit`` rows of one key and side.

    A key with more rows is split on both sides: its left rows are spread over as many
    parts as they fill, its right rows too, and each pair of parts meets in a cell of its
    own. Hot keys are found by counting first; how many parts they have reaches the rows by
    a join that is itself spread ``WAYS`` ways. Without hot keys it is a plain join. Nothing
    is broadcast, and no row is dropped. The two sides, which are read twice, share no
    column names but those of ``on``.
    """
    count = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(limit)).cast("int").alias(name))
    hot = checkpointed(
        count(left, "__parts_l")
        .join(count(right, "__parts_r").hint("merge"), on)
        .where("__parts_l > 1 or __parts_r > 1")
    )
    if hot.isEmpty():
        return left.join(right.hint("merge"), on)
    hot = hot.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))

    def placed(df: DataFrame, id_col: str, own: str, other: str, cell: str, crossing: str) -> DataFrame:
        parted = df.withColumn("__way", spread_over(F.col(id_col), WAYS)).join(hot.hint("merge"), [*on, "__way"], "left").drop("__way")
        return (
            parted.withColumn(cell, spread_over(F.col(id_col), F.coalesce(own, F.lit(1))))
            .withColumn(crossing, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
            .drop("__parts_l", "__parts_r")
        )

    a = placed(left, left_id, "__parts_l", "__parts_r", "__cell_l", "__cell_r")
    b = placed(right, right_id, "__parts_r", "__parts_l", "__cell_r", "__cell_l")
    return a.join(b.hint("merge"), [*on, "__cell_l", "__cell_r"]).drop("__cell_l", "__cell_r")
