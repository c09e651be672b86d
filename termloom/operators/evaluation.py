"""Evaluation of candidates and of predicted terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.runtime import beside


def _rates(hit: Column, predicted: Column, wanted: Column, scale: float) -> list[Column]:
    p = F.when(predicted > 0, scale * hit / predicted).otherwise(F.lit(0.0))
    r = F.when(wanted > 0, scale * hit / wanted).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), f.alias("f1")]


def evaluate_topk(
    candidates: DataFrame,
    reference: DataFrame,
    k: int,
    *,
    column: str = "term",
    ignore_case: bool = False,
    nmax: int | None = None,
    ascending: bool = False,
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Precision, recall and F1, in per cent, of the k first candidates: one row.

    Candidates of at most ``nmax`` words are taken by value, the highest first or with
    ``ascending`` the lowest, then by frequency where there is such a column. Those that
    tie for the last places count by the share of them that gets in, the expectation over
    random orders. ``seeds`` (column term) are references too; repeated references count
    as often as they stand there. With ``ignore_case`` a candidate is right if it or its
    lower-case form is a reference. Without candidates or references the rates are 0.
    """
    listed = reference.select(F.col(column).alias("__ref"))
    if seeds is not None:
        listed = listed.unionByName(seeds.select(F.col("term").alias("__ref")))
    known = listed.where(F.col("__ref").isNotNull()).groupBy("__ref").agg(F.count("*").alias("__c"))
    found = candidates.where(F.col("candidate").isNotNull())
    if nmax is not None:
        found = found.where(F.col("n") <= nmax)
    frequency = F.col("frequency") if "frequency" in candidates.columns else F.lit(0)
    order = [F.asc_nulls_first("value") if ascending else F.desc_nulls_last("value"), F.desc_nulls_last("frequency")]
    rows = found.select("candidate", "value", frequency.alias("frequency")).join(known.select("__ref"), F.col("candidate") == F.col("__ref"), "left")
    hit = F.col("__ref").isNotNull()
    if ignore_case:
        rows = rows.join(known.select(F.col("__ref").alias("__low")), F.lower("candidate") == F.col("__low"), "left")
        hit = hit | F.col("__low").isNotNull()
    levels = (
        rows.groupBy("value", "frequency")
        .agg(F.count("*").alias("__all"), F.sum(hit.cast("long")).alias("__hits"))
        .orderBy(*order)
        .limit(k)  # each level has a candidate, so the k first lie in the k first levels
    )
    above = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(k) - F.coalesce(F.col("__above"), F.lit(0))) / F.col("__all")))
    sums = (
        levels.withColumn("__above", F.sum("__all").over(above))
        .select((share * F.col("__hits")).alias("h"), (share * F.col("__all")).alias("p"))
        .agg(F.coalesce(F.sum("h"), F.lit(0.0)).alias("h"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("p"))
    )
    wanted = known.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("w"))
    return beside(sums, wanted).select(F.lit(k).alias("k"), *_rates(F.col("h"), F.col("p"), F.col("w"), 100.0))


def term_metrics(predicted: DataFrame, true: DataFrame, *, id_col: str, terms: str, as_sets: bool = False) -> DataFrame:
    """Micro precision, recall and F1 of terms per segment: one row; 0 where nothing is to be found.

    Terms of a segment are compared as multisets, or as sets.
    """
    def counts(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(id_col, F.explode(terms).alias("__term"))
        n = F.lit(1) if as_sets else F.count("*")
        return rows.groupBy(id_col, "__term").agg((F.max(n) if as_sets else n).alias(name))

    both = counts(predicted, "__p").join(counts(true, "__t"), [id_col, "__term"], "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = both.agg(
        F.coalesce(F.sum(F.least(z("__p"), z("__t"))), F.lit(0)).alias("h"),
        F.coalesce(F.sum(z("__p")), F.lit(0)).alias("p"),
        F.coalesce(F.sum(z("__t")), F.lit(0)).alias("t"),
    )
    return sums.select(*_rates(F.col("h"), F.col("p"), F.col("t"), 1.0))
