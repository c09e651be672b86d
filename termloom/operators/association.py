"""Association measures of bigrams, trigrams and quadgrams of a whole corpus."""

from __future__ import annotations

import itertools
import math

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.runtime import beside


def token_stream(segments: DataFrame, id_col: str, tokens: str, k: int, *, cross_segments: bool = True, blocks: int = 1000) -> DataFrame:
    """Arrays of k successive tokens over the corpus in order of ``id_col``, a number.

    Windows cross segments: each segment is followed by the first tokens of the next
    ones. These are found among the segments' heads alone, by a window within ``blocks``
    ranges of equally many ids and one over the blocks' heads, ``blocks`` rows at most.
    Empty segments and null tokens are nothing.
    """
    base = segments.select(F.col(id_col).alias("id"), F.array_compact(tokens).alias("t")).where(F.size("t") > 0)
    if cross_segments and k > 1:
        shares = [i / blocks for i in range(1, blocks)] or [0.5]
        # a number a block comes to the driver
        ends = base.agg(F.percentile_approx(F.col("id").cast("double"), shares, 10 * blocks).alias("x")).first().x
        ends = sorted(set(ends or [0.0]))
        heads = base.select("id", F.slice("t", 1, k - 1).alias("head"))
        splits = [-math.inf, *ends, math.inf]
        heads = Bucketizer(splits=splits, inputCol="__at", outputCol="block").transform(heads.withColumn("__at", F.col("id").cast("double"))).drop("__at")
        ahead = Window.partitionBy("block").orderBy("id").rowsBetween(1, k - 1)
        flat = lambda c: F.slice(F.flatten(c), 1, k - 1)
        first = F.row_number().over(Window.partitionBy("block").orderBy("id"))
        tops = heads.withColumn("__n", first).where(F.col("__n") < k).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "head"))).alias("hs"))
        tops = tops.select("block", flat(F.col("hs.head")).alias("block_head"))
        later = Window.orderBy("block").rowsBetween(1, k - 1)
        tops = tops.select("block", flat(F.collect_list("block_head").over(later)).alias("after_block"))
        following = (
            heads.withColumn("after", flat(F.collect_list("head").over(ahead)))
            .join(F.broadcast(tops), "block")
            .select("id", F.slice(F.concat("after", "after_block"), 1, k - 1).alias("after"))
        )
        base = base.join(following.hint("merge"), "id").withColumn("t", F.concat("t", "after"))
    return base.where(F.size("t") >= k).select(
        F.explode(F.expr(f"transform(sequence(1, size(t) - {k - 1}), i -> slice(t, i, {k}))")).alias("gram")
    )


def ngram_table(segments: DataFrame, id_col: str, tokens: str, k: int = 2, **options) -> DataFrame:
    """candidate, n, w1..wk, n_all and the tokens' marginals n1..nk, with the number of tokens as ``total``."""
    grams = token_stream(segments, id_col, tokens, k, **options)
    counts = grams.groupBy("gram").agg(F.count("*").alias("n_all"))
    single = segments.select(F.explode(F.array_compact(tokens)).alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    total = single.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("total"))
    out = counts.select("gram", "n_all", *(F.col("gram")[i].alias(f"w{i + 1}") for i in range(k)))
    for i in range(1, k + 1):
        out = out.join(single.select(F.col("w").alias(f"w{i}"), F.col("f").alias(f"n{i}")), f"w{i}")
    return beside(out, total).select(
        F.array_join("gram", " ").alias("candidate"), F.lit(k).alias("n"), *(f"w{i}" for i in range(1, k + 1)), "n_all",
        *(f"n{i}" for i in range(1, k + 1)), "total",
    )


def _xlog(x: Column, expected: Column) -> Column:
    return F.when((x > 0) & (expected > 0), x * F.log(x / expected)).otherwise(F.lit(0.0))


def bigram_measures(table: DataFrame) -> dict[str, Column]:
    """Every measure as an expression over :func:`ngram_table` with k = 2.

    loglikelihood and odds take the cell of neither word as total - n1 - n2, without the
    pair itself; the others use the usual table. loglikelihood is 0 where a logarithm of
    it doesn't exist; odds takes one for an empty cell of a word without the other.
    """
    d = lambda c: F.col(c).cast("double")
    n11, n1, n2, t = d("n_all"), d("n1"), d("n2"), d("total")
    n12, n21 = n1 - n11, n2 - n11
    n22 = t - n11 - n12 - n21
    exp = n1 * n2 / t
    cells = [(n11, n1 * n2), (n12, n1 * (t - n2)), (n21, (t - n1) * n2), (n22, (t - n1) * (t - n2))]
    g = sum((_xlog(o, e / t) for o, e in cells[1:]), _xlog(cells[0][0], cells[0][1] / t))
    phi_den = n1 * n2 * (t - n1) * (t - n2)
    phi = F.when(phi_den != 0, (n11 * n22 - n12 * n21) * (n11 * n22 - n12 * n21) / phi_den)
    # the classic measures take the cell of neither word without the pair, but all tokens as their sum
    q22 = t - n1 - n2
    r2, c2 = n21 + q22, n12 + q22
    g2 = F.lit(0.0)
    fails = F.lit(False)
    for o, e in ((n11, n1 * n2 / t), (n12, n1 * c2 / t), (n21, n2 * r2 / t), (q22, r2 * c2 / t)):
        # the logarithm doesn't exist
        fails = fails | (e == 0) | (F.when(e == 0, F.lit(-1.0)).otherwise(o / e) <= 0)
        g2 = g2 + F.when((e != 0) & (o / e > 0), o * F.log2(o / e)).otherwise(F.lit(0.0))
    one = lambda x: F.when(x == 0, F.lit(1.0)).otherwise(x)
    return {
        "raw_freq": n11 / t,
        "pmi": F.log2(n11 * t / (n1 * n2)),
        "student_t": (n11 - exp) / F.sqrt(n11),
        "chi_sq": t * phi,
        "phi_sq": phi,
        "mi_like": n11 * n11 * n11 / (n1 * n2),
        "likelihood_ratio": 2 * g,
        "poisson_stirling": n11 * (F.log2(n11 / exp) - 1),
        "jaccard": n11 / (n11 + n12 + n21),
        "dice": 2 * n11 / (n1 + n2),
        "loglikelihood": F.when(fails, F.lit(0.0)).otherwise(2 * g2),
        "mi": F.log2(n11 / exp),
        "mi2": F.log2(F.pow(n11 / exp, F.lit(2.0))),
        "mi3": F.log2(F.pow(n11 / exp, F.lit(3.0))),
        "odds": n11 * q22 / (one(n12) * one(n21)),
        "z_score": (n11 - exp) / F.sqrt(exp),
    }


def _below(o: int, a: int, b: int, t: int) -> float:
    """P(X <= o) of the hypergeometric distribution with marginals a, b of t.

    Summed from the cell away from the mode, each term from the one before, until terms
    no longer change the sum: a number of steps like the distribution's deviation.
    """
    low, high = max(0, a + b - t), min(a, b)
    if o >= high:
        return 1.0
    if o < low:
        return 0.0
    lg = math.lgamma
    density = lambda k: math.exp(
        lg(a + 1) + lg(t - a + 1) + lg(b + 1) + lg(t - b + 1) - lg(t + 1) - lg(k + 1) - lg(a - k + 1) - lg(b - k + 1) - lg(t - a - b + k + 1)
    )
    mode = (a + 1) * (b + 1) // (t + 2)
    down = o <= mode
    k = o if down else o + 1
    p = total = density(k)
    while p > total * 1e-17 and (k > low if down else k < high):
        p *= k * (t - a - b + k) / ((a - k + 1) * (b - k + 1)) if down else (a - k) * (b - k) / ((k + 1) * (t - a - b + k + 1))
        k += -1 if down else 1
        total += p
    return min(1.0, max(0.0, total if down else 1 - total))


def fisher() -> Column:
    """P(X <= n_all) of the hypergeometric distribution of a bigram's table: Fisher's exact test, left side."""

    @F.pandas_udf(T.DoubleType())
    def left(n: pd.Series, n1: pd.Series, n2: pd.Series, total: pd.Series) -> pd.Series:
        known: dict[tuple[int, ...], float] = {}  # of this batch
        keys = list(zip(map(int, n), map(int, n1), map(int, n2), map(int, total), strict=True))
        for key in set(keys):
            known[key] = _below(*key)
        return pd.Series([known[key] for key in keys], dtype="float64")

    return left("n_all", "n1", "n2", "total")


def _subsets(k: int) -> list[tuple[int, ...]]:
    return [c for n in range(k + 1) for c in itertools.combinations(range(k), n)]


def table_measures(segments: DataFrame, id_col: str, tokens: str, k: int, **options) -> DataFrame:
    """candidate and chi_sq, likelihood_ratio and jaccard of the table of 2^k cells of every k-gram, for k of 3 or 4.

    The table's edges are how often the words of each part of the k-gram stand at the same
    distances. Windows of one length are made once, and counted for each shape in it.
    """
    base = ngram_table(segments, id_col, tokens, k, **options)
    for span in range(2, k + 1):
        windows = token_stream(segments, id_col, tokens, span, **options)
        for shape in (c for c in _subsets(span) if 2 <= len(c) < k and c[0] == 0 and c[-1] == span - 1):
            counted = windows.groupBy(*[F.col("gram")[i].alias(f"__{j}") for j, i in enumerate(shape)]).agg(F.count("*").alias("__c"))
            for at in range(k - span + 1):
                places = [i + at for i in shape]
                name = "s" + "".join(map(str, places))
                edge = counted.select(*[F.col(f"__{j}").alias(f"w{i + 1}") for j, i in enumerate(places)], F.col("__c").alias(name))
                base = base.join(edge.hint("merge"), [f"w{i + 1}" for i in places])
    d = lambda c: F.col(c).cast("double")
    edges = {(): d("total"), tuple(range(k)): d("n_all")} | {(i,): d(f"n{i + 1}") for i in range(k)}
    edges |= {c: d("s" + "".join(map(str, c))) for c in _subsets(k) if 2 <= len(c) < k}
    name = lambda c: "c" + "".join("1" if i in c else "0" for i in range(k))
    # a cell: its words there and no other, by inclusion and exclusion
    cells = {name(c): sum((edges[t] * (-1) ** (len(t) - len(c)) for t in edges if set(c) <= set(t)), F.lit(0.0)) for c in _subsets(k)}
    t = base.select("candidate", *[x.alias(n) for n, x in cells.items()])
    side = lambda i, v: sum((F.col(n) for n in cells if n[i + 1] == v), F.lit(0.0))
    whole = sum((F.col(n) for n in cells), F.lit(0.0))
    t = t.select("*", whole.alias("whole"), *[side(i, v).alias(f"m{i}{v}") for i in range(k) for v in "01"])
    chi, llr = F.lit(0.0), F.lit(0.0)
    for n in cells:
        e = F.lit(1.0)
        for i in range(k):
            e = e * F.col(f"m{i}{n[i + 1]}") if i == 0 else e * (F.col(f"m{i}{n[i + 1]}") / F.col("whole"))
        chi = chi + F.when(e > 0, (F.col(n) - e) * (F.col(n) - e) / e).otherwise(F.lit(0.0))
        llr = llr + _xlog(F.col(n), e)
    others = sum((F.col(n) for n in cells if "1" in n), F.lit(0.0))
    return t.select("candidate", chi.alias("chi_sq"), (2 * llr).alias("likelihood_ratio"), (F.col("c" + "1" * k) / others).alias("jaccard"))


def ngram_measures(k: int) -> dict[str, Column]:
    """raw_freq, pmi, student_t, mi_like and poisson_stirling for k of 3 or 4."""
    d = lambda c: F.col(c).cast("double")
    n, t = d("n_all"), d("total")
    product = d("n1")
    for i in range(2, k + 1):
        product = product * d(f"n{i}")
    expected = product
    for _ in range(k - 1):
        expected = expected / t
    return {
        "raw_freq": n / t,
        "pmi": F.log2(n / expected),
        "student_t": (n - expected) / F.sqrt(n),
        "mi_like": F.pow(n, F.lit(3.0)) / product,
        "poisson_stirling": n * (F.log2(n / expected) - 1),
    }


def association(segments: DataFrame, id_col: str, tokens: str, measure: str, *, k: int = 2, **options) -> DataFrame:
    """candidate, n, measure, value (double) of every k-gram of the corpus."""
    if k in (3, 4) and measure in ("chi_sq", "likelihood_ratio", "jaccard"):
        scores = table_measures(segments, id_col, tokens, k, **options)
        return scores.select("candidate", F.lit(k).alias("n"), F.lit(measure).alias("measure"), F.col(measure).alias("value"))
    table = ngram_table(segments, id_col, tokens, k, **options)
    known = bigram_measures(table) | {"fisher": fisher()} if k == 2 else ngram_measures(k)
    if measure not in known:
        raise ValueError(f"measure {measure!r} is none of {', '.join(known)}")
    return table.select("candidate", "n", F.lit(measure).alias("measure"), known[measure].alias("value"))


def scored(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates with the measure and value of ``scores``; null where there is none."""
    return candidates.select("candidate", "n").join(scores.select("candidate", "measure", "value"), "candidate", "left")
