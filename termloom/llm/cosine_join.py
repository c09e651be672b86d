"""Same or near-same records across splits: weighted cosine join.

Records are term-weight vectors of norm 1. Terms are ordered from rare to frequent, and
only the part of a vector before its *tail* is put into inverted lists. The tail is the
longest run of frequent terms whose product with any vector of the other side must stay
below the threshold, by the smaller of two bounds: the sum of weight times the term's
maximum weight on the other side, and the norm of the run. Terms that the other side
lacks add nothing to either. Two vectors that share no listed term can't reach the
threshold.

Where a word's list is long, its records are listed by that word and the next one they
share instead, up to where the tail after both falls below what is still to be reached.

Records that meet in a list carry the norms of the parts of their vectors in 16 classes
of terms; a pair is dropped within the join if the products of these norms can't reach
the threshold. The others get an exact product.

Bags of words are vectors of distinct words with the weight sqrt(count / words). The
product of two is at least the words they share over the words of the longer, so the
join at that threshold misses none. As the same bound holds for the words themselves,
the norm of a tail counts squared there, which makes lists shorter.

Equal bags are one vector: copies are joined as members of a class, after the join of
the classes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.skew import grid_join
from termloom.llm.text import fold_words
from termloom.runtime import checkpointed

EPS = 1e-9
PARTS, SCALE = 16, 255  # classes of terms whose norms a posting carries, a byte each
FREQUENT = 2_000  # most terms whose statistics are broadcast
TIMES = "\x1f"


@F.pandas_udf(T.StringType())
def word_bag(texts: pd.Series) -> pd.Series:
    """Distinct words in order, joined by blanks; one that occurs more than once has its count behind ``TIMES``."""

    def one(text: str | None) -> str:
        counts = Counter(fold_words(text))
        return " ".join(w if counts[w] == 1 else f"{w}{TIMES}{counts[w]}" for w in sorted(counts))

    return texts.map(one)


word_bag = word_bag.asNondeterministic()  # so that no plan runs it twice


def bag_vectors(bags: DataFrame, id_col: str, bag: str) -> DataFrame:
    """id, terms, weights and size of bags of words as :func:`word_bag` writes them."""
    parts = F.split(F.col(bag), " ")
    count = lambda x: F.coalesce(F.get(F.split(x, TIMES), F.lit(1)).cast("double"), F.lit(1.0))
    return (
        bags.select(F.col(id_col).alias("id"), F.transform(parts, lambda x: F.substring_index(x, TIMES, 1)).alias("terms"), F.transform(parts, count).alias("__counts"))
        .withColumn("size", F.aggregate("__counts", F.lit(0.0), lambda a, x: a + x))
        .select("id", "terms", F.transform("__counts", lambda x: F.sqrt(x / F.col("size"))).alias("weights"), "size")
    )


@F.pandas_udf(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
def _norms(terms: pd.Series, weights: pd.Series, scale: pd.Series) -> pd.DataFrame:
    """Squared norms by class of terms, times ``scale``, rounded up: a byte each in two integers."""
    sizes = terms.map(len).to_numpy()
    if not sizes.sum():
        return pd.DataFrame({"low": [0] * len(sizes), "high": [0] * len(sizes)})
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.concatenate(terms.to_numpy())
    part = (pd.util.hash_array(flat.astype(object)) % PARTS).astype(np.int64)
    mass = np.square(np.concatenate(weights.to_numpy()).astype(float))
    sums = np.bincount(row * PARTS + part, weights=mass, minlength=len(sizes) * PARTS).reshape(-1, PARTS)
    cells = np.minimum(np.ceil(sums * scale.to_numpy()[:, None] - 1e-6), SCALE).astype(np.uint64)
    shift = (np.arange(PARTS // 2) * 8).astype(np.uint64)
    halves = [np.bitwise_or.reduce(cells[:, i * PARTS // 2 : (i + 1) * PARTS // 2] << shift, axis=1).view(np.int64) for i in (0, 1)]
    return pd.DataFrame({"low": halves[0], "high": halves[1]})


_packed_norms = _norms.asNondeterministic()


def _in_parts(shared: bool, counted: bool) -> Column:
    """Upper bound of a pair's product, or with ``shared`` of the words in common over the longer's, by the norms in parts."""

    scale = lambda side: f"least(size_{side}, {SCALE}D)" if counted else f"{SCALE}D"
    cells = [(half, 8 * i) for half in ("low", "high") for i in range(PARTS // 2)]
    norm = lambda side, half, bit: f"(shiftrightunsigned({half}_{side}, {bit}) & {SCALE}) / {scale(side)}"
    if not shared:
        return F.expr(" + ".join(f"sqrt({norm('a', *c)} * {norm('b', *c)})" for c in cells))
    common = " + ".join(f"least({norm('a', *c)} * size_a, {norm('b', *c)} * size_b)" for c in cells)
    return F.expr(f"({common}) / greatest(size_a, size_b)")


@F.pandas_udf(T.StructType([T.StructField("terms", T.IntegerType()), T.StructField("words", T.DoubleType()), T.StructField("cosine", T.DoubleType())]))
def _products(ta: pd.Series, wa: pd.Series, na: pd.Series, tb: pd.Series, wb: pd.Series, nb: pd.Series) -> pd.DataFrame:
    """Exact products of two vectors: terms in common, words in common, cosine."""
    out = []
    for terms_a, weights_a, size_a, terms_b, weights_b, size_b in zip(ta, wa, na, tb, wb, nb, strict=True):
        known = dict(zip(terms_a, weights_a, strict=True))
        both = [(known[t], w) for t, w in zip(terms_b, weights_b, strict=True) if t in known]
        words = sum(min(round(x * x * size_a), round(y * y * size_b)) for x, y in both)
        out.append((len(both), words, math.fsum(x * y for x, y in both)))
    return pd.DataFrame(out, columns=["terms", "words", "cosine"])


_exact = _products.asNondeterministic()


def _side(df: DataFrame) -> DataFrame:
    n = F.size("terms")
    weights = F.col("weights") if "weights" in df.columns else F.transform("terms", lambda _: 1 / F.sqrt(n.cast("double")))
    size = F.col("size") if "size" in df.columns else n
    out = df.select("id", "terms", weights.alias("weights"), size.cast("double").alias("size")).where(n > 0)
    return out.withColumn("scale", _scale(F.col("size"), "size" in df.columns))


def _scale(size: Column, counted: bool) -> Column:
    """What squared norms are multiplied by to be kept in a byte: counts of words stay whole."""
    return F.least(size, F.lit(float(SCALE))) if counted else F.lit(float(SCALE))


def _with_statistics(counted: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings with df and the other side's maximum weight of their terms; terms of one side only are left out.

    ``counted`` are the postings without ids. A term of more than a ``FREQUENT``-th of all
    postings is one of fewer than ``FREQUENT``: only these are broadcast, a row for each
    bucket of lengths. The others are shuffled; none has a long list beside the whole.
    """
    on = lambda s, c: F.when(F.col("side") == s, c)
    stats = checkpointed(
        counted.groupBy("h", "bucket").agg(
            F.max(on(0, F.col("w"))).alias("max_a"), F.max(on(1, F.col("w"))).alias("max_b"), F.count("*").alias("df")
        )
    )
    # what the records of the lengths that can match have
    near = (
        stats.select("h", F.explode(F.array(F.col("bucket") - 1, "bucket", F.col("bucket") + 1)).alias("bucket"), "max_a", "max_b")
        .groupBy("h", "bucket")
        .agg(F.max("max_a").alias("max_a"), F.max("max_b").alias("max_b"))
        .where("max_a is not null and max_b is not null")
    )
    total = stats.groupBy("h").agg(F.sum("df").alias("df"))
    known = near.join(total.hint("merge"), "h")
    frequent = F.col("df") > stats.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first().n / FREQUENT
    hot = total.where(frequent).select(F.col("h").alias("hot"))
    marked = postings.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left")
    cold = marked.where("hot is null").join(known.where(~frequent).hint("merge"), ["h", "bucket"])
    warm = marked.where("hot is not null").join(F.broadcast(known.where(frequent)), ["h", "bucket"])
    other = F.when(F.col("side") == 0, F.col("max_b")).otherwise(F.col("max_a"))
    return cold.unionByName(warm).withColumn("other", other).drop("hot", "max_a", "max_b")


def weighted_cosine_join(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    *,
    shared: bool = False,
    hot_list: int = 256,
    most_refined: int = 128,
    cell: int = 5_000,
) -> DataFrame:
    """All pairs (id_a of ``left``, id_b of ``right``) with a product of at least ``threshold``.

    Both sides have id (unique) and terms (distinct strings), and may have weights (not
    negative, of norm 1; without them every term of a record weighs the same) and size.
    With ``shared``, weights are sqrt(count / size) of words, and pairs are those whose
    words in common, with repetition, are at least ``threshold`` of the larger size.
    Records without terms are in no pair. Returns id_a, id_b, size_a, size_b, shared
    (number of common terms, or of common words) and cosine.

    With ``shared``, terms in more than ``hot_list`` records are listed in pairs. Records
    of more than ``most_refined`` words are listed by single terms, those close to that
    length in both ways, so no pair is missed. ``cell`` bounds the rows of one list that
    a task meets, on either side.
    """
    sides = [_side(left), _side(right)]
    # lengths that can't match lie in buckets that don't meet
    bucket: Column = F.floor(F.log("size") / -math.log(threshold) + EPS).cast("int") if shared else F.lit(0)
    near: Column = F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1) if shared else F.array("bucket")

    def postings(*columns: str) -> DataFrame:
        out = [d.select(F.lit(s).alias("side"), *columns, bucket.alias("bucket"), F.explode(F.arrays_zip("terms", "weights")).alias("x")) for s, d in enumerate(sides)]
        # 64-bit hashes stand for terms in lists; a clash only makes a bound larger
        return out[0].unionByName(out[1]).select("side", *columns, "bucket", F.xxhash64("x.terms").alias("h"), F.col("x.weights").alias("w"))

    known = _with_statistics(postings(), postings("id", "size"))
    w2 = F.col("w") * F.col("w")
    gain = F.least(w2, F.col("w") * F.col("other")) if shared else F.col("w") * F.col("other")
    record = Window.partitionBy("side", "id")
    onwards = record.orderBy(F.desc("df"), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rest: the most that the term and all more frequent ones can add
    by_max, sq = F.sum("gain").over(onwards), F.sum(w2).over(onwards)
    tails = known.withColumn("gain", gain).withColumn("rest", F.least(by_max, sq if shared else F.sqrt(sq)))
    refined = lambda size, df: F.lit(shared) & (size <= most_refined) & (df > hot_list)
    first = F.col("rest") >= threshold - EPS
    # how far a second term has to be looked for
    slack = F.coalesce(F.max(F.when(first & refined(F.col("size"), F.col("df")), F.col("gain"))).over(record), F.lit(0.0))
    heads = (
        tails.withColumn("slack", slack)
        .where(F.col("rest") >= threshold - F.col("slack") - EPS)
        .groupBy("side", "id", "size", "bucket")
        .agg(F.collect_list(F.struct("h", "df", "gain", "rest")).alias("xs"))
    )
    single = F.filter(
        "xs",
        lambda x: (x["rest"] >= threshold - EPS) & (~refined(F.col("size"), x["df"]) | (F.col("size") >= threshold * most_refined)),
    )
    long_lists = F.filter("xs", lambda x: refined(F.col("size"), x["df"]))
    later = lambda x, y: (y["df"] > x["df"]) | ((y["df"] == x["df"]) & (y["h"] < x["h"]))
    pairs = F.flatten(
        F.transform(
            F.filter("long", lambda x: x["rest"] >= threshold - EPS),
            lambda x: F.transform(
                F.filter(
                    "long",
                    # a term that can reach the threshold by itself is its own partner
                    lambda y: (later(x, y) & (y["rest"] >= threshold - x["gain"] - EPS)) | ((y["h"] == x["h"]) & (x["gain"] >= threshold - EPS)),
                ),
                lambda y: F.xxhash64(x["h"], y["h"]),
            ),
        )
    )
    keyed = heads.withColumn("long", long_lists).select("side", "id", "size", "bucket", F.concat(F.transform(single, lambda x: F.xxhash64(x["h"])), pairs).alias("keys"))
    norms = [d.select(F.lit(s).alias("side"), "id", _packed_norms("terms", "weights", "scale").alias("norms")) for s, d in enumerate(sides)]
    norms = norms[0].unionByName(norms[1]).select("side", "id", "norms.low", "norms.high")
    listed = checkpointed(keyed.where(F.size("keys") > 0).join(norms.hint("merge"), ["side", "id"]).select("side", "id", "size", "low", "high", "bucket", F.explode("keys").alias("key")))

    def one_side(s: int, n: str, at: Column) -> DataFrame:
        return listed.where(F.col("side") == s).select("key", at.alias("bucket"), *[F.col(c).alias(f"{c}_{n}") for c in ("id", "size", "low", "high")])

    met = grid_join(one_side(0, "a", F.col("bucket")), one_side(1, "b", F.explode(near)), ["key", "bucket"], left_id="id_a", right_id="id_b", limit=cell)
    if shared:
        met = met.where(F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - EPS)
    candidates = met.where(_in_parts(shared, "size" in left.columns and "size" in right.columns) >= threshold - EPS).select("id_a", "id_b").distinct()
    va, vb = (d.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "terms", "weights", "size")]) for d, s in zip(sides, "ab", strict=True))
    full = candidates.join(va.hint("merge"), "id_a").join(vb.hint("merge"), "id_b")
    exact = full.select("id_a", "id_b", "size_a", "size_b", _exact("terms_a", "weights_a", "size_a", "terms_b", "weights_b", "size_b").alias("x"))
    reached = F.col("x.words") >= threshold * F.greatest("size_a", "size_b") - EPS if shared else F.col("x.cosine") >= threshold - EPS
    return exact.where(reached).select(
        "id_a", "id_b", F.col("size_a").cast("int"), F.col("size_b").cast("int"), F.col("x.words" if shared else "x.terms").cast("int").alias("shared"), "x.cosine"
    )


def split_bags(df: DataFrame, *, id_col: str, split: str, segment: str, source: str | None = None) -> DataFrame:
    """item, side (train, dev or test), source, bag and class of every record that can be in a pair.

    ``split`` is read without case and outer blanks; records of other or null splits,
    without an id or without a word are left out. Records of one class have the same words.
    """
    name = F.lower(F.regexp_replace(F.col(split), r"(?U)^\s+|\s+$", ""))
    return (
        df.select(
            F.col(id_col).alias("item"),
            name.alias("side"),
            (F.col(source) if source else F.lit(None).cast("string")).alias("source"),
            F.col(segment).alias("__segment"),
        )
        .where(F.col("side").isin("train", "dev", "test") & F.col("__segment").isNotNull() & F.col("item").isNotNull())
        .select("item", "side", "source", word_bag("__segment").alias("bag"))
        .where(F.col("bag") != "")
        .withColumn("class", F.unhex(F.md5("bag")))
    )


def agreeing_classes(bags: DataFrame, agreement: float = 0.8) -> DataFrame:
    """(class_a of the train split, class_b of dev or test) whose shared words are at least ``agreement`` of the longer.

    ``bags`` is read several times and should be checkpointed.
    """
    classes = bags.groupBy("class").agg(
        F.min("bag").alias("bag"),
        F.max(F.col("side") == "train").alias("train"),
        F.max(F.col("side") != "train").alias("held_out"),
    )
    sides = [bag_vectors(classes.where(s), "class", "bag") for s in ("train", "held_out")]
    pairs = weighted_cosine_join(*sides, agreement, shared=True)
    return pairs.select(F.col("id_a").alias("class_a"), F.col("id_b").alias("class_b"), "shared", "cosine")


def cross_split_pairs(df: DataFrame, *, id_col: str, split: str, segment: str, agreement: float = 0.8, hot_class: int = 20_000) -> DataFrame:
    """Each pair (item_a < item_b) of a train and a dev or test record whose segments agree.

    Classes are put back to their members by joins that split classes of more than
    ``hot_class`` rows on both sides.
    """
    bags = checkpointed(split_bags(df, id_col=id_col, split=split, segment=segment))
    pairs = checkpointed(agreeing_classes(bags, agreement).select("class_a", "class_b"))
    train = bags.where("side = 'train'").select(F.col("class").alias("class_a"), F.col("item").alias("train_item"))
    held = bags.where("side <> 'train'").select(F.col("class").alias("class_b"), F.col("item").alias("held_item"))
    trained = grid_join(pairs, train, ["class_a"], left_id="class_b", right_id="train_item", limit=hot_class).select("class_b", "train_item")
    return grid_join(trained, held, ["class_b"], left_id="train_item", right_id="held_item", limit=hot_class).select(
        F.least("train_item", "held_item").alias("item_a"), F.greatest("train_item", "held_item").alias("item_b")
    )


def overlap_report(df: DataFrame, *, id_col: str, split: str, segment: str, source: str, agreement: float = 0.8) -> DataFrame:
    """Per held-out split and source: records that can be compared, and those that agree with a train record.

    Returns split, source (null for records without one), records, overlapping, exact;
    ``exact`` counts those with the same words. Pairs are not expanded for this.
    """
    bags = checkpointed(split_bags(df, id_col=id_col, split=split, segment=segment, source=source))
    hit = agreeing_classes(bags, agreement).groupBy("class_b").agg(F.max(F.col("class_a") == F.col("class_b")).alias("same"))
    held = bags.where("side <> 'train'").groupBy("class", "side", "source").agg(F.count("*").alias("n"))
    return (
        held.join(hit.hint("merge"), held["class"] == hit["class_b"], "left")
        .groupBy(F.col("side").alias("split"), "source")
        .agg(
            F.sum("n").alias("records"),
            F.sum(F.when(F.col("same").isNotNull(), F.col("n")).otherwise(0)).alias("overlapping"),
            F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("exact"),
        )
    )
