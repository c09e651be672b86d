"""Term candidates: counting, filtering, normalising.

A candidate table has candidate string, n int, measure string and value long. Every
operator takes and gives DataFrames and is lazy. Null candidates are dropped by all;
empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.tokens import case_key, ngram_arrays, words


def token_frequency(segments: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token, frequency over an array column."""
    return segments.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))


def ngram_counts(segments: DataFrame, tokens: str = "tokens", *, nmin: int = 2, nmax: int = 3, minfreq: int = 2) -> DataFrame:
    """ngram, n, frequency of the windows within each segment, those with at least ``minfreq``.

    Partial counts are made before the only shuffle, so a frequent n-gram costs one row a task.
    Windows are rows of the tokens beside those that follow. Nothing is filtered before, which
    would tokenise each text twice.
    """
    size = F.col("__size")
    shifted = [f"__t{k}" for k in range(nmax)]
    grams = {
        str(n): F.when(F.col("__at") + n <= size, F.concat_ws(" ", *[F.col("__w").getField(t) for t in shifted[:n]])) for n in range(nmin, nmax + 1)
    }
    return (
        segments.select(F.col(tokens).alias("__t0"), F.size(tokens).alias("__size"))
        .select("__size", "__t0", *[F.slice("__t0", k + 1, F.greatest(size, F.lit(0))).alias(t) for k, t in enumerate(shifted) if k])
        .select("__size", F.posexplode_outer(F.arrays_zip(*shifted)).alias("__at", "__w"))
        .select(*[gram.alias(n) for n, gram in grams.items()])
        .unpivot([], list(grams), "n", "ngram")
        .where(F.col("ngram").isNotNull())
        .groupBy("ngram", "n")
        .agg(F.count("*").alias("frequency"))
        .where(F.col("frequency") >= minfreq)
        .select("ngram", F.col("n").cast("int").alias("n"), "frequency")
    )


def ngrams_by_segment(segments: DataFrame, id_col: str, tokens: str = "tokens", *, nmin: int = 2, nmax: int = 3) -> DataFrame:
    """id_col, ngram, n, frequency within each segment, counted on the map side first."""
    return (
        segments.select(id_col, F.explode(ngram_arrays(tokens, nmin, nmax)).alias("g"))
        .groupBy(id_col, F.array_join("g.gram", " ").alias("ngram"), F.col("g.n").alias("n"))
        .agg(F.count("*").alias("frequency"))
    )


def as_candidates(counts: DataFrame, measure: str = "frequency") -> DataFrame:
    """Counted n-grams as a candidate table."""
    return counts.select(F.col("ngram").alias("candidate"), "n", F.lit(measure).alias("measure"), F.col("frequency").alias("value"))


def _in(word: Column, words_: Iterable[str]) -> Column:
    values = sorted(words_)
    return word.isin(values) if values else F.lit(False)


def stopword_condition(term: Column, outer: Iterable[str], inner: Iterable[str] = (), *, legacy: bool = False) -> Column:
    """Whether a term passes: no outer stopword first or last, no inner one between (legacy: or last)."""
    w = words(F.lower(term))
    size = F.size(w)
    ends = _in(F.get(w, F.lit(0)), outer) | _in(F.get(w, size - 1), outer)
    between = F.slice(w, 2, F.greatest(size - (1 if legacy else 2), F.lit(0)))
    banned = sorted(inner)
    middle = F.arrays_overlap(between, F.array(*map(F.lit, banned))) if banned else F.lit(False)
    return (size > 0) & ~ends & ~middle


def stopword_filter(candidates: DataFrame, outer: Iterable[str], inner: Iterable[str] = (), *, legacy: bool = False) -> DataFrame:
    return candidates.where(stopword_condition(F.col("candidate"), outer, inner, legacy=legacy))


def case_normalize(candidates: DataFrame) -> DataFrame:
    """Terms that differ in case only become one, with the sum of their values; all-capital terms stay."""
    key = case_key(F.col("candidate"))
    return (
        candidates.where(F.col("candidate").isNotNull())
        .groupBy(key.alias("candidate"), "measure")
        .agg(F.sum("value").alias("value"))
        .select("candidate", F.size(words(F.col("candidate"))).alias("n"), "measure", "value")
    )


def case_normalize_legacy(candidates: DataFrame) -> DataFrame:
    """A term is merged into its lower-case twin only where that twin is a candidate itself."""
    lower = candidates.where(F.lower("candidate") == F.col("candidate")).select(F.col("candidate").alias("__twin")).distinct()
    key = F.coalesce("__twin", "candidate")
    return (
        candidates.where(F.col("candidate").isNotNull())
        .join(lower, F.lower("candidate") == F.col("__twin"), "left")
        .groupBy(key.alias("candidate"), "measure")
        .agg(F.sum("value").alias("value"))
        .select("candidate", F.size(words(F.col("candidate"))).alias("n"), "measure", "value")
    )


def nest_normalize(candidates: DataFrame, percent: float = 10) -> DataFrame:
    """Takes from each term the values of longer terms that hold it, where these are within ``percent`` of its own.

    The longer terms' distinct shorter runs are joined to the terms by equality, so no
    pair of terms is compared that has no run in common; the band is a filter after it.
    All values are those before the call; terms that reach 0 go.
    """
    p = percent / 100
    base = candidates.where(F.col("candidate").isNotNull()).select("candidate", "n", "measure", "value")
    runs = (
        base.withColumn("__w", F.split("candidate", " "))
        .where(F.size("__w") > 1)
        .select(
            F.col("value").alias("outer_value"),
            F.col("n").alias("outer_n"),
            F.explode(
                F.expr(
                    "array_distinct(flatten(transform(sequence(1, size(__w) - 1), k -> transform("
                    "sequence(1, size(__w) - k + 1), i -> array_join(slice(__w, i, k), ' ')))))"
                )
            ).alias("candidate"),
        )
        # a run that very many terms hold is few rows by now: one per length and value
        .groupBy("candidate", "outer_n", "outer_value")
        .agg(F.count("*").alias("times"))
    )
    held = base.join(runs, "candidate").where(
        (F.col("outer_n") > F.col("n"))
        & (F.col("outer_value") >= F.col("value") * (1 - p))
        & (F.col("outer_value") <= F.col("value") * (1 + p))
    )
    taken = held.groupBy("candidate", "measure").agg(F.sum(F.col("outer_value") * F.col("times")).alias("__taken"))
    return (
        base.join(taken, ["candidate", "measure"], "left")
        .withColumn("value", F.col("value") - F.coalesce("__taken", F.lit(0)))
        .where(F.col("value") > 0)
        .select("candidate", "n", "measure", "value")
    )


def nest_normalize_legacy(candidates: DataFrame, percent: float = 10) -> DataFrame:
    """Drops each term that is a part, by characters, of a term one longer with a value in the band.

    Such a part of k words ends one word of the longer term, is equal to those between
    and begins another. From each longer term all starts that a part can have (the end
    of a word and the words between; for one word, its substrings) are joined to the
    terms' own by equality; the rest is a filter.
    """
    p = percent / 100
    base = candidates.where(F.col("candidate").isNotNull()).select("candidate", "n", "measure", "value")
    inner_key = (
        "flatten(transform(__ks, k -> if(k = 1, "
        "flatten(transform(__w, x -> flatten(transform(sequence(1, greatest(length(x), 1)), i -> transform("
        "sequence(1, greatest(length(x) - i + 1, 1)), l -> concat('1 ', substring(x, i, l))))))), "
        "flatten(transform(sequence(1, size(__w) - k + 1), j -> transform(sequence(1, length(__w[j - 1]) + 1), i -> "
        "concat(k, ' ', array_join(concat(array(substring(__w[j - 1], i)), slice(__w, j + 1, k - 2)), ' '))))))))"
    )
    longer = (
        base.where(F.col("n") > 1)
        .withColumn("__w", F.split("candidate", " "))
        # other white space than blanks makes n and the number of blanks differ
        .withColumn("__ks", F.when((F.col("n") == F.size("__w")) & (F.size("__w") > 1), F.array(F.size("__w") - 1)).otherwise(F.sequence(F.lit(1), F.size("__w"))))
        .select(
            F.col("candidate").alias("__longer"),
            (F.col("n") - 1).alias("n"),
            F.col("value").alias("__value"),
            F.explode(F.array_distinct(F.expr(inner_key))).alias("__key"),
        )
    )
    w = F.split("candidate", " ")
    own = F.when(F.size(w) == 1, F.concat(F.lit("1 "), F.col("candidate"))).otherwise(
        F.concat(F.size(w).cast("string"), F.lit(" "), F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "))
    )
    inside = (
        (F.col("__value") >= F.col("value") * (1 - p))
        & (F.col("__value") <= F.col("value") * (1 + p))
        & F.contains("__longer", "candidate")
    )
    gone = base.withColumn("__key", own).join(longer, ["n", "__key"]).where(inside).select("candidate").distinct()
    return base.join(gone, "candidate", "left_anti")


def regex_exclusion(candidates: DataFrame, regexes: DataFrame | list[str], *, legacy: bool = False) -> DataFrame:
    """Drops terms that a regular expression of as many words matches in full (legacy: as a prefix, of any length).

    Regular expressions are a list that someone wrote: a table of them comes to the driver,
    and each is a literal that is compiled once, tried only on terms of its length. Nothing
    is shuffled.
    """
    listed = [r.regex for r in regexes.select("regex").distinct().collect()] if isinstance(regexes, DataFrame) else list(regexes)
    by_length: dict[int, list[str]] = {}
    for r in sorted({r for r in listed if r is not None}):
        by_length.setdefault(0 if legacy else len(r.split()), []).append(r)
    for n, same in sorted(by_length.items()):
        hit = F.lit(False)
        for r in same:
            hit = hit | F.col("candidate").rlike(f"^(?:{r})" if legacy else f"^(?:{r})\\z")
        # a null candidate goes
        candidates = candidates.where(~(hit if legacy else (F.col("n") == n) & hit))
    return candidates


def exclude_known(candidates: DataFrame, known: DataFrame, column: str = "term") -> DataFrame:
    """Candidates that are not among ``known``, by exact spelling."""
    return candidates.join(known.select(F.col(column).alias("candidate")), "candidate", "left_anti")


def select_unigrams(candidates: DataFrame, position: int = -1) -> DataFrame:
    """Single words at ``position`` of the candidates (-1: last), with the sum of their values."""
    w = F.col("__w")
    at = F.get(w, F.size(w) + position if position < 0 else F.lit(position))
    return (
        candidates.withColumn("__w", words(F.col("candidate")))
        .select(at.alias("candidate"), "value")
        .where(F.col("candidate").isNotNull())
        .groupBy("candidate")
        .agg(F.sum("value").alias("value"))
        .select("candidate", F.lit(1).alias("n"), F.lit("freq").alias("measure"), "value")
    )


def lemmatize(candidates: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Candidates with each word replaced by its lemma (``lemmas``: form, lemma; unknown words stay), values summed."""
    ids = candidates.where(F.col("candidate").isNotNull()).groupBy("candidate", "measure").agg(F.sum("value").alias("value"))
    per_word = ids.select("candidate", F.posexplode(words(F.col("candidate"))).alias("pos", "form"))
    known = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    spelt = (
        per_word.join(known, "form", "left")
        .groupBy("candidate")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("lemma", "form").alias("w")))).alias("ws"))
        .select("candidate", F.array_join(F.col("ws.w"), " ").alias("lemma_term"))
    )
    return (
        ids.join(spelt, "candidate")
        .groupBy(F.col("lemma_term").alias("candidate"), "measure")
        .agg(F.sum("value").alias("value"))
        .select("candidate", F.size(words(F.col("candidate"))).alias("n"), "measure", "value")
    )


def top(candidates: DataFrame, limit: int | None = 20, *, seed: int | None = None) -> DataFrame:
    """Best candidates first, ties by spelling, or in a random order that ``seed`` fixes for each spelling."""
    tie = [] if seed is None else [F.xxhash64(F.lit(seed), "candidate")]
    ordered = candidates.orderBy(F.desc("value"), *tie, "candidate")
    return ordered if limit is None else ordered.limit(limit)


def length_between(terms: DataFrame, column: str, nmin: int, nmax: int) -> DataFrame:
    return terms.where(F.size(words(F.col(column))).between(nmin, nmax))
