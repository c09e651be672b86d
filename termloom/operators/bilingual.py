"""Equivalents of terms in another language: parallel segments, phrase tables, term lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.tokens import words
from termloom.runtime import beside


def _term_hits(segments: DataFrame, terms: DataFrame, id_col: str, source: str, term: str) -> DataFrame:
    """id_col, term: the terms that stand in each segment, as characters, case and all.

    Found by equality, then checked in full. A term of several words (between blanks) is
    looked up by its first word, which ends a segment's word, with up to three characters
    behind the blank; a single word by itself, among the parts of a segment's words that
    are as long as some term. So lists of hashes are joined, and each segment makes a few
    for each of its words, whatever the number of terms.
    """
    t = terms.select(F.col(term).alias("term")).where(F.trim("term") != "").distinct()
    blank = F.instr("term", " ")
    t = t.select("term", F.when(blank > 0, F.substring_index("term", " ", 1)).alias("__first"), F.when(blank > 0, F.expr("substring(term, instr(term, ' ') + 1, 3)")).alias("__next"))
    t = t.withColumn("__key", F.when(F.col("__first").isNull(), F.xxhash64("term")).otherwise(F.xxhash64("__first", "__next")))
    shapes = t.agg(
        F.collect_set(F.when(F.col("__first").isNull(), F.length("term"))).alias("__alone"),
        # lengths of first words and of what follows: few
        F.collect_set(F.when(F.col("__first").isNotNull(), F.struct(F.length("__first").alias("f"), F.length("__next").alias("r")))).alias("__pairs"),
    )
    parts = (
        beside(segments.where(F.col(source).isNotNull()).select(F.col(id_col).alias("__id"), F.split(F.col(source), " ", -1).alias("__w")), shapes)
        # what follows each word, three characters of it
        .withColumn("__rest", F.expr("transform(__w, (x, i) -> left(array_join(slice(__w, i + 2, 4), ' '), 3))"))
    )
    alone = F.expr(
        "flatten(transform(array_distinct(__w), x -> flatten(transform(filter(__alone, l -> l <= length(x)), "
        "l -> transform(sequence(1, length(x) - l + 1), i -> xxhash64(substring(x, i, l)))))))"
    )
    several = F.expr(
        "flatten(transform(slice(__w, 1, size(__w) - 1), (x, i) -> transform(filter(__pairs, p -> p.f <= length(x) and p.r <= length(__rest[i])), "
        "p -> xxhash64(right(x, p.f), left(__rest[i], p.r)))))"
    )
    keyed = parts.select("__id", F.explode(F.array_distinct(F.concat(alone, several))).alias("__key"))
    hit = keyed.join(t.select("term", "__key").hint("merge"), "__key").select("__id", "term")
    return (
        hit.join(segments.select(F.col(id_col).alias("__id"), F.col(source).alias("__text")).hint("merge"), "__id")
        .where(F.contains("__text", "term"))
        .select(F.col("__id").alias(id_col), "term")
        .distinct()
    )


def segments_with_terms(pairs: DataFrame, terms: DataFrame, *, id_col: str, source: str, term: str = "term") -> DataFrame:
    """Rows of ``pairs`` (id_col unique) with each term that stands in ``source``, as the column term."""
    hits = _term_hits(pairs, terms, id_col, source, term).withColumnRenamed(id_col, "__id")
    return pairs.join(hits.hint("merge"), F.col(id_col) == F.col("__id")).drop("__id")


def parallel_terms(
    pairs: DataFrame,
    terms: DataFrame,
    *,
    id_col: str,
    source: str,
    target: str,
    term: str = "term",
    shorter: int = 1,
    longer: int = 2,
    stopwords: Iterable[str] = (),
    k: int = 5,
) -> DataFrame:
    """term, translation, frequency, share, rank: the k most frequent target n-grams beside each term.

    A pair (id_col unique) counts where the term stands in its source. n-grams have from
    max(1, n - shorter) to n + longer words, as spelled, and neither begin nor end with a
    stopword. ``share`` is of all the target n-grams counted for the term. Ties are ranked
    by spelling. Null segments have no terms.
    """
    keyed = pairs.select(F.col(id_col).alias("__pair"), F.col(source).alias("__s"), words(F.col(target)).alias("__w"))
    hits = segments_with_terms(keyed, terms, id_col="__pair", source="__s", term=term).withColumn("__n", F.size(words(F.col("term"))))
    bad = sorted(stopwords)
    grams = F.expr(
        f"flatten(transform(filter(sequence(greatest(1, __n - {shorter}), __n + {longer}), n -> n <= size(__w)), "
        "n -> transform(sequence(1, size(__w) - n + 1), i -> slice(__w, i, n))))"
    )
    rows = hits.select("term", F.explode(grams).alias("g"))
    if bad:
        rows = rows.where(~F.element_at("g", 1).isin(bad) & ~F.element_at("g", -1).isin(bad))
    counts = rows.groupBy("term", F.array_join("g", " ").alias("translation")).agg(F.count("*").alias("frequency"))
    total = counts.groupBy("term").agg(F.sum("frequency").alias("__all"))
    return _ranked(
        counts.join(total.hint("merge"), "term").withColumn("share", F.col("frequency") / F.col("__all")).drop("__all"), "term", F.desc("frequency"), "translation", k
    )


def _ranked(df: DataFrame, by: str, order: Column, tie: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, tie))).where(F.col("rank") <= k)


def phrase_table_translations(
    table: DataFrame, terms: DataFrame, *, term: str = "term", shorter: int = 1, longer: int = 1, stopwords: Iterable[str] = (), k: int = 5
) -> DataFrame:
    """term, translation, probability, rank from a phrase table (source, target, probability)."""
    bad = sorted(stopwords)
    w, n = words(F.col("target")), F.size(words(F.col("source")))
    rows = table.join(terms.select(F.col(term).alias("source")).distinct(), "source").where(F.size(w).between(n - shorter, n + longer))
    if bad:
        rows = rows.where(~F.element_at(w, 1).isin(bad) & ~F.element_at(w, -1).isin(bad))
    return _ranked(
        rows.select(F.col("source").alias("term"), F.col("target").alias("translation"), "probability"), "term", F.desc("probability"), "translation", k
    )


def reference_translations(reference: DataFrame, terms: DataFrame, *, term: str = "term") -> DataFrame:
    """term and its translations in a list of pairs (sl_term, tl_term), joined by a comma; null without any."""
    found = reference.groupBy(F.col("sl_term").alias("term")).agg(F.array_join(F.array_sort(F.collect_set("tl_term")), ", ").alias("translations"))
    return terms.select(F.col(term).alias("term")).distinct().join(found, "term", "left")


def compoundify(segments: DataFrame, terms: DataFrame, *, id_col: str, text: str, term: str = "term", joiner: str = "▁", append: bool = False) -> DataFrame:
    """Segments in which the blanks of known terms are ``joiner``; longer terms first. Other segments as they are.

    Terms of one word change nothing. Only terms that stand in a segment, as characters,
    are applied to it. ``id_col`` is unique. With ``append`` the segments that change
    stand beside their originals.
    """
    hits = _term_hits(segments, terms.where(F.contains(F.trim(term), F.lit(" "))), id_col, text, term).groupBy(F.col(id_col).alias("__id")).agg(
        F.array_sort(F.collect_set(F.struct((-F.length("term")).alias("o"), F.col("term").alias("t")))).alias("__terms")
    )
    joined = F.aggregate("__terms", F.col(text), lambda s, x: F.replace(s, x["t"], F.replace(x["t"], F.lit(" "), F.lit(joiner))))
    found = segments.join(hits.hint("merge"), F.col(id_col) == F.col("__id"), "inner" if append else "left")
    changed = found.withColumn(text, F.coalesce(F.when(F.col("__terms").isNotNull(), joined), F.col(text))).drop("__id", "__terms")
    return segments.unionByName(changed) if append else changed
