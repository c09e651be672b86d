"""Tagged corpora: tagging, n-grams, learning patterns and matching them.

A tagged segment is an array of structs (form, lemma, pos).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.patterns import captures, translate_pattern
from termloom.functions.tokens import ngram_arrays
from termloom.runtime import beside

# Endings and the tag they give; a stand-in for a tagger's model. First match wins.
SUFFIXES = (
    (r"^\p{N}", "NUM"),
    (r"(?:ly|mente|ment)$", "ADV"),
    (r"(?:tion|sion|ment|ness|ity|ism|ung|heit|keit|ción|dad|té|or|er|ist)$", "NOUN"),
    (r"(?:al|ic|ive|ous|able|ible|ary|isch|ische|lich|ico|ica|ique|iquet)$", "ADJ"),
    (r"(?:ing|ed|es|ize|ise|iert)$", "VERB"),
)


_ENDINGS = [(re.compile(p.replace(r"\p{N}", r"\d")), tag) for p, tag in SUFFIXES]


def suffix_pos(form: Column) -> Column:
    """A part of speech by the ending alone; deterministic, and no model."""
    low = F.lower(form)
    tag = F.lit("NOUN")
    for pattern, pos in reversed(SUFFIXES):
        tag = F.when(low.rlike(pattern), pos).otherwise(tag)
    return tag


def suffix_lemma(form: Column) -> Column:
    return F.regexp_replace(F.lower(form), r"(?<=\w{3})s$", "")


def tag_tokens(tokens: Column, *, pos: Callable[[Column], Column] = suffix_pos, lemma: Callable[[Column], Column] = suffix_lemma) -> Column:
    """Tagged array of an array of tokens; ``pos`` and ``lemma`` may be any column functions, a model's pandas UDF too."""
    return F.transform(tokens, lambda t: F.struct(t.alias("form"), lemma(t).alias("lemma"), pos(t).alias("pos")))


def tag_with(segments: DataFrame, tokens: str, load: Callable[[], Callable[[list[str]], list[tuple[str, str, str]]]]) -> DataFrame:
    """``segments`` with the column tagged (form, lemma, pos) by a model.

    ``load`` gives the tagger, a function of a segment's tokens to (form, lemma, pos); it is
    called once a task, on the worker. Null tokens have null tags.
    """
    shape = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("form", "lemma", "pos")]))

    @F.pandas_udf(shape)
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = load()
        for batch in batches:
            yield pd.Series([None if t is None else [dict(zip(("form", "lemma", "pos"), x, strict=True)) for x in tagger(list(t))] for t in batch], dtype=object)

    return segments.withColumn("tagged", tagged(tokens))


class DictionaryTagger:
    """Lemma and part of speech of the forms in ``entries`` (form: lemma, pos), else by ending.

    A form that isn't there as spelled is looked up in lower case.
    """

    def __init__(self, entries: dict[str, tuple[str, str]]):
        self.entries = entries

    def __call__(self, tokens: list[str]) -> list[tuple[str, str, str]]:
        out = []
        for form in tokens:
            known = self.entries.get(form) or self.entries.get(form.lower())
            if known is None:
                low = form.lower()
                known = low, next((pos for pattern, pos in _ENDINGS if pattern.search(low)), "NOUN")
            out.append((form, *known))
        return out


def packed(tagged: Column) -> Column:
    """Tokens as ``form|lemma|pos``; a missing tag is UNK."""
    return F.transform(tagged, lambda t: F.concat_ws("|", t["form"], t["lemma"], F.coalesce(t["pos"], F.lit("UNK"))))


def tagged_ngrams(segments: DataFrame, tagged: str = "tagged", *, nmin: int = 2, nmax: int = 3, minfreq: int = 2) -> DataFrame:
    """ngram (forms), tagged_ngram, n, frequency; n-grams that differ in tags only are rows of their own."""
    return (
        segments.withColumn("__packed", packed(F.col(tagged)))
        .where(F.size("__packed") >= nmin)
        .select(F.explode(ngram_arrays("__packed", nmin, nmax)).alias("g"))
        .select(F.array_join("g.gram", " ").alias("tagged_ngram"), F.col("g.n").alias("n"))
        .groupBy("tagged_ngram", "n")
        .agg(F.count("*").alias("frequency"))
        .where(F.col("frequency") >= minfreq)
        .select(
            F.array_join(F.transform(F.split("tagged_ngram", " "), lambda t: F.get(F.split(t, r"\|"), F.lit(0))), " ").alias("ngram"),
            "tagged_ngram",
            "n",
            "frequency",
        )
    )


def stopword_filter_tagged(ngrams: DataFrame, outer: Iterable[str]) -> DataFrame:
    """Drops tagged n-grams whose first or last lemma is a stopword, and blank ones."""
    def lemma(i: Column) -> Column:
        parts = F.split(F.get("__t", i), r"\|")
        return F.lower(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))))

    bad = sorted(outer)
    kept = ngrams.withColumn("__t", F.split("tagged_ngram", " ")).where(F.trim("tagged_ngram") != "")
    if bad:
        kept = kept.where(~lemma(F.lit(0)).isin(bad) & ~lemma(F.size("__t") - 1).isin(bad))
    return kept.drop("__t")


def learn_patterns(ngrams: DataFrame, evaluation_terms: DataFrame, column: str = "term") -> DataFrame:
    """pattern, frequency of the tagged n-grams whose forms are an evaluation term.

    Repeated evaluation terms count as often as they stand there.
    """
    terms = evaluation_terms.groupBy(F.col(column).alias("ngram")).agg(F.count("*").alias("__times"))
    token = lambda t: F.split(t, r"\|")
    piece = lambda t: F.when(
        F.get(token(t), F.lit(0)) == F.get(token(t), F.lit(1)), F.concat(F.lit("|#|"), F.coalesce(F.get(token(t), F.lit(2)), F.lit("UNK")))
    ).otherwise(F.concat(F.lit("#||"), F.coalesce(F.get(token(t), F.lit(2)), F.lit("UNK"))))
    return (
        ngrams.join(terms, "ngram")
        .select(
            F.array_join(F.transform(F.split("tagged_ngram", " "), piece), " ").alias("pattern"),
            (F.col("frequency") * F.col("__times")).alias("frequency"),
        )
        .groupBy("pattern")
        .agg(F.sum("frequency").alias("frequency"))
    )


def representative(patterns: DataFrame, percent: float = 90) -> DataFrame:
    """The most frequent patterns, until those before one hold more than ``percent`` of all.

    Patterns are few (one per sequence of tags), so one ordered window is enough.
    """
    before = Window.orderBy(F.desc("frequency"), "pattern").rowsBetween(Window.unboundedPreceding, -1)
    total = patterns.agg(F.sum("frequency").alias("__total"))
    return (
        beside(patterns.withColumn("__before", F.coalesce(F.sum("frequency").over(before), F.lit(0))), total)
        .where(F.col("__before") * 100 <= percent * F.col("__total"))
        .drop("__before", "__total")
    )


def match_patterns(ngrams: DataFrame, patterns: list[str]) -> DataFrame:
    """Candidates of the tagged n-grams that a pattern matches in full; of several patterns the first wins.

    A candidate is what the pattern captures, joined by blanks; equal ones are summed.
    """
    regexes = {p: translate_pattern(p) for p in dict.fromkeys(patterns)}
    found = F.lit(None).cast("string")
    for pattern, regex in reversed(regexes.items()):
        full = f"^{regex}\\z"
        hit = F.col("tagged_ngram").rlike(full)
        if re.fullmatch(r"[\w#|.* ]+", pattern):  # fields that hold no blank: as many words as the pattern has
            hit = (F.col("n") == len(pattern.split())) & hit
        captured = F.regexp_replace("tagged_ngram", full, " ".join(f"${i + 2}" for i in range(captures(regex))))
        found = F.when(hit, captured).otherwise(found)
    return (
        ngrams.select(found.alias("candidate"), "frequency")
        .where(F.col("candidate").isNotNull() & (F.col("candidate") != ""))
        .groupBy("candidate")
        .agg(F.sum("frequency").alias("value"))
        .select("candidate", F.size(F.split("candidate", " ")).alias("n"), F.lit("frequency").alias("measure"), "value")
    )


def match_learned(ngrams: DataFrame, learned: DataFrame) -> DataFrame:
    """As :func:`match_patterns` with the patterns of :func:`learn_patterns` (pattern, frequency), the most frequent first.

    A learned pattern takes any form and lemma, so the first one with an n-gram's sequence
    of tags is the one that matches. Both are joined by that sequence; any number of
    patterns will do.
    """
    ranked = Window.partitionBy("__tags").orderBy(F.desc("frequency"), "pattern")
    first = (
        learned.withColumn("__tags", F.array_join(F.transform(F.split("pattern", " "), lambda x: F.get(F.split(x, r"\|"), F.lit(2))), " "))
        .withColumn("__rank", F.row_number().over(ranked))
        .where("__rank = 1")
        .select("__tags", F.transform(F.split("pattern", " "), lambda x: F.startswith(x, F.lit("|#|"))).alias("__lemmas"))
    )
    field = r"^(.+?)\|(.+?)\|[^|]*$"
    values = F.transform("__t", lambda x, i: F.when(F.get("__lemmas", i), F.regexp_extract(x, field, 2)).otherwise(F.regexp_extract(x, field, 1)))
    tags = F.array_join(F.transform("__t", lambda x: F.coalesce(F.get(F.split(x, r"\|"), F.lit(2)), F.lit("UNK"))), " ")
    return (
        ngrams.withColumn("__t", F.split("tagged_ngram", " "))
        .withColumn("__tags", tags)
        .join(first, "__tags")
        .select(values.alias("__values"), "frequency")
        .where(~F.array_contains("__values", ""))
        .groupBy(F.array_join("__values", " ").alias("candidate"))
        .agg(F.sum("frequency").alias("value"))
        .select("candidate", F.size(F.split("candidate", " ")).alias("n"), F.lit("frequency").alias("measure"), "value")
    )


def normalize_declension(tagged: Column) -> Column:
    """A tagged term with lemmas for forms; a noun after a noun keeps its form, a single all-capital word stays."""

    def one(t: Column, i: Column) -> Column:
        after_noun = (t["pos"] == "NOUN") & F.coalesce(F.get(tagged, i - 1)["pos"] == "NOUN", F.lit(False)) & (i > 0)
        capitals = (F.size(tagged) == 1) & (F.upper(t["form"]) == t["form"])
        return F.when(after_noun | capitals, t["form"]).otherwise(F.coalesce(t["lemma"], t["form"]))

    return F.array_join(F.transform(tagged, one), " ")


def upsert(rows: DataFrame, updates: DataFrame, id_col: str) -> DataFrame:
    """``rows`` with the columns of ``updates`` where it has the id, and its new ids; columns missing on one side are null."""
    both = rows.alias("o").join(updates.alias("u"), id_col, "full")
    shared = [c for c in updates.columns if c in rows.columns and c != id_col]
    cols = [F.col(id_col)]
    cols += [F.coalesce(F.col(f"u.{c}"), F.col(f"o.{c}")).alias(c) for c in shared]
    cols += [F.col(f"o.{c}") for c in rows.columns if c not in updates.columns]
    cols += [F.col(f"u.{c}") for c in updates.columns if c not in rows.columns]
    return both.select(*cols)
