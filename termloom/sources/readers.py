"""Readers. All give DataFrames; none reads a file on the driver but where said."""

from __future__ import annotations

import contextlib
import re
import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.functions.stopwords import OUTER, inner, language_code, outer
from termloom.functions.tokens import words

Paths = str | list[str]


def corpus(spark: SparkSession, paths: Paths) -> DataFrame:
    """seg_id, segment: one segment a line, trailing white space removed. Ids follow files and lines."""
    return (
        spark.read.text(paths)
        .select(F.monotonically_increasing_id().alias("seg_id"), F.regexp_replace("value", r"(?U)\s+\z", "").alias("segment"))
    )


def compound_corpus(spark: SparkSession, paths: Paths, terms: DataFrame, term: str = "term") -> DataFrame:
    """:func:`corpus` with the blanks of known terms joined."""
    from termloom.operators.bilingual import compoundify

    return compoundify(corpus(spark, paths), terms, id_col="seg_id", text="segment", term=term)


def word_set(spark: SparkSession, path: str) -> frozenset[str]:
    """Words of a stopword file, one a line; such files are small and come to the driver."""
    return frozenset(r.w for r in spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+\z", "").alias("w")).where("w <> ''").collect())


def stopwords(language: str, *, punctuation: bool = False) -> tuple[frozenset[str], frozenset[str]]:
    """The outer and inner lists of a language; with ASCII punctuation where asked for."""
    extra = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") if punctuation else frozenset()
    return outer(language) | extra, inner(language) | extra


def stopword_table(spark: SparkSession) -> DataFrame:
    """lang, word, kind of all built-in lists."""
    rows = [(c, w, kind) for c in OUTER for kind, ws in (("outer", outer(c)), ("inner", inner(c))) for w in sorted(ws)]
    return spark.createDataFrame(rows, "lang string, word string, kind string")


def terms(spark: SparkSession, source: Paths | list[str], *, is_file: bool = True, nmin: int = 1, nmax: int | None = None, distinct: bool = False) -> DataFrame:
    """term: one a line, or of a list. Blank lines are left out; lengths are in words."""
    df = spark.read.text(source) if is_file else spark.createDataFrame([(t,) for t in source], "value string")
    out = df.select(F.regexp_replace("value", r"(?U)^\s+|\s+\z", "").alias("term")).where("term <> ''")
    n = F.size(words(F.col("term")))
    out = out.where((n >= nmin) & (n <= nmax if nmax is not None else F.lit(True)))
    return out.distinct() if distinct else out


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """pattern, frequency of a tab-separated file; a first line that holds "frequency" is its header.

    There is a row for each sequence of tags, so a file is taken as one row.
    """
    parts = F.split("value", "\t")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
        .where((F.trim("value") != "") & ~((F.col("at") == 0) & F.lower("value").contains("frequency")))
        .select(F.get(parts, F.lit(0)).alias("pattern"), F.get(parts, F.lit(1)).try_cast("long").alias("frequency"))
    )


def annotated_jsonl(spark: SparkSession, paths: Paths) -> DataFrame:
    """segment, terms of JSON lines; broken lines give nulls."""
    return spark.read.schema("segment string, terms array<string>").json(paths)


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Lines with their position in the file: that in their split, and the lines of the splits before it."""
    place = F.monotonically_increasing_id()
    lines = df.select(F.shiftright(place, 33).alias("__split"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("__line"), F.col("value").alias(name))
    before = Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("__split").agg(F.count("*").alias("__n"))  # a row a split
    starts = counts.select("__split", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return lines.join(F.broadcast(starts), "__split").select((F.col("__start") + F.col("__line")).alias("id"), name)


def parallel_moses(spark: SparkSession, source: str, target: str) -> DataFrame:
    """id, segment_sl, segment_tl of two files aligned by line."""
    return _numbered(spark.read.text(source), "segment_sl").join(_numbered(spark.read.text(target), "segment_tl"), "id")


def parallel_tabtxt(spark: SparkSession, paths: Paths, *, reverse: bool = False) -> DataFrame:
    """segment_sl, segment_tl of tab-separated lines of two fields or more."""
    p = F.split("value", "\t")
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    a, b = (b, a) if reverse else (a, b)
    return spark.read.text(paths).where(F.size(p) >= 2).select(a.alias("segment_sl"), b.alias("segment_tl"))


def _xml(spark: SparkSession, paths: Paths, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(schema).load(paths if isinstance(paths, str) else ",".join(paths))


def parallel_tmx(spark: SparkSession, paths: Paths, sl: str, tl: str) -> DataFrame:
    """segment_sl, segment_tl of a TMX file; languages by their leading code. The last unit counts too."""
    df = _xml(spark, paths, "tu", "tuv array<struct<_lang string, seg string>>")
    pick = lambda code: F.get(F.filter("tuv", lambda u: F.lower(u["_lang"]).startswith(code.lower())), F.lit(0))["seg"]
    return df.select(pick(sl).alias("segment_sl"), pick(tl).alias("segment_tl")).where("segment_sl is not null and segment_tl is not null")


def parallel_sdltm(spark: SparkSession, path: str, *, batch: int = 20_000) -> DataFrame:
    """segment_sl, segment_tl of an SDLTM translation memory, an SQLite file that all executors can open.

    Only the range of row ids comes to the driver; each task reads a range of ``batch`` ids.
    """
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        low, high = db.execute("SELECT min(rowid), max(rowid) FROM translation_units").fetchone()
    schema = "segment_sl string, segment_tl string"
    if low is None:
        return spark.createDataFrame([], schema)

    def read(batches):
        text = lambda x: " ".join(re.findall(r"<Value>([^<]*)</Value>", x or "")).replace("\n", " ").strip()
        with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
            for b in batches:
                for at in b["id"]:
                    rows = db.execute("SELECT source_segment, target_segment FROM translation_units WHERE rowid >= ? AND rowid < ?", (int(at), int(at) + batch))
                    pairs = [(text(x), text(y)) for x, y in rows]
                    yield pd.DataFrame([p for p in pairs if all(p)], columns=["segment_sl", "segment_tl"], dtype=object)

    starts = spark.range(low, high + 1, batch)
    return starts.repartition(min(256, starts.count())).mapInPandas(read, schema)


TAGGED_COLUMNS = {"freeling": (0, 1, 2), "conll": (1, 2, 3)}


def tagged_corpus(spark: SparkSession, paths: Paths, fmt: str = "packed") -> DataFrame:
    """seg_id, tagged (array of form, lemma, pos).

    ``packed``: a segment a line, tokens ``form|lemma|pos`` between white space.
    ``freeling`` and ``conll``: a token a line, a blank line ends a segment; the last
    segment counts even without one. Files are split at empty lines.
    """
    shape = "array<struct<form string, lemma string, pos string>>"
    if fmt == "packed":
        parts = lambda t: F.split(t, r"\|")
        token = lambda t: F.struct(*[F.get(parts(t), F.lit(i)).alias(n) for i, n in enumerate(("form", "lemma", "pos"))])
        return (
            spark.read.text(paths)
            .where(F.trim("value") != "")
            .select(F.monotonically_increasing_id().alias("seg_id"), F.transform(words(F.col("value")), token).cast(shape).alias("tagged"))
        )
    cols = TAGGED_COLUMNS[fmt]
    field = lambda line, i: F.get(F.split(line, r"[ \t]+"), F.lit(i))
    blocks = spark.read.text(paths, lineSep="\n\n").select(F.explode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: F.trim(x) != "")
    token = lambda x: F.struct(*[field(x, c).alias(n) for c, n in zip(cols, ("form", "lemma", "pos"), strict=True)])
    return (
        blocks.select(F.filter(F.transform(lines, token), lambda t: t["form"].isNotNull()).cast(shape).alias("tagged"))
        .where(F.size("tagged") > 0)
        .select(F.monotonically_increasing_id().alias("seg_id"), "tagged")
    )


def term_pairs_tabtxt(spark: SparkSession, paths: Paths, *, nmin: int = 1, nmax: int = 100, reverse: bool = False) -> DataFrame:
    """sl_term, tl_term of tab-separated lines; a missing target is ``_``."""
    p = F.split("value", "\t")
    a, b = F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)), F.lit("_"))
    a, b = (b, a) if reverse else (a, b)
    out = spark.read.text(paths).where(F.trim("value") != "").select(a.alias("sl_term"), b.alias("tl_term"))
    return out.where(F.size(words(F.col("sl_term"))).between(nmin, nmax))


def term_pairs_csv(spark: SparkSession, paths: Paths, *, source_column: int = 1, target_column: int = 2, sep: str = ",") -> DataFrame:
    """sl_term, tl_term of the given columns, counted from 1."""
    df = spark.read.csv(paths, sep=sep, escape='"')  # quotes are doubled
    return df.select(F.col(df.columns[source_column - 1]).alias("sl_term"), F.col(df.columns[target_column - 1]).alias("tl_term"))


def term_pairs_excel(spark: SparkSession, path: str) -> DataFrame:
    """sl_term, tl_term of columns A and B of every sheet; needs openpyxl, and reads on the driver."""
    sheets = pd.read_excel(path, sheet_name=None, header=None, usecols=[0, 1], dtype=str)
    rows = [tuple(r) for s in sheets.values() for r in s.itertuples(index=False)]
    return spark.createDataFrame(rows, "sl_term string, tl_term string")


def validated_terms(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """sl_term, tl_term of pairs that someone has validated."""
    return spark.createDataFrame(pairs, "sl_term string, tl_term string")


def term_pairs_tbx(spark: SparkSession, paths: Paths, sl: str, tl: str, *, entry: str = "conceptEntry", nmin: int = 1, nmax: int = 100) -> DataFrame:
    """sl_term, tl_term of a TBX file: a row per source term, target terms joined by a comma, ``_`` without any."""
    section = "struct<_lang string, termSec array<struct<term string>>, tig array<struct<term string>>, term array<string>>"
    df = _xml(spark, paths, entry, f"langSec array<{section}>, langSet array<{section}>")
    sections = F.concat(F.coalesce("langSec", F.array().cast(f"array<{section}>")), F.coalesce("langSet", F.array().cast(f"array<{section}>")))

    def terms_of(code: str) -> Column:
        own = F.filter("__s", lambda s: F.lower(s["_lang"]).startswith(code.lower()))
        none = F.array().cast("array<string>")
        per = F.transform(
            own,
            lambda s: F.concat(
                F.coalesce(s["termSec"]["term"], none), F.coalesce(s["tig"]["term"], none), F.coalesce(s["term"], none)
            ),
        )
        return F.array_compact(F.flatten(per))

    out = df.withColumn("__s", sections).select(F.explode(terms_of(sl)).alias("sl_term"), F.array_join(terms_of(tl), ", ").alias("tl_term"))
    out = out.withColumn("tl_term", F.when(F.col("tl_term") == "", "_").otherwise(F.col("tl_term")))
    return out.where(F.size(words(F.col("sl_term"))).between(nmin, nmax))


def phrase_table(spark: SparkSession, paths: Paths) -> DataFrame:
    """source, target, probability (p2 * p3) of a Moses phrase table, gzipped or not.

    Rows whose scores don't parse, and sides that begin or end with punctuation, are left out.
    """
    p = F.split("value", r" \|\|\| ")
    scores = F.split(F.trim(F.get(p, F.lit(2))), r"\s+")
    prob = F.get(scores, F.lit(2)).try_cast("double") * F.get(scores, F.lit(3)).try_cast("double")
    edge = r"^\p{Punct}|\p{Punct}$"
    return (
        spark.read.text(paths)
        .select(F.trim(F.get(p, F.lit(0))).alias("source"), F.trim(F.get(p, F.lit(1))).alias("target"), prob.alias("probability"))
        .where(F.col("probability").isNotNull() & ~F.col("source").rlike(edge) & ~F.col("target").rlike(edge))
    )


def embeddings(spark: SparkSession, paths: Paths) -> DataFrame:
    """word, vector of word2vec text; the header of two numbers is left out."""
    p = F.split(F.trim("value"), r"\s+")
    return (
        spark.read.text(paths)
        .where(F.size(p) > 2)
        .select(F.get(p, F.lit(0)).alias("word"), F.slice(p, F.lit(2), F.size(p) - 1).cast("array<float>").alias("vector"))
    )


def language(name: str) -> str:
    return language_code(name)
