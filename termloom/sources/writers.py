"""Sinks: candidates, patterns, tagged corpora, vectors, projects."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.candidates import exclude_known
from termloom.operators.linguistic import packed


EXCEL_ROWS = 1_048_576  # of a sheet, the header too


def save_candidates(candidates: DataFrame, path: str, *, only_candidates: bool = False) -> None:
    """Candidates, best first: .txt tab-separated with a header, .csv, .xlsx (on the driver), .parquet; without an ending as .txt."""
    ordered = candidates.orderBy(F.desc("value"), "candidate")
    if only_candidates:
        ordered = ordered.select("candidate")
    kind = os.path.splitext(path)[1] or ".txt"
    if kind == ".txt":
        ordered.write.mode("overwrite").csv(path if path.endswith(".txt") else path + ".txt", sep="\t", header=True)
    elif kind == ".csv":
        ordered.write.mode("overwrite").csv(path, header=True)
    elif kind == ".parquet":
        ordered.write.mode("overwrite").parquet(path)
    elif kind == ".xlsx":
        if candidates.count() >= EXCEL_ROWS:
            raise ValueError(f"a sheet holds {EXCEL_ROWS} rows at most; save as text")
        ordered.toPandas().to_excel(path, index=False)
    else:
        raise ValueError(f"unknown kind of file {kind!r}")


def save_term_list(candidates: DataFrame, path: str, *, limit: int | None = None, known: DataFrame | None = None) -> None:
    """The first ``limit`` candidates, then without those known, as ``value TAB candidate`` lines."""
    ordered = candidates.orderBy(F.desc("value"), "candidate")
    ordered = ordered if limit is None else ordered.limit(limit)
    if known is not None:
        ordered = exclude_known(ordered, known)
    ordered.orderBy(F.desc("value"), "candidate").select(F.concat_ws("\t", F.col("value").cast("string"), "candidate")).write.mode("overwrite").text(path)


def save_patterns(patterns: DataFrame, path: str) -> None:
    """Tab-separated, the most frequent first, below the header ``term TAB frequency``."""
    header = patterns.sparkSession.createDataFrame([("term", None)], "pattern string, frequency long")
    # a row a sequence of tags, so one file; as text, since CSV would quote what begins with #
    lines = header.unionByName(patterns.select("pattern", "frequency")).repartition(1).sortWithinPartitions(F.desc_nulls_first("frequency"), "pattern")
    lines.select(F.concat_ws("\t", "pattern", F.coalesce(F.col("frequency").cast("string"), F.lit("frequency")))).write.mode("overwrite").text(path)


def save_tagged(segments: DataFrame, path: str, tagged: str = "tagged") -> None:
    segments.select(F.array_join(packed(F.col(tagged)), " ")).write.mode("overwrite").text(path)


def save_parallel(pairs: DataFrame, path: str, source: str = "segment_sl", target: str = "segment_tl", *, tagged: bool = False) -> None:
    """``source TAB target`` lines, line breaks and tabs as blanks; with ``tagged`` both are tagged arrays."""
    side = lambda c: F.array_join(packed(F.col(c)), " ") if tagged else F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]", " ")
    pairs.select(F.concat_ws("\t", side(source), side(target))).write.mode("overwrite").text(path)


def save_embeddings(vectors: DataFrame, path: str, *, header: bool = True) -> None:
    """``word x1 x2 ...`` lines, six significant digits, below a line with the number of words and the width."""
    text = F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vector", lambda x: F.format_string("%.6g", x.cast("double"))), " "))
    lines = vectors.select(text.alias("value"))
    if header:
        size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("w"))
        lines = size.coalesce(1).select(F.concat_ws(" ", F.col("n").cast("string"), F.col("w").cast("string")).alias("value")).unionByName(lines)
    lines.write.mode("overwrite").text(path)


def save_annotated(positive: DataFrame, negative: DataFrame, path: str, *, most: int = 12_000, seed: int = 1) -> None:
    """At most ``most`` positive and all negative segments, shuffled, as JSON lines."""
    positive.orderBy(F.rand(seed)).limit(most).unionByName(negative).orderBy(F.rand(seed + 1)).write.mode("overwrite").json(path)


class Project:
    """Tables of a project, kept as Parquet below a folder."""

    def __init__(self, spark: SparkSession, path: str, *, overwrite: bool = False):
        self.spark, self.path, self.overwrite = spark, path, overwrite

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def put(self, table: str, df: DataFrame, mode: str | None = None) -> DataFrame:
        """Writes a table; without ``overwrite`` an existing one is kept, unless ``mode`` says otherwise."""
        df.write.mode(mode or ("overwrite" if self.overwrite else "ignore")).parquet(self._at(table))
        return self.get(table)

    def get(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._at(table))

    def add_absent(self, table: str, df: DataFrame) -> DataFrame:
        """Appends the rows that aren't there."""
        new = df.distinct().join(self.get(table), df.columns, "left_anti")
        new.write.mode("append").parquet(self._at(table))
        return self.get(table)

    def delete(self, table: str, rows: DataFrame | None = None) -> None:
        """Empties a table, or deletes rows by the columns of ``rows``."""
        old = self.get(table)
        kept = old.limit(0) if rows is None else old.join(rows, rows.columns, "left_anti")
        staged = self._at(f"_{table}.new")
        kept.write.mode("overwrite").parquet(staged)  # a table can't be read and overwritten at once
        self.spark.read.parquet(staged).write.mode("overwrite").parquet(self._at(table))
        at = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def populated(self, table: str) -> bool:
        return not self.get(table).isEmpty()
