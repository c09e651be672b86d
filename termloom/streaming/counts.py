"""Counting terms of a stream of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.tokens import ngram_arrays, tokenize


def streaming_token_frequency(segments: DataFrame, text: str = "segment") -> DataFrame:
    """token, frequency so far; write it in complete or update mode."""
    return segments.select(F.explode(tokenize(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))


def streaming_ngrams(segments: DataFrame, text: str = "segment", *, nmin: int = 2, nmax: int = 3) -> DataFrame:
    """ngram, n, frequency so far. The least frequency, nesting and slots need a snapshot: use foreachBatch."""
    grams = segments.select(tokenize(F.col(text)).alias("t")).select(F.explode(ngram_arrays("t", nmin, nmax)).alias("g"))
    return grams.groupBy(F.array_join("g.gram", " ").alias("ngram"), F.col("g.n").alias("n")).agg(F.count("*").alias("frequency"))


def windowed_token_frequency(segments: DataFrame, time: str, text: str = "segment", *, window: str = "1 hour", late: str = "2 days") -> DataFrame:
    """token and frequency per window of event time; rows later than ``late`` are left out of windows that are closed."""
    return (
        segments.withWatermark(time, late)
        .select(F.window(time, window).alias("window"), F.explode(tokenize(F.col(text))).alias("token"))
        .groupBy("window", "token")
        .agg(F.count("*").alias("frequency"))
    )
