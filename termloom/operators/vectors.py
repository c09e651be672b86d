"""Term vectors: nearest neighbours, training and mapping between languages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.runtime import checkpointed


def knn_cosine(
    queries: DataFrame, vectors: DataFrame, *, id_col: str, vector: str, k: int = 10, block: int = 512, at_once: int = 1 << 26, with_self: bool = False
) -> DataFrame:
    """query_id, neighbour_id, cosine, rank: the k nearest vectors of each query, one of the same id left out.

    ``queries`` is a stated query set. It passes the driver ``at_once`` bytes at a time, and
    one scan of the vectors serves each such part, by products of blocks of ``block``
    queries; a task keeps the k best of each batch, and only these are shuffled.
    Vectors that are null, empty, zero or of another length than the query have no
    neighbours. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, neighbour_id {kind}, cosine double"
    rank = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id")

    def scanned(held: list[tuple]) -> DataFrame:
        """One scan of the vectors for the queries held, matrix by matrix."""
        blocks = []
        for size in sorted({len(v) for _, v in held}):
            same = [(i, v) for i, v in held if len(v) == size]
            for at in range(0, len(same), block):
                blocks.append((np.array([i for i, _ in same[at : at + block]]), unit(np.array([v for _, v in same[at : at + block]], np.float64))))
        sent = spark.sparkContext.broadcast(blocks)

        def nearest(batches):
            for b in batches:
                rows = [(i, v) for i, v in zip(b[id_col], b[vector], strict=True) if v is not None and len(v) and np.any(v)]
                for size in {len(v) for _, v in rows}:
                    v_ids = np.array([i for i, v in rows if len(v) == size])
                    mat = unit(np.array([v for _, v in rows if len(v) == size], np.float64)).T
                    for q_ids, q in sent.value:
                        if q.shape[1] != size:
                            continue
                        sims = q @ mat
                        if not with_self:
                            sims[q_ids[:, None] == v_ids[None, :]] = -np.inf
                        order = np.lexsort((np.broadcast_to(v_ids, sims.shape), -sims), axis=1)[:, :k]
                        got = np.take_along_axis(sims, order, axis=1)
                        out = pd.DataFrame({"query_id": np.repeat(q_ids, order.shape[1]), "neighbour_id": v_ids[order].ravel(), "cosine": got.ravel()})
                        yield out[np.isfinite(out["cosine"])]

        found = vectors.select(id_col, vector).mapInPandas(nearest, schema)
        return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

    held, size, parts = [], 0, []
    for i, v in queries.select(id_col, vector).where(F.size(vector) > 0).toLocalIterator():
        if not np.any(v):
            continue
        held.append((i, v))
        size += 8 * len(v)
        if size > at_once:  # what the driver holds is bounded: these are done before more come
            parts.append(checkpointed(scanned(held)))
            held, size = [], 0
    if held or not parts:
        parts.append(scanned(held) if held else spark.createDataFrame([], f"{schema}, rank int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_word2vec(segments: DataFrame, tokens: str, *, size: int = 100, window: int = 5, min_count: int = 1, seed: int = 1) -> DataFrame:
    """word, vector of a Word2Vec model trained on an array column. Values depend on the partitioning."""
    from pyspark.ml.feature import Word2Vec

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, seed=seed, inputCol=tokens, outputCol="__v").fit(segments.where(F.size(tokens) > 0))
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def _mean(df: DataFrame, vector: str) -> np.ndarray:
    row = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    return np.array([r.m for r in row])  # one number per dimension


def supervised_mapping(source: DataFrame, target: DataFrame, seeds: DataFrame, *, reweight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Both sides' vectors (word, vector) in a common space, by a seed dictionary (sl_term, tl_term).

    Vectors are normalised, centred and normalised again; the seeds' cross-covariance,
    a matrix of the vectors' width, is summed by Spark and decomposed on the driver; its
    factors rotate each side, and singular values weight the dimensions.
    """
    def normed(c: str):
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        return F.when(norm > 0, F.transform(c, lambda x: x / norm)).otherwise(F.col(c))

    def prepared(df: DataFrame) -> DataFrame:
        once = df.select("word", F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(F.size("vector") > 0)
        once = once.withColumn("vector", normed("vector"))
        mean = F.array(*[F.lit(float(x)) for x in _mean(once, "vector")])
        return once.withColumn("vector", F.zip_with("vector", mean, lambda a, b: a - b)).withColumn("vector", normed("vector"))

    s, t = prepared(source), prepared(target)
    paired = (
        seeds.select("sl_term", "tl_term").distinct()
        .join(s.select(F.col("word").alias("sl_term"), F.col("vector").alias("__s")), "sl_term")
        .join(t.select(F.col("word").alias("tl_term"), F.col("vector").alias("__t")), "tl_term")
    )
    def gram(batches):
        total = None
        for b in batches:
            if len(b):
                part = np.array(b["__s"].tolist()).T @ np.array(b["__t"].tolist())
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"m": [total.ravel().tolist()]})

    sums = paired.select("__s", "__t").mapInPandas(gram, "m array<double>")
    cells = sums.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # width squared
    if not cells:
        raise ValueError("no seed pair has vectors on both sides")
    width = int(round(len(cells) ** 0.5))
    u, sv, vt = np.linalg.svd(np.array([c.x for c in cells]).reshape(width, width))

    def turn(df: DataFrame, m: np.ndarray) -> DataFrame:
        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rotated(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.array(v.tolist()) @ m)) if len(v) else v

        return df.select("word", rotated("vector").alias("vector"))

    return turn(s, u * sv**reweight), turn(t, vt.T * sv**reweight)


def comparable_translations(
    source: DataFrame, target: DataFrame, seeds: DataFrame, terms: DataFrame, *, column: str = "term", k: int = 5, reweight: float = 0.5
) -> DataFrame:
    """query_id (a term), neighbour_id (a target word), cosine, rank: nearest target words in the mapped space.

    ``source`` and ``target`` are vectors (word, vector) of two comparable corpora, whose
    many-word terms were joined to one word before training.
    """
    s, t = supervised_mapping(source, target, seeds, reweight=reweight)
    wanted = s.join(terms.select(F.col(column).alias("word")).distinct(), "word")
    return knn_cosine(wanted, t, id_col="word", vector="vector", k=k, with_self=True)
