"""Labels of tokens: annotating known terms, decoding labels, cleaning predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bio_terms(tokens: Column, labels: Column) -> Column:
    """Terms that BIO labels mark: B begins one, I continues an open one, anything else ends it.

    Arrays are read as far as the shorter; null arrays give null.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("open"))
    closed = lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        b = x["label"].startswith("B")
        i = x["label"].startswith("I") & (F.size(s["open"]) > 0)
        return (
            F.when(F.coalesce(i, F.lit(False)), F.struct(s["done"].alias("done"), F.array_append(s["open"], x["token"]).alias("open")))
            .when(F.coalesce(b, F.lit(False)), F.struct(closed(s).alias("done"), F.array(x["token"]).alias("open")))
            .otherwise(F.struct(closed(s).alias("done"), empty.alias("open")))
        )

    size = F.least(F.size(tokens), F.size(labels))
    pairs = F.arrays_zip(F.slice(tokens, 1, size).alias("token"), F.slice(labels, 1, size).alias("label"))
    return F.transform(F.aggregate(pairs, start, step, closed), lambda t: F.array_join(t, " "))


def label_terms(scheme: str = "BIO", stopwords: Iterable[str] = ()) -> Callable[..., Column]:
    """A pandas UDF (tokens, terms) -> labels by longest-first dictionary match.

    A start that is labelled already is skipped. ``scheme`` is BIO or BILOU. Terms of a
    single stopword are skipped; null tokens give null, null terms no label but O.
    """
    stop = frozenset(w.lower() for w in stopwords)

    def annotate(tokens: list[str], terms: list[str] | None) -> list[str]:
        labels = ["O"] * len(tokens)
        low = [t.lower() for t in tokens]
        starts: dict[str, list[int]] = {}
        for i, t in enumerate(low):
            starts.setdefault(t, []).append(i)
        wanted = {tuple(t.lower().split()) for t in (terms or ()) if t and t.strip()}
        for term in sorted(wanted, key=lambda t: (-len(t), t)):
            if len(term) == 1 and term[0] in stop:
                continue
            for i in starts.get(term[0], ()):
                if labels[i] == "O" and tuple(low[i : i + len(term)]) == term:
                    if scheme == "BILOU":
                        labels[i : i + len(term)] = ["U"] if len(term) == 1 else ["B", *["I"] * (len(term) - 2), "L"]
                    else:
                        labels[i : i + len(term)] = ["B", *["I"] * (len(term) - 1)]
        return labels

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def udf(tokens: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else annotate(list(t), None if w is None else list(w)) for t, w in zip(tokens, terms, strict=True)])

    return udf


def clean_predictions(terms: Column, stopwords: Iterable[str]) -> Column:
    """Predicted terms without punctuation round them and stopwords at their ends; empty and pure-punctuation ones go."""
    stop = F.array(*map(F.lit, sorted({w.lower() for w in stopwords} | {"—"})))

    def one(t: Column) -> Column:
        t = F.regexp_replace(t, r"^[\p{P}\p{S}\s&&[^()\[\]]]+|[\p{P}\p{S}\s&&[^()\[\]]]+$", "")
        w = F.filter(F.split(t, r"\s+"), lambda x: x != "")
        good = F.transform(w, lambda x: (~F.array_contains(stop, F.lower(x))).cast("int"))
        first = F.array_position(good, 1)
        last = F.size(w) + 1 - F.array_position(F.reverse(good), 1)
        kept = F.when(first > 0, F.slice(w, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.array().cast("array<string>"))
        joined = F.array_join(kept, " ")
        joined = F.regexp_replace(joined, r"\s*-\s*", "-")
        return F.regexp_replace(F.regexp_replace(joined, r"([(\[])\s+", "$1"), r"\s+([)\]])", "$1")

    return F.filter(F.transform(terms, one), lambda t: (t != "") & ~t.rlike(r"^[,.\-\s]*$"))


def predicted_counts(segments: DataFrame, terms: str) -> DataFrame:
    """Predicted terms as candidates, with how often each was predicted."""
    return (
        segments.select(F.explode(terms).alias("candidate"))
        .where(F.col("candidate") != "")
        .groupBy("candidate")
        .agg(F.count("*").alias("value"))
        .select("candidate", F.size(F.split("candidate", " ")).alias("n"), F.lit("count").alias("measure"), "value")
    )


def align_labels(labels: Column, word_ids: Column, ids: dict[str, int], padding: int = -100, *, expand: bool = False) -> Column:
    """Label ids of subwords: a word's first subword has its label's id, subwords without a word ``padding``.

    Those that continue a word have the id of its label with I for B, or with ``expand`` of
    its label as it is. ``word_ids`` has each subword's word, from 0, or null.
    """
    names = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])

    def label(w: Column, i: Column) -> Column:
        own = F.get(labels, w)
        continues = (i > 0) & F.coalesce(F.get(word_ids, i - 1) == w, F.lit(False))
        inside = own if expand else F.when(own.startswith("B"), F.concat(F.lit("I"), F.substring(own, 2, 1 << 30))).otherwise(own)
        return F.when(w.isNotNull(), F.try_element_at(names, F.when(continues, inside).otherwise(own))).otherwise(F.lit(padding))

    return F.transform(word_ids, label)


def balanced(segments: DataFrame, labels: str, *, size: int = 15_000, negatives: float = 0.15, seed: int = 1) -> DataFrame:
    """A sample of ``size`` segments, the given share of them without any label but O, in random order.

    If there are fewer segments with labels than that asks for, all of them are taken, and
    only so many without that the share holds.
    """
    positive = F.exists(labels, lambda x: x != "O")
    there = segments.where(positive).count()
    wanted = min(size - int(size * negatives), there)
    others = int(size * negatives) if wanted < there or wanted == size - int(size * negatives) else int(there * negatives / (1 - negatives))
    pick = lambda df, k: df.orderBy(F.rand(seed)).limit(k)
    return pick(segments.where(positive), wanted).unionByName(pick(segments.where(~positive), others)).orderBy(F.rand(seed + 1))


def predict(segments: DataFrame, tokens: str, load: Callable[[], Callable[[list[list[str]]], list[list[str]]]]) -> DataFrame:
    """``segments`` with the column labels by a model.

    ``load`` gives the model, a function of token lists to label lists; it is called once
    a task, on the worker. Null tokens have null labels.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            there = batch.notna()
            found = iter(model([list(t) for t in batch[there]]))
            yield pd.Series([next(found) if ok else None for ok in there], dtype=object)

    return segments.withColumn("labels", labelled(tokens))
