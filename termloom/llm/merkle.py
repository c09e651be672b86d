"""Duplicates hidden by formatting: bottom-up hashing of nested records.

A record's digest is built from its leaves up: leaves are normalised and hashed, the
children of an unordered node (struct, map, and arrays where asked for) are sorted by
their digests, and a node's digest is the hash of its children's. Everything is one
column expression made from the schema. The same walk without hashing gives the
canonical form, by which records of one digest are compared in full.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm.skew import grid_join
from termloom.llm.text import letters_and_digits
from termloom.runtime import checkpointed

Leaf = Callable[[Column, T.DataType], Column]

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def plain_leaf(c: Column, kind: T.DataType, compose: bool = True) -> Column:
    """Strings by letters and digits, numbers by value, everything else as Spark writes it."""
    if isinstance(kind, T.StringType):
        return letters_and_digits(c, compose=compose)
    if isinstance(kind, T.NumericType):
        return (c.cast("double") + F.lit(0.0)).cast("string")  # -0.0 becomes 0.0
    return c.cast("string")


def _walk(c: Column, kind: T.DataType, leaf: Leaf, rules: dict[str, Leaf], unordered: frozenset[str], path: str, close) -> Column:
    if isinstance(kind, T.StructType):
        children = [
            F.concat(
                F.lit(f.name + "="),
                _walk(c.getField(f.name), f.dataType, leaf, rules, unordered, f"{path}.{f.name}".lstrip("."), close),
            )
            for f in kind.fields
        ]
        return F.coalesce(F.when(c.isNotNull(), close("{", F.array_sort(F.array(*children)) if children else F.array())), F.lit("0"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: _walk(x, kind.elementType, leaf, rules, unordered, path + "[]", close))
        node = close("[", F.array_sort(items)) if path in unordered else close("(", items)
        return F.coalesce(node, F.lit("0"))
    if isinstance(kind, T.MapType):
        items = F.transform(
            F.map_entries(c),
            lambda e: F.concat(
                _walk(e["key"], kind.keyType, leaf, rules, unordered, path + "{key}", close),
                F.lit("="),
                _walk(e["value"], kind.valueType, leaf, rules, unordered, path + "{}", close),
            ),
        )
        return F.coalesce(close("{", F.array_sort(items)), F.lit("0"))
    rule = rules.get(path, leaf)
    # within arrays and maps stands a lambda, which can't hold a Python function: such columns come composed
    text = plain_leaf(c, kind, compose=not re.search(r"[\[{]", path)) if rule is plain_leaf else rule(c, kind)
    return F.coalesce(close("'", F.array(text)), F.lit("0"))


def _hashed(tag: str, children: Column) -> Column:
    return F.md5(F.concat(F.lit(tag), F.array_join(children, "\x1f")))


def _spelt(tag: str, children: Column) -> Column:
    # each child behind its length: nothing is escaped, however deep it lies
    return F.concat(F.lit(tag), F.array_join(F.transform(children, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ""), F.lit(tag))


def _nested_strings(kind: T.DataType, within: bool = False) -> bool:
    """Whether strings lie within an array or map."""
    if isinstance(kind, T.StringType):
        return within
    if isinstance(kind, T.StructType):
        return any(_nested_strings(f.dataType, within) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _nested_strings(kind.elementType, True)
    if isinstance(kind, T.MapType):
        return _nested_strings(kind.keyType, True) or _nested_strings(kind.valueType, True)
    return False


def _composed_nested(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the strings within arrays and maps of ``columns`` in composed form: a pass over whole columns, where there are any."""

    def compose(x):
        if isinstance(x, str):
            return x if x.isascii() else unicodedata.normalize("NFC", x)
        if isinstance(x, dict):
            return {compose(k): compose(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [compose(v) for v in x]
        return x

    nested = [c for c in columns if _nested_strings(df.schema[c].dataType)]
    if not nested:
        return df

    def run(batches):
        for b in batches:
            done = [pa.array([compose(v) for v in b.column(i).to_pylist(maps_as_pydicts="lossy")], b.schema.field(i).type) if b.schema.names[i] in nested else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(done, schema=b.schema)

    return df.mapInArrow(run, df.schema)


def root_digest(df: DataFrame, columns: list[str], *, leaf: Leaf = plain_leaf, rules: dict[str, Leaf] | None = None, unordered: set[str] = frozenset()) -> Column:
    """128-bit digest of the record made of ``columns``; their order doesn't matter."""
    return _record(df, columns, leaf, rules or {}, frozenset(unordered), _hashed)


def canonical_form(df: DataFrame, columns: list[str], *, leaf: Leaf = plain_leaf, rules: dict[str, Leaf] | None = None, unordered: set[str] = frozenset()) -> Column:
    """The record as it is compared, spelt out; equal exactly where records are the same."""
    return _record(df, columns, leaf, rules or {}, frozenset(unordered), _spelt)


def _record(df, columns, leaf, rules, unordered, close) -> Column:
    parts = [
        F.concat(F.lit(n + "="), _walk(F.col(n), df.schema[n].dataType, leaf, rules, unordered, n, close)) for n in columns
    ]
    return close("{", F.array_sort(F.array(*parts)))


def copy_classes(df: DataFrame, *, by: list[str], id_col: str, columns: list[str], **options) -> DataFrame:
    """One row per class of records that are the same: by, keep_id, copies, digest.

    Records are compared within equal ``by``. keep_id is the smallest id. Nulls are
    values: a null leaf equals a null leaf only. Every record is in one class. A class
    with a third of all rows is summed on the map side; it never meets in one task.
    """
    return _classes(_digested(df, by, id_col, columns, options), by)


def _digested(df, by, id_col, columns, options) -> DataFrame:
    return _composed_nested(df.select(*dict.fromkeys([*by, id_col, *columns])), columns).select(
        *by,
        F.col(id_col).alias("__id"),
        root_digest(df, columns, **options).alias("digest"),
        canonical_form(df, columns, **options).alias("__form"),
    )


def _classes(digested: DataFrame, by: list[str]) -> DataFrame:
    # the digest places the rows, the form in the key is the full comparison
    return digested.groupBy(*by, "digest", "__form").agg(F.min("__id").alias("keep_id"), F.count("*").alias("copies"))


def copies(df: DataFrame, *, by: list[str], id_col: str, columns: list[str], hot_class: int = 100_000, **options) -> DataFrame:
    """Every record but the first of its class: by, keep_id, copy_id.

    Classes of one record leave no row. Digests and canonical forms are made once. Those
    records that share a digest with another are put to their class by the digest and its
    first record; the canonical form, compared in full when classes are made, tells apart
    classes of one digest. Classes of more than ``hot_class`` records are split.
    """
    digested = checkpointed(_digested(df, by, id_col, columns, options))
    classes = _classes(digested, by).select(*by, "digest", F.col("__form").alias("__kept_form"), "keep_id", "copies")
    kept = checkpointed(classes.where(F.col("copies") > 1).drop("copies"))
    met = grid_join(digested, kept, [*by, "digest"], left_id="__id", right_id="keep_id", limit=hot_class)
    return met.where((F.col("__form") == F.col("__kept_form")) & (F.col("__id") != F.col("keep_id"))).select(*by, "keep_id", F.col("__id").alias("copy_id"))


def parsed_records(df: DataFrame, record: str) -> DataFrame:
    """Adds candidate, measure and value of exported records (JSON, or key=value between bars).

    All three are null where the text is null, empty or broken: no complete JSON
    object, or one of the three keys missing or without a readable value. Numbers may
    be quoted. Columns of those names in ``df`` are replaced.
    """
    text = F.col(record)
    json = text.rlike(r"(?s)^\s*\{.*\}\s*$")
    o = F.from_json(
        F.when(json, text),
        "candidate string, measure string, value string, __broken string",
        {"columnNameOfCorruptRecord": "__broken"},
    )

    def field(key: str) -> Column:
        bar = F.regexp_extract(text, rf"(?s)(?:^|\|)\s*{key}\s*=([^|]*)", 1)
        present = text.rlike(rf"(?s)(?:^|\|)\s*{key}\s*=")
        return F.when(json, F.when(o["__broken"].isNull(), o[key])).otherwise(F.when(present, bar))

    number = F.regexp_replace(F.trim(field("value")), '^"|"$', "")
    value = F.when(F.trim(number).rlike(NUMBER), F.trim(number).try_cast("double"))
    measure = F.when(json, field("measure")).otherwise(F.trim(field("measure")))
    whole = field("candidate").isNotNull() & measure.isNotNull() & value.isNotNull()
    return df.withColumns(
        {
            "candidate": F.when(whole, field("candidate")),
            "measure": F.when(whole, measure),
            "value": F.when(whole, value),
        }
    )
