"""Frequency of every distinct term: burst-trie counting.

Plan
----
1. Deliveries are made unique, then summed to one row per (term, batch). Both are
   hash aggregations with a map side, so neither a hot term nor a hot batch meets
   in one task.
2. A histogram of term prefixes over *all* rows gives the routing nodes: prefixes
   that hold more than ``1 / fan_out`` of the rows burst into longer ones, until each
   holds fewer rows or a single term, however long they become.
3. Every task counts into its own :class:`BurstTrie`, which starts from the routing
   nodes, bursts further where its containers grow, and is emptied when it holds
   ``max_terms`` terms. A hot term costs one entry a task.
4. Subtrees with the same route are shuffled to one place and merged by a hash
   aggregation that reuses that placement.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "tbl string, route string, term string, occurrences long, records long"


class BurstTrie:
    """Counters of terms, kept in hash containers below a trie of prefixes.

    ``nodes`` are the prefixes that have burst. A term lies in the container of its
    shortest prefix that has not; a term that ends at a burst node lies in ``ends``.
    """

    def __init__(self, routes: frozenset[str] = frozenset(), burst: int = 4096):
        self.routes = routes
        self.nodes = set(routes) | {""}
        self.burst = burst
        self.leaves: dict[str, dict[str, list[int]]] = {}
        self.ends: dict[str, list[int]] = {}
        self.size = 0

    def _leaf(self, term: str) -> str | None:
        nodes = self.nodes
        for d in range(1, len(term) + 1):
            if (p := term[:d]) not in nodes:
                return p
        return None

    def add(self, term: str, occurrences: int, records: int) -> None:
        p = self._leaf(term)
        if p is None:
            box, key = self.ends, term
        else:
            box = self.leaves.get(p)
            if box is None:
                box = self.leaves[p] = {}
            key = term[len(p) :]
        c = box.get(key)
        if c is None:
            box[key] = [occurrences, records]
            self.size += 1
            if p is not None and len(box) > self.burst:
                self._split(p)
        else:
            c[0] += occurrences
            c[1] += records

    def _split(self, p: str) -> None:
        self.nodes.add(p)
        for suffix, c in self.leaves.pop(p).items():
            if suffix:
                self.leaves.setdefault(p + suffix[0], {})[suffix[1:]] = c
            else:
                self.ends[p] = c

    def route(self, p: str) -> str:
        """The shortest prefix of ``p`` that is no routing node; ``p`` itself if all are."""
        for d in range(1, len(p)):
            if p[:d] not in self.routes:
                return p[:d]
        return p

    def drain(self) -> Iterator[tuple[str, str, int, int]]:
        """(route, term, occurrences, records) of every term; the trie is empty afterwards."""
        for p, box in self.leaves.items():
            r = self.route(p)
            for suffix, c in box.items():
                yield r, p + suffix, c[0], c[1]
        for term, c in self.ends.items():
            yield self.route(term), term, c[0], c[1]
        self.leaves, self.ends, self.size = {}, {}, 0
        self.nodes = set(self.routes) | {""}


def routing_nodes(terms: DataFrame, fan_out: int, step: int = 8) -> dict[str, frozenset[str]]:
    """Prefixes that burst, by table. ``terms`` has tbl and term; all its rows are counted.

    A prefix bursts if it holds more than a ``fan_out``-th of the rows and more than one
    term. Prefixes of up to ``step`` characters are counted in one pass; where the longest
    of these burst, the terms below them are counted again with ``step`` characters more,
    until no prefix is left that has to. The driver gets fewer than ``fan_out`` prefixes a
    table and length.
    """
    total = {r.tbl: r["count"] for r in terms.groupBy("tbl").count().collect()}
    out: dict[str, set[str]] = {t: set() for t in total}
    below, length = terms, step
    while True:
        deep = below.groupBy("tbl", F.substring("term", 1, length).alias("p")).agg(F.count("*").alias("n"), F.min(F.xxhash64("term")).alias("least"), F.max(F.xxhash64("term")).alias("most"))
        every = deep.select("tbl", "n", "least", "most", F.explode(F.expr(f"transform(sequence({length - step + 1}, greatest(length(p), {length - step + 1})), d -> substring(p, 1, d))")).alias("p"))
        share = F.lit(0)
        for t, n in total.items():
            share = F.when(F.col("tbl") == t, n / fan_out).otherwise(share)
        heavy = (
            every.groupBy("tbl", "p")
            .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
            .where((F.col("n") > share) & (F.col("least") < F.col("most")))
        )
        found = [(r.tbl, r.p) for r in heavy.select("tbl", "p").collect()]
        for t, p in found:
            out[t].add(p)
        longest = [(t, p) for t, p in found if len(p) == length]
        if not longest:
            return {k: frozenset(v) for k, v in out.items() if v}
        at = F.struct("tbl", F.substring("term", 1, length).alias("p"))
        below = terms.where(at.isin([F.struct(F.lit(t).alias("tbl"), F.lit(p).alias("p")) for t, p in longest]))
        length += step


def _count_partition(routes: dict[str, frozenset[str]], burst: int, max_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, BurstTrie] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for tbl, trie in tries.items():
                rows = list(trie.drain())
                for i in range(0, len(rows), 20_000):
                    route, term, occ, rec = zip(*rows[i : i + 20_000], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([tbl] * len(term), pa.string()),
                            pa.array(route, pa.string()),
                            pa.array(term, pa.string()),
                            pa.array(occ, pa.int64()),
                            pa.array(rec, pa.int64()),
                        ],
                        names=["tbl", "route", "term", "occurrences", "records"],
                    )

        for b in batches:
            grouped = (
                pa.Table.from_batches([b])
                .group_by(["tbl", "term"])
                .aggregate([("occurrences", "sum"), ("records", "sum")])
            )
            for tbl, term, occ, rec in zip(
                grouped["tbl"].to_pylist(),
                grouped["term"].to_pylist(),
                grouped["occurrences_sum"].to_pylist(),
                grouped["records_sum"].to_pylist(),
                strict=True,
            ):
                trie = tries.get(tbl)
                if trie is None:
                    trie = tries[tbl] = BurstTrie(routes.get(tbl, frozenset()), burst)
                trie.add(term, occ or 0, rec or 0)
            if sum(t.size for t in tries.values()) > max_terms:
                yield from flush()
        yield from flush()

    return run


def term_counts(
    rows: DataFrame,
    *,
    fan_out: int = 256,
    burst: int = 4096,
    max_terms: int = 200_000,
) -> DataFrame:
    """Total frequency and number of batches of every distinct term.

    ``rows`` has tbl, row_id, batch_id, term and frequency; other columns are ignored.
    Rows of a table that are alike in those columns are one delivery. Null and empty
    terms and null frequencies hold nothing. A row without a batch adds to the
    frequency, not to the number of batches. Empty input gives no rows.

    Returns tbl, term, occurrences, records. ``max_terms`` bounds the memory of a
    task: a fuller trie is handed on and begun anew, which changes no total.
    """
    valid = rows.where(
        F.col("term").isNotNull() & (F.col("term") != "") & F.col("frequency").isNotNull() & F.col("tbl").isNotNull()
    ).select("tbl", "row_id", "batch_id", "term", "frequency")
    routes = routing_nodes(valid, fan_out)
    by_batch = (
        valid.distinct()
        .groupBy("tbl", "term", "batch_id")
        .agg(F.sum("frequency").alias("occurrences"))
        .select("tbl", "term", "occurrences", F.col("batch_id").isNotNull().cast("long").alias("records"))
    )
    partial = by_batch.mapInArrow(_count_partition(routes, burst, max_terms), OUT)
    return (
        partial.repartition("tbl", "route")
        .groupBy("tbl", "route", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .select("tbl", "term", "occurrences", "records")
    )


def marked_terms(
    rows: DataFrame, *, rare_below: int = 3, common_above: float = 0.2, **options
) -> DataFrame:
    """:func:`term_counts` with ``mark``: rare, common or null.

    A term is rare if fewer than ``rare_below`` batches hold it, else common if more
    than ``common_above`` of all distinct batches of its table do; batches whose rows
    hold nothing count among all.
    """
    batches = rows.groupBy("tbl").agg(F.count_distinct("batch_id").alias("all_batches"))
    return (
        term_counts(rows, **options)
        .join(F.broadcast(batches), "tbl")  # one row a table
        .withColumn(
            "mark",
            F.when(F.col("records") < rare_below, "rare").when(
                F.col("records") > common_above * F.col("all_batches"), "common"
            ),
        )
    )
