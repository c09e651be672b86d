"""Mixing sources to target weights: hierarchical budgeting.

Sources hang below a domain and a language. Their weights are summed up the tree; the
total is handed down by weight; what a node can't use, even repeating its documents as
often as allowed, goes to its siblings first and only what they can't take goes to the
siblings of its parent. Each leaf then takes whole epochs of its documents and of one
more epoch, in seeded order, the prefix that its budget still holds; what whole
documents leave over in one leaf is made up in the source's others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.runtime import beside

# Language codes and how tables spell them.
LANGUAGES = {
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "french"),
    "de": ("de", "deu", "german"),
    "ca": ("ca", "cat", "catalan"),
    "pl": ("pl", "pol", "polish"),
    "zh": ("zh", "zho", "chinese"),
    "ja": ("ja", "jpn", "japanese"),
    "hi": ("hi", "hin", "hindi"),
    "ar": ("ar", "ara", "arabic"),
    "th": ("th", "tha", "thai"),
}

# Domains of sources; a source that is missing here is a domain of its own.
DOMAINS = {
    "journals": "science",
    "patents": "engineering",
    "standards": "engineering",
    "manuals": "engineering",
    "legal": "law",
    "glossaries": "reference",
    "lexicons": "reference",
    "forums": "web",
    "web_crawl": "web",
    "subtitles": "speech",
}


def language_code(lang: Column) -> Column:
    """Two-letter code of a language given as code or English name; ``und`` for others and null."""
    spelt = F.lower(F.trim(lang))
    codes = F.create_map(*[F.lit(x) for code, names in LANGUAGES.items() for n in names for x in (n, code)])
    return F.coalesce(F.try_element_at(codes, F.coalesce(spelt, F.lit(""))), F.lit("und"))


@dataclass
class Node:
    """A node of the tree; leaves have the tokens of their documents and how often they may be used."""

    name: str
    weight: float = 0.0
    tokens: int = 0
    repeats: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    @property
    def capacity(self) -> int:
        return sum(c.capacity for c in self.children.values()) if self.children else self.tokens * self.repeats

    def total_weight(self) -> float:
        if self.children:
            self.weight = sum(c.total_weight() for c in self.children.values())
        return self.weight


def shared_out(amount: float, nodes: list[Node]) -> None:
    """Sets the budgets of siblings: by weight, the shortage of the small ones going to the others by weight."""
    open_nodes = [n for n in nodes if n.capacity > 0 and n.weight > 0]
    for n in nodes:
        n.budget = 0.0
    left = min(amount, sum(n.capacity for n in open_nodes))
    while open_nodes and left > 1e-9:
        weight = sum(n.weight for n in open_nodes)
        full = [n for n in open_nodes if n.capacity <= left * n.weight / weight]
        if not full:
            for n in open_nodes:
                n.budget = left * n.weight / weight
            return
        for n in full:
            n.budget = float(n.capacity)
            left -= n.capacity
            open_nodes.remove(n)


def hand_down(node: Node) -> None:
    if node.children:
        shared_out(node.budget, list(node.children.values()))
        for c in node.children.values():
            hand_down(c)


def fitting_total(root: Node, targets: dict[str, float], leaves: dict[tuple, Node]) -> float:
    """The largest total at which every source that has documents still reaches its target share.

    Found by bisection over totals, to a token; the budgets of ``root`` are set.
    """
    have = {k[2] for k, n in leaves.items() if n.capacity > 0}

    def reached(total: float) -> bool:
        root.budget = total
        hand_down(root)
        per: dict[str, float] = dict.fromkeys(have, 0.0)
        for k, n in leaves.items():
            if n.capacity > 0:
                per[k[2]] += n.budget
        return all(v >= targets[s] * total * (1 - 1e-9) for s, v in per.items())

    low, high = 0.0, float(root.capacity)
    if high and reached(high):
        return high
    while high - low > 1:
        mid = (low + high) / 2
        low, high = (mid, high) if reached(mid) else (low, mid)
    return low


def budgets(leaf_rows: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], domains: dict[str, str], total: int | str) -> tuple[dict[tuple[str, str], float], float]:
    """Budget of each (source, language) leaf, and the total.

    A source's weight is spread over its languages by their tokens; a source without
    documents is a leaf of no capacity, whose whole share is a shortage.
    """
    root = Node("")
    leaves: dict[tuple, Node] = {}
    of_source: dict[str, int] = {}
    for source, _, tokens in leaf_rows:
        of_source[source] = of_source.get(source, 0) + tokens
    rows = [*leaf_rows, *((s, "und", 0) for s in targets if not of_source.get(s))]
    for source, lang, tokens in rows:
        share, repeats = targets[source]
        domain = root.children.setdefault(d := domains.get(source, source), Node(d))
        language = domain.children.setdefault(lang, Node(lang))
        part = tokens / of_source[source] if of_source.get(source) else 1.0
        leaves[d, lang, source] = language.children.setdefault(
            source, Node(source, weight=share * part, tokens=tokens, repeats=repeats)
        )
    root.total_weight()
    if total == "fitting":
        amount = fitting_total(root, {s: t[0] for s, t in targets.items()}, leaves)
    elif total == "available":
        amount = float(sum(of_source.values()))
    else:
        amount = float(total)
    root.budget = min(amount, root.capacity)
    hand_down(root)
    return {(k[2], k[1]): n.budget for k, n in leaves.items()}, root.budget


def mixed(
    docs: DataFrame,
    targets: DataFrame,
    *,
    id_col: str = "doc_id",
    total: int | str = "fitting",
    domains: dict[str, str] | None = None,
    seed: int = 17,
    buckets: int = 4096,
    max_targets: int = 10_000,
) -> DataFrame:
    """A selection of documents in which each source has its target share of the tokens.

    ``docs``: id, source, lang and tokens; ``targets``: source, target_share, max_repeats.
    Documents without a source or target, or with no tokens, take no part. ``total`` is
    the number of tokens to select; ``"available"`` is the tokens there are, ``"fitting"``
    the largest number at which every source that has documents still reaches its share.

    Returns id, source, lang, tokens and copies: how often a document is used, at most
    max_repeats of its source and never 0. The driver holds one row per leaf, at most
    ``max_targets`` sources times the known languages. A source's running total is made
    of ``buckets`` sums and of the documents of a single bucket, so no task orders a
    whole source.
    """
    wanted = targets.where(
        F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    ).select("source", "target_share", "max_repeats")
    rows = wanted.limit(max_targets + 1).collect()
    if len(rows) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    goal = {r.source: (float(r.target_share), int(r.max_repeats)) for r in rows}
    spark = docs.sparkSession
    names = spark.createDataFrame([(s,) for s in goal], "source string")
    ready = (
        docs.select(F.col(id_col).alias("id"), "source", language_code(F.col("lang")).alias("lang"), "tokens")
        .where(F.col("tokens") > 0)
        .join(F.broadcast(names), "source", "left_semi")
    )
    leaf_rows = [(r.source, r.lang, r.tokens) for r in ready.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).collect()]
    by_leaf, _ = budgets(leaf_rows, goal, DOMAINS if domains is None else domains, total)
    plan, rests = [], dict.fromkeys(goal, 0.0)
    for source, lang, tokens in leaf_rows:
        whole = int(min(goal[source][1], by_leaf[source, lang] // tokens))
        rest = by_leaf[source, lang] - whole * tokens if whole < goal[source][1] else 0.0
        rests[source] += rest
        plan.append((source, lang, whole, rest / tokens))
    leaf_plan = F.broadcast(spark.createDataFrame(plan, "source string, lang string, whole int, part double"))
    source_plan = F.broadcast(spark.createDataFrame(list(rests.items()), "source string, rest double"))

    # seeded order of the last epoch: at time t a leaf has given about part * t of its tokens, so all leaves
    # of a source reach their budgets together, at time 1
    uniform = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    timed = (
        ready.join(leaf_plan, ["source", "lang"])
        .withColumn("time", F.when(F.col("part") > 0, uniform / F.col("part")))
        .withColumn("bucket", F.floor(F.lit(buckets) * F.col("time") / (1 + F.col("time"))))
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = (
        timed.where(F.col("time").isNotNull())
        .groupBy("source", "bucket")
        .agg(F.sum("tokens").alias("sum"))
        .withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        .join(source_plan, "source")
        .select(
            "source",
            "bucket",
            (F.col("rest") - F.col("before")).alias("room"),
            (F.col("before") + F.col("sum") <= F.col("rest")).alias("inside"),
        )
    )
    placed = timed.join(prefix, ["source", "bucket"], "left")
    edge = F.coalesce((F.col("room") > 0) & ~F.col("inside"), F.lit(False))
    so_far = Window.partitionBy("source", "bucket").orderBy("time", "id")
    cut = placed.where(edge).withColumn("run", F.sum("tokens").over(so_far)).withColumn(
        # a document is in if the larger part of it is: a source is off by half a document at most
        "extra", (F.col("run") - F.col("tokens") / 2 <= F.col("room")).cast("int")
    )
    rest = placed.where(~edge).withColumn("extra", F.when(F.col("inside"), 1).otherwise(0))
    return (
        rest.unionByName(cut.drop("run"))
        .select(F.col("id").alias(id_col), "source", "lang", "tokens", (F.col("whole") + F.col("extra")).alias("copies"))
        .where(F.col("copies") > 0)
    )


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source its target share, selected tokens, share reached, documents and most copies of one; shares of all tokens."""
    per = selection.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        F.count("*").alias("documents"),
        F.max("copies").alias("most_copies"),
    )
    all_tokens = per.agg(F.sum("tokens").alias("all_tokens"))
    return (
        beside(targets.select("source", "target_share", "max_repeats").join(per, "source", "left"), all_tokens)
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
        )
    )
