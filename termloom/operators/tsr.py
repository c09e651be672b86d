"""Token slot recognition: candidates that share first, middle or last words with seed terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.tokens import words
from termloom.runtime import checkpointed


def _slots(terms: DataFrame, column: str) -> DataFrame:
    """slot (F, M, L) and word of lower-cased terms; a single word is first and last."""
    w = F.col("__w")
    size = F.size(w)
    parts = F.flatten(
        F.array(
            F.array(F.struct(F.lit("F").alias("slot"), F.get(w, F.lit(0)).alias("word"))),
            F.array(F.struct(F.lit("L").alias("slot"), F.get(w, size - 1).alias("word"))),
            F.transform(F.slice(w, 2, F.greatest(size - 2, F.lit(0))), lambda x: F.struct(F.lit("M").alias("slot"), x.alias("word"))),
        )
    )
    return (
        terms.select(words(F.lower(F.col(column))).alias("__w"))
        .where(size > 0)
        .select(F.explode(parts).alias("p"))
        .select("p.slot", "p.word")
        .distinct()
    )


def _flagged(candidates: DataFrame, slots: DataFrame) -> DataFrame:
    """Candidates with whether their first, last and all middle words are in the slots.

    Three joins by equality on words; a set of slots too large to broadcast is shuffled.
    """
    w = words(F.lower("candidate"))
    base = candidates.withColumn("__w", w).where(F.size("__w") > 0)
    first = slots.where("slot = 'F'").select(F.col("word").alias("__fw"), F.lit(True).alias("__first"))
    last = slots.where("slot = 'L'").select(F.col("word").alias("__lw"), F.lit(True).alias("__last"))
    mids = slots.where("slot = 'M'").select(F.col("word").alias("__mw"))
    middle = (
        base.where(F.size("__w") > 2)
        .select("candidate", F.explode(F.array_distinct(F.expr("slice(__w, 2, size(__w) - 2)"))).alias("__mw"))
        .distinct()
        .join(mids, "__mw", "left_anti")
        .select("candidate")
        .distinct()
        .withColumn("__missing", F.lit(True))
    )
    return (
        base.join(first, F.get("__w", F.lit(0)) == F.col("__fw"), "left")
        .join(last, F.get("__w", F.size("__w") - 1) == F.col("__lw"), "left")
        .join(middle, "candidate", "left")
        .withColumn("__first", F.coalesce("__first", F.lit(False)))
        .withColumn("__last", F.coalesce("__last", F.lit(False)))
        # middle words count only where there are any
        .withColumn("__middle", (F.size("__w") > 2) & F.col("__missing").isNull())
        .drop("__fw", "__lw", "__missing")
    )


def _strict(c: DataFrame) -> Column:
    return F.col("__first") & F.col("__last") & (F.col("__middle") | (F.size("__w") <= 2))


def tsr_filter(candidates: DataFrame, seeds: DataFrame, kind: str = "strict", *, column: str = "term", max_rounds: int | None = None) -> DataFrame:
    """Candidates recognised by the slots of ``seeds``.

    strict: first, last and all middle words are in their slots. flexible: any of the
    three is, and accepted terms add their first and last words until nothing is added.
    combined: strict first; if that accepts anything, flexible rounds that add middle
    words too. Null and empty terms are never accepted. Without ``max_rounds`` words that
    terms link are found by halving, so the passes grow with the logarithm of the longest
    chain of terms; ``max_rounds`` ends after as many rounds, each a pass over the terms.
    """
    names = candidates.columns
    slots = _slots(seeds, column)
    if kind == "strict":
        flagged = _flagged(candidates, slots)
        return flagged.where(_strict(flagged)).select(*names)
    if kind not in ("flexible", "combined"):
        raise ValueError(f"kind {kind!r} is none of strict, flexible, combined")
    middles = kind == "combined"
    slots = checkpointed(slots)
    keys = _keys(candidates)
    # what strict accepts has all its words in the slots, and adds none
    if middles and _strict_keys(keys, slots).isEmpty():
        return candidates.limit(0)
    if max_rounds is not None:
        reached = _rounds(keys, slots, middles, max_rounds)
        any_hit = F.col("__first") | F.col("__last") | F.col("__middle")
        return _flagged(candidates, reached).where(any_hit).select(*names)
    # all that is accepted has added its first word
    first = _closure(keys, slots, middles).where("slot = 'F'").select(F.col("word").alias("__fw"))
    return candidates.join(first, F.get(words(F.lower("candidate")), F.lit(0)) == F.col("__fw"), "left_semi").select(*names)


def _keys(candidates: DataFrame) -> DataFrame:
    """first, last and sorted distinct middle words of terms, each combination once."""
    w = words(F.lower("candidate"))
    return checkpointed(
        candidates.select(w.alias("__w"))
        .where(F.size("__w") > 0)
        .select(
            F.get("__w", F.lit(0)).alias("first"),
            F.get("__w", F.size("__w") - 1).alias("last"),
            F.array_sort(F.array_distinct(F.expr("slice(__w, 2, greatest(size(__w) - 2, 0))"))).alias("mid"),
        )
        .distinct()
    )


def _named(slots: DataFrame, slot: str, name: str) -> DataFrame:
    return slots.where(F.col("slot") == slot).select(F.col("word").alias(name))


def _known(keys: DataFrame, slots: DataFrame) -> DataFrame:
    """Keys with middle words that are all in the slots."""
    return (
        keys.where(F.size("mid") > 0)
        .select("first", "last", "mid", F.explode("mid").alias("word"))
        .join(_named(slots, "M", "word"), "word", "left_semi")
        .groupBy("first", "last", "mid")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.size("mid"))
        .select("first", "last", "mid")
    )


def _strict_keys(keys: DataFrame, slots: DataFrame) -> DataFrame:
    hits = keys.join(_named(slots, "F", "first"), "first", "left_semi").join(_named(slots, "L", "last"), "last", "left_semi").select("first", "last", "mid")
    return hits.where(F.size("mid") == 0).unionByName(_known(hits, slots))


def _words_of(keys: DataFrame, middles: bool) -> DataFrame:
    """slot and word of the keys' first and last words, with ``middles`` of those between too."""
    parts = [F.array(F.struct(F.lit("F").alias("slot"), F.col("first").alias("word")), F.struct(F.lit("L").alias("slot"), F.col("last").alias("word")))]
    if middles:
        parts.append(F.transform("mid", lambda x: F.struct(F.lit("M").alias("slot"), x.alias("word"))))
    return keys.select(F.explode(F.concat(*parts)).alias("p")).select("p.slot", "p.word").distinct()


def _rounds(keys: DataFrame, slots: DataFrame, middles: bool, max_rounds: int) -> DataFrame:
    """Slots reached in ``max_rounds - 1`` rounds: each joins only the slots that the round before added."""
    new = slots
    for k in range(1, max_rounds):
        hits = keys.join(_named(new, "F", "first"), "first", "left_semi").unionByName(
            keys.join(_named(new, "L", "last"), "last", "left_semi").select("first", "last", "mid")
        )
        if k == 1 or middles:
            hits = hits.unionByName(_known(keys, slots))
        new = checkpointed(_words_of(hits, middles).join(slots, ["slot", "word"], "left_anti"))
        if new.isEmpty():
            break
        slots = checkpointed(slots.unionByName(new))
    return slots


def _closure(keys: DataFrame, start: DataFrame, middles: bool) -> DataFrame:
    """slot and word of the keys' words that are reached from ``start``.

    A key's words reach each other, but for two cases. Middle words that add none are
    looked up in ``start`` alone. Where several middle words are added, all are reached
    from the first, which only all together reach: these keys are tried again, in rounds,
    while they join parts to what is reached.
    """
    if not middles:
        return _parts(keys, start.unionByName(_words_of(_known(keys, start), False)).distinct(), False).where("part = 0").select("slot", "word")
    parts = _parts(keys, start, True)
    several = checkpointed(keys.where(F.size("mid") > 1))
    while not several.isEmpty():
        reached = parts.where("part = 0").select("slot", "word")
        hits = several.join(_named(reached, "F", "first"), "first", "left_semi").select("first", "last", "mid").unionByName(_known(several, reached))
        joined = checkpointed(
            parts.where("part <> 0").join(_words_of(hits, True), ["slot", "word"], "left_semi").select("part", F.lit(True).alias("__joined")).distinct()
        )
        if joined.isEmpty():
            break
        parts = checkpointed(parts.join(joined, "part", "left").select("slot", "word", F.when(F.col("__joined"), 0).otherwise(F.col("part")).alias("part")))
    return parts.where("part = 0").select("slot", "word")


def _parts(keys: DataFrame, start: DataFrame, middles: bool) -> DataFrame:
    """slot, word and part of the keys' words: linked words have one part, 0 where one of them is in ``start``.

    A key links its first word to its last and, with ``middles``, to its only middle word.
    Words are numbered, those in ``start`` 0. In each pass a link's lower end gives way to
    the least that it is linked to, then all lower ends of a word hang at the least of
    them; when nothing moves, each word hangs at the least of its part. The number of
    links never grows, and a pass shortens chains to about half.
    """
    numbered = checkpointed(
        _words_of(keys, middles)
        .join(start.withColumn("__in", F.lit(True)), ["slot", "word"], "left")
        .select("slot", "word", F.when(F.col("__in"), F.lit(0)).otherwise(F.monotonically_increasing_id() + 1).alias("id"))
    )
    ids = lambda slot, word, name: numbered.where(F.col("slot") == slot).select(F.col("word").alias(word), F.col("id").alias(name))
    ends = keys.select("first", "last").distinct().join(ids("F", "first", "a"), "first").join(ids("L", "last", "b"), "last").select("a", "b")
    if middles:
        between = keys.where(F.size("mid") == 1).select("first", F.get("mid", F.lit(0)).alias("only")).distinct()
        ends = ends.unionByName(between.join(ids("F", "first", "a"), "first").join(ids("M", "only", "b"), "only").select("a", "b"))
    links = checkpointed(ends.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    while not links.isEmpty():
        least = links.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("under"))
        jumped = links.join(least, "lo", "left").select("hi", F.coalesce("under", "lo").alias("lo"), F.col("under").isNotNull().alias("moved"))
        hung = jumped.withColumn("under", F.min("lo").over(Window.partitionBy("hi")))
        at = F.col("lo") == F.col("under")
        links = checkpointed(
            hung.select(F.when(at, F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("under").alias("lo"), (F.col("moved") | ~at).alias("moved"))
            .groupBy("hi", "lo")
            .agg(F.max("moved").alias("moved"))
        )
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return numbered.join(links.select(F.col("hi").alias("id"), "lo"), "id", "left").select("slot", "word", F.coalesce("lo", "id").alias("part"))
