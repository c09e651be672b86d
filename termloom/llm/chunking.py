"""Cutting oversized items at natural boundaries: balanced targets.

The fewest pieces that can hold an item are counted, targets of equal length are
placed, each is moved to the strongest boundary nearby, and a piece is added as long
as any piece breaks the limit.
"""

from __future__ import annotations

import bisect
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1

_CLOSERS = "\"'”’»)\\]」』）"
_TEXT_BOUNDARIES = (
    (PARAGRAPH, re.compile(r"\n[^\S\n]*\n\s*")),
    (SENTENCE, re.compile(rf"[.!?…؟।॥][{_CLOSERS}]*\s+|[。！？｡][{_CLOSERS}]*\s*|\n")),
    (CLAUSE, re.compile(rf"[,;:–—][{_CLOSERS}]*\s+|[，、；：،؛]\s*")),
    (WORD, re.compile(r"\s+")),
)
_SENTENCE_TOKEN = re.compile(rf"[.!?…。！？؟।][{_CLOSERS}]*$")
_CLAUSE_TOKEN = re.compile(r"[,;:，、；：،؛–—]$")


def text_boundaries(text: str) -> dict[int, int]:
    """Strength of each position in ``text`` at which it may be cut, after the white space there."""
    out: dict[int, int] = {}
    for strength, pattern in _TEXT_BOUNDARIES:
        for m in pattern.finditer(text):
            out.setdefault(m.end(), strength)
    out.pop(0, None)
    out.pop(len(text), None)
    return out


def token_boundaries(tokens: list[str]) -> dict[int, int]:
    """As :func:`text_boundaries`, between tokens."""
    return {
        i + 1: SENTENCE if _SENTENCE_TOKEN.search(t) else CLAUSE if _CLAUSE_TOKEN.search(t) else WORD
        for i, t in enumerate(tokens[:-1])
    }


def _joins(text: str, i: int) -> bool:
    """Whether a cut before ``text[i]`` would part a character from its marks or a line break's halves."""
    c = text[i]
    return "̀" <= c <= "ͯ" or c in "‍️" or text[i - 1] == "‍" or text[i - 1 : i + 1] == "\r\n"


def plan_cuts(size: int, strength: dict[int, int], limit: int, overlap: int, text: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item of ``size`` units.

    Every piece has at most ``limit`` units; each after the first begins at most
    ``overlap`` units before the end of the one before: at the first boundary there
    is, or exactly ``overlap`` before if there is none. ``overlap < limit``.
    """
    if size <= limit:
        return [(0, size)]
    count = 1 + math.ceil((size - limit) / (limit - overlap))
    points = sorted(strength)
    while True:
        pieces = _place(size, strength, points, limit, overlap, count, text)
        if pieces is not None:
            return pieces
        count += 1


def _place(size, strength, points, limit, overlap, count, text):
    pieces, start, done = [], 0, 0  # done: end of the last piece; start: of the next
    for left in range(count, 0, -1):
        if size - start <= limit and (left == 1 or done + 1 >= size):
            return [*pieces, (start, size)]
        if left == 1:
            return None
        furthest = min(start + limit, size - 1)
        length = (size - start + (left - 1) * overlap) / left  # equal pieces from here on
        target = min(max(done + 1, round(start + length)), furthest)
        slack = max(1, int(length * 0.15))
        low = max(done + 1, target - slack)
        near = points[bisect.bisect_left(points, low) : bisect.bisect_left(points, min(furthest, target + slack) + 1)]
        if not near:
            near = points[bisect.bisect_left(points, done + 1) : bisect.bisect_left(points, furthest + 1)]
        if near:
            cut = min(near, key=lambda p: (-strength[p], abs(p - target), p)) if near[0] >= low else min(near, key=lambda p: (abs(p - target), p))
        else:
            cut = target
            while text is not None and cut - 1 > done and _joins(text, cut):
                cut -= 1
        pieces.append((start, cut))
        done = cut
        back = max(start + 1, cut - overlap)
        i = bisect.bisect_left(points, back)
        start = points[i] if i < len(points) and points[i] < cut else back if not _bounded(points, start, cut) else cut
        while text is not None and start < cut and start not in strength and _joins(text, start):
            start += 1
    return None


def _bounded(points: list[int], a: int, b: int) -> bool:
    """Whether any boundary lies within (a, b)."""
    i = bisect.bisect_left(points, a + 1)
    return i < len(points) and points[i] < b


PIECE = "struct<start:int,end:int,text:string>"


def _cut(items: Column, plan, piece) -> Column:
    """Pieces of each item, cut where it is planned; null items stay null."""

    @F.pandas_udf(f"array<{PIECE}>")
    def cuts(batch: pd.Series) -> pd.Series:
        def one(item: str) -> list[dict]:
            units, bounds = plan(item)
            return [{"start": a, "end": b, "text": piece(units[a:b])} for a, b in bounds]

        return batch.map(one, na_action="ignore")

    return cuts.asNondeterministic()(items)  # so that no plan runs it twice


def _pieces(df: DataFrame, id_col: str, item: str, size: Column, limit: int, plan, piece) -> DataFrame:
    t = F.col(item)
    large = size > limit
    # items within the limit stay in the JVM
    whole = F.array(F.struct(F.lit(0).alias("start"), size.cast("int").alias("end"), t.alias("text")))
    cut = df.where(t.isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(_cut(F.when(large, t), plan, piece), whole).alias("__c"))
    return cut.select("id", F.size("__c").alias("pieces"), F.transform("__c", lambda x: x["end"]).alias("__ends"), F.posexplode("__c").alias("piece", "__p")).select(
        "id",
        "piece",
        "pieces",
        F.col("__p.start").alias("start"),
        F.col("__p.end").alias("end"),
        F.when(F.col("piece") > 0, F.expr("__ends[piece - 1] - __p.start")).otherwise(0).alias("repeated"),
        F.col("__p.text").alias("text"),
    )


def split_texts(df: DataFrame, *, id_col: str, text: str, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Pieces of every text: id, piece (from 0), pieces, start, end, repeated, text.

    Lengths and offsets are in code points. A text within the limit, an empty or
    blank one too, is one piece; a null text has none. ``repeated`` is how much of the
    piece before it stands again at its start. Taking from each piece what isn't
    repeated gives the text again.
    """
    plan = lambda t: (t, plan_cuts(len(t), text_boundaries(t), limit, overlap, t))
    return _pieces(df, id_col, text, F.length(text), limit, plan, lambda x: x)


def split_tokens(df: DataFrame, *, id_col: str, tokens: str, limit: int = 160, overlap: int = 16) -> DataFrame:
    """:func:`split_texts` for tokens joined by single blanks; lengths and offsets are in tokens."""
    t = F.col(tokens)
    size = F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)

    def plan(text: str):
        words = text.split(" ")
        return words, plan_cuts(len(words), token_boundaries(words), limit, overlap)

    return _pieces(df, id_col, tokens, size, limit, plan, " ".join)
