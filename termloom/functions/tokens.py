"""Tokens and n-grams as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token begins and ends with a letter, number or underscore; between
# may stand quotes and everything from the comma to the middle dot; a round bracket
# may stand at either end.
WORD = r"\p{L}\p{N}_"
TOKEN = rf"\(?[{WORD}](?:[{WORD}'‘’.,-·]*[{WORD}])?\)?"


def tokenize(text: Column) -> Column:
    """Tokens of a text; null for null, an empty array for a text without any."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def words(text: Column) -> Column:
    """Parts between white space, no-break blanks too, without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def ngram_arrays(tokens: str, nmin: int, nmax: int) -> Column:
    """All windows of nmin to nmax tokens of the array column ``tokens``, as structs (n, gram)."""
    return F.expr(
        f"flatten(transform(filter(sequence({nmin}, {nmax}), n -> n <= size({tokens})), "
        f"n -> transform(sequence(1, size({tokens}) - n + 1), i -> "
        f"struct(n as n, slice({tokens}, i, n) as gram))))"
    )


def case_key(term: Column) -> Column:
    """A term without case, unless all of it is capitals."""
    capitals = (F.upper(term) == term) & (F.lower(term) != term)
    return F.when(capitals, F.trim(term)).otherwise(F.trim(F.lower(term)))
