"""Text normalisation that Spark's built-in functions can't express."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")


def fold_words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the compatibility decomposition, without marks, lower-cased."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.category(c).startswith("M"))
    return _WORD.findall(text.lower())


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


_composed = _nfc.asNondeterministic()  # so that no plan runs it twice


def composed(text: Column) -> Column:
    """NFC of a string column; only strings that hold combining marks go to Python."""
    marked = text.rlike(r"\p{M}")
    return F.coalesce(_composed(F.when(marked, text)), text)


def letters_and_digits(text: Column, *, compose: bool = True) -> Column:
    """Letters and digits of a string, in order and without case; accents stay.

    Without ``compose`` the string must be in composed form already; such an expression
    has no Python function and may stand within a lambda.
    """
    kept = F.regexp_replace(composed(text) if compose else text, r"[^\p{L}\p{N}]", "")
    return F.translate(F.regexp_replace(F.regexp_replace(F.lower(kept), "ß", "ss"), r"[^\p{L}\p{N}]", ""), "ς", "σ")
