"""Sentence keys: Unicode normal form, lower case, words only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Between language and key in a node's name; it occurs in no key.
SEPARATOR = "\u001f"
NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"
OUTER_SPACE = r"^(?U)\s+|(?U)\s+$"
#: Text below U+0300 is its own normal form.
MAY_CHANGE = r"[^\x{0000}-\x{02FF}]"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def with_nfc(df: DataFrame, *cols: str) -> DataFrame:
    """The columns in normal form C. Rows that hold no letter from U+0300 up go round Python: Spark evaluates a
    Python function for every row of a branch, so the table is split, not the expression."""
    changes = F.lit(False)
    for c in cols:
        changes = changes | F.coalesce(F.col(c).rlike(MAY_CHANGE), F.lit(False))
    plain = df.where(~changes)
    other = df.where(changes)
    return plain.unionByName(other.withColumns({c: _nfc(F.col(c)) for c in cols}))


def trim_unicode(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, OUTER_SPACE, "")


def is_blank(text: Column) -> Column:
    return text.rlike(r"^(?U)\s*$")


def normalize_key(text: Column) -> Column:
    """Key of a text that is in normal form C: lower case letter by letter, every run of other signs than letters and
    numbers one space, none at the ends. Where no letter or number is left, the trimmed text itself, case kept."""
    low = F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))  # a final sigma is no letter of its own here
    key = F.trim(F.regexp_replace(low, NOT_WORD, " "))
    return F.when(key == "", trim_unicode(text)).otherwise(key)


def node_key(lang: Column, text: Column) -> Column:
    return F.concat(lang, F.lit(SEPARATOR), normalize_key(text))
