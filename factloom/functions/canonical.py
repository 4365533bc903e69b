"""Canonical forms in which records that differ only in formatting are equal."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = r"\p{M}"


def composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def with_nfc(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """cols in Unicode's composed form. Only rows that hold a combining mark go through Python."""
    nfc = F.pandas_udf(composed, "string")
    marked = F.lit(False)
    for c in cols:
        marked = marked | F.coalesce(F.col(c).rlike(MARK), F.lit(False))
    return df.filter(~marked).unionByName(df.filter(marked).withColumns({c: nfc(F.col(c)) for c in cols}))


def letters_digits(c: Column) -> Column:
    """Letters, digits and their marks only, letter case folded; null counts as empty."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}\p{M}]", "")
    out = F.translate(F.lower(F.upper(kept)), "ς", "σ")
    for a, b in (("ß", "ss"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl")):  # as capitals would have them
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def field_set(c: Column) -> Column:
    """The |-separated fields of c, each as letters_digits, without empty ones, in sorted order."""
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), letters_digits), lambda x: x != "")), "\x01")
