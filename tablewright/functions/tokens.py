"""Error tokens and the dirty-cell test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The three token lists, one per use.
CLEANER_TOKENS = ["ERROR", "error", "UNKNOWN", "unknown", "?", "-", "Not Started", "Null"]
DIFF_TOKENS = ["ERROR", "error", "UNKNOWN", "unknown", "?", "-", "Not Started", "Null", "NULL", "N/A", "n/a", "na", "NA"]
AUDIT_TOKENS = ["ERROR", "error", "UNKNOWN", "unknown", "?", "-", "Not Started", "Null", "NULL", "N/A", "n/a", "na", "NA",
                "#VALUE!", "??", "---"]


def tokens_to_null(col: Column, tokens: list[str] = CLEANER_TOKENS) -> Column:
    """NULL where the text equals a token exactly."""
    return F.when(~col.isin(tokens), col)


def is_token(col: Column, tokens: list[str] = AUDIT_TOKENS) -> Column:
    """True where the trimmed text is a token; False for NULL."""
    return F.coalesce(F.trim(col).isin(tokens), F.lit(False))


def is_dirty(col: Column, dtype: T.DataType, tokens: list[str] = AUDIT_TOKENS) -> Column:
    """NULL, NaN for fractional types, or a token for strings."""
    if isinstance(dtype, T.StringType):
        return col.isNull() | is_token(col, tokens)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()
