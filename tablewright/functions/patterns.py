"""Email, phone and template expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted shapes.
EMAIL = r"^[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+$"
EMAIL_LOOSE = r"^[^@]+@[^@]+\.[^@]+$"
PHONE_E164 = r"^\+?[1-9]\d{1,14}$"


def clean_email(col: Column) -> Column:
    """Lower-case, trimmed address; NULL when it has no address shape."""
    text = F.trim(F.lower(col))
    return F.when(text.rlike(EMAIL), text)


def clean_phone(col: Column) -> Column:
    """Digits and plus signs only; NULL under four characters."""
    text = F.regexp_replace(F.trim(col.cast("string")), r"[^\d+]", "")
    return F.when(F.length(text) >= 4, text)


def guard_phone(col: Column) -> Column:
    """Prefix a quote where the text starts with + and holds a hyphen (keeps spreadsheets from evaluating it)."""
    return F.when(col.startswith("+") & col.contains("-"), F.concat(F.lit("'"), col)).otherwise(col)


def shape(col: Column) -> Column:
    """Template of a text: digits become #, letters become ?, other characters stay."""
    return F.regexp_replace(F.regexp_replace(col, r"\p{L}", "?"), r"\p{Nd}", "#")
