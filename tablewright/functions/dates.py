"""Date standardising and calendar features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text shapes after separators become "-", each with its formats in order; day-first wins when ambiguous.
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["yyyy-M-d"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-yyyy", "M-d-yyyy"]),
    (r"^\d{1,2}-\p{L}+-\d{4}$", ["d-MMM-yyyy", "d-MMMM-yyyy"]),
    (r"^\p{L}+-\d{1,2}-\d{4}$", ["MMM-d-yyyy", "MMMM-d-yyyy"]),
    (r"^\d{4}-\d{2}-\d{2}[T-]\d{2}:\d{2}:\d{2}$", ["yyyy-MM-dd-HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"]),
]


def standardize_date(col: Column) -> Column:
    """Timestamp from mixed date texts, NULL when no listed format fits.

    A text only meets the formats of its shape: a failed parse costs an exception, a failed shape test does not.
    """
    text = F.regexp_replace(F.trim(col.cast("string")), r"[./\s\\]", "-")
    (first, formats), *rest = [(shape, F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in names])) for shape, names in DATE_FORMATS]
    found = F.when(text.rlike(first), formats)
    for shape, value in rest:
        found = found.when(text.rlike(shape), value)
    return found


def date_parts(col: Column, name: str) -> list[Column]:
    """Year, month, day and weekend flag of a timestamp."""
    return [
        F.year(col).alias(f"{name}_year"),
        F.month(col).alias(f"{name}_month"),
        F.dayofmonth(col).alias(f"{name}_day"),
        F.dayofweek(col).isin(1, 7).cast("int").alias(f"{name}_is_weekend"),
    ]
