"""Arabic normalisation, script tests, value equivalence and keyword tagging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.dates import standardize_date
from tablewright.functions.numbers import western_digits

# Letters and marks of the Arabic script used below.
ARABIC_LETTERS = "ابتثجحخدرزسشصضطظعغفقكلمنهوي"
ALEF_FORMS = "أإآ"


def normalize_arabic(col: Column) -> Column:
    """Lower, drop diacritics, unify alef / ya / ta-marbuta, collapse spaces."""
    text = F.regexp_replace(F.lower(col), "[ً-ْ]", "")
    text = F.translate(text, ALEF_FORMS + "ى" + "ة", "ااا" + "ي" + "ه")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def comparable_arabic(col: Column) -> Column:
    """Form used for comparison: unified alef and ta-marbuta, digits folded and removed, spaces collapsed."""
    text = western_digits(F.translate(col, ALEF_FORMS + "ة", "ااا" + "ه"))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Nd}", ""), r"\s+", " "))


def has_high_script(col: Column) -> Column:
    """True when any character lies above code point 1200."""
    return col.rlike("[\\x{04B1}-\\x{10FFFF}]")


def canonical(col: Column, arabic: bool = False) -> Column:
    """Struct of everything the equivalence test needs about one cell: text, number, day, comparable text."""
    text = col.cast("string")
    low = F.lower(F.trim(text))
    folded = comparable_arabic(low)
    comparable = folded if arabic else F.when(low.rlike(f"[{ARABIC_LETTERS}]"), folded).otherwise(low)
    number = text.try_cast("double")
    day = F.when(number.isNull(), F.to_date(standardize_date(text)))
    return F.struct(text.alias("text"), number.alias("number"), day.alias("day"), comparable.alias("comparable"))


def same(actual: Column, expected: Column) -> Column:
    """Equivalence of two canonical structs: within 15 % for numbers, same day for dates, else equal comparable text."""
    first, second = actual["number"], expected["number"]
    close = F.when(F.greatest(F.abs(first), F.abs(second)) == 0, F.lit(True)).otherwise(
        F.abs(first - second) / F.greatest(F.abs(first), F.lit(1.0)) <= 0.15
    )
    one, two = actual["text"], expected["text"]
    return (
        F.when(one.eqNullSafe(two), F.lit(True))
        .when(one.isNull() | two.isNull(), F.lit(False))
        .when(first.isNotNull() & second.isNotNull(), close)
        .when(actual["day"].isNotNull() & expected["day"].isNotNull(), actual["day"] == expected["day"])
        .otherwise(actual["comparable"] == expected["comparable"])
    )


def words(col: Column) -> Column:
    """Lower-case words of two or more word characters, as a TF-IDF vectoriser sees them."""
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}\p{M}_]{2,}"), F.lit(0))


def guess_language(query: Column, tags: Column) -> Column:
    """arabic, multilingual or english from the query text and tag list."""
    low = F.lower(query)
    return (
        F.when(F.array_contains(tags, "arabic") | low.contains("arabic") | has_high_script(query), "arabic")
        .when(F.arrays_overlap(tags, F.array(F.lit("multilingual"), F.lit("translation"))) | low.contains("multilingual"), "multilingual")
        .otherwise("english")
    )


def guess_task(title: Column, subtitle: Column, tags: Column) -> Column:
    """Task label from tags and title keywords."""

    def tagged(*names: str) -> Column:
        return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))

    title, subtitle = F.lower(title), F.lower(F.coalesce(subtitle, F.lit("")))
    nlp_words = r"nlp|text|sentiment|summarization|corpus"
    vision_words = r"image|detection|vision|object"
    return (
        F.when(tagged("regression", "prediction", "forecast") | title.rlike("price|house"), "regression")
        .when(tagged("nlp", "text", "sentiment", "translation") | title.rlike(nlp_words) | subtitle.rlike(nlp_words), "nlp")
        .when(tagged("image", "cv", "computer-vision", "detection", "segmentation") | title.rlike(vision_words) | subtitle.rlike(vision_words),
              "computer_vision")
        .otherwise("classification")
    )
