"""Text to number. Whatever does not parse is NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(col: Column) -> Column:
    """Coerce a text column to double; anything but a plain decimal is NULL."""
    text = col.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def clean_double(col: Column) -> Column:
    """NaN to NULL for a column that is numeric already."""
    d = col.cast("double")
    return F.when(~F.isnan(d), d)


def comma_number(col: Column) -> Column:
    """'1,234' -> 1234.0."""
    return to_number(F.replace(col.cast("string"), F.lit(","), F.lit("")))


def parse_age(col: Column) -> Column:
    """Years of 'years-days', '25' or 25."""
    return to_number(F.substring_index(F.trim(col.cast("string")), "-", 1))


def parse_money(col: Column) -> Column:
    """'€12.50m', '€500k', '€500Th.', '-' to euros."""
    raw = F.trim(F.replace(F.replace(col, F.lit("€"), F.lit("")), F.lit(","), F.lit(".")))

    def digits(x: Column) -> Column:
        return to_number(F.regexp_replace(x, r"[^0-9.]", ""))

    return (
        F.when(col.isNull() | col.isin("", "-"), F.lit(None).cast("double"))
        .when(F.contains(raw, F.lit("m")), digits(F.substring_index(raw, "m", 1)) * 1_000_000)
        .when(
            F.contains(raw, F.lit("Th.")) | F.contains(F.lower(raw), F.lit("k")),
            digits(raw) * 1_000,
        )
        .otherwise(to_number(raw))
    )


def or_zero(col: Column) -> Column:
    """Number or 0.0 for NULL, '' and text that is no number."""
    return F.coalesce(to_number(col), F.lit(0.0))
