"""Zero-safe rates and the multipliers of the final score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LEAGUE_FACTORS
from .parse import parse_age


def ratio(num: Column, den: Column, scale: float = 1.0) -> Column:
    """``num / den * scale``, NULL where the denominator is 0 or missing."""
    return num / F.nullif(den.cast("double"), F.lit(0.0)) * scale


def per90(stat: Column, minutes: Column) -> Column:
    return ratio(stat, minutes, 90.0)


def age_multiplier(age: Column) -> Column:
    """1.0 from 29 on (or unknown), rising logarithmically below, at most 1.5."""
    years = parse_age(age)
    # greatest() keeps the logarithm's argument positive where the branch is not taken
    boost = F.ln(F.greatest(29.0 - years, F.lit(1.0))) / F.ln(F.lit(12.0))
    return F.when(years.isNull() | (years >= 29), 1.0).otherwise(
        F.least(F.lit(1.5), 1.0 + 0.30 * F.greatest(F.lit(0.0), boost))
    )


def league_factor(league: Column, factors: dict[str, float] | None = None) -> Column:
    table = LEAGUE_FACTORS if factors is None else factors
    entries = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*entries), league), F.lit(1.0))


def traffic_band(pct: Column) -> Column:
    """Thirds of the percentile scale: below 33, below 66, the rest."""
    return F.when(pct < 33, "red").when(pct < 66, "amber").otherwise("green")
