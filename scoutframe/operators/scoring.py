"""Team-strength adjustment, min-max normalisation, pillar and scout scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PILLARS, POSITIONS, STRENGTH_STATS, STRENGTH_STEP, pillars_of, stats_of
from ..functions.rates import age_multiplier, league_factor
from ..functions.text import primary_position
from ..session import c, small_side


def club_counts(df: DataFrame, league="League", rank="league_position") -> DataFrame:
    """Clubs per league: the lowest rank among the rated players."""
    return df.groupBy(c(league)).agg(F.max(c(rank)).cast("double").alias("n_clubs"))


def adjust_team_strength(
    df: DataFrame, league="League", pos="Pos", rank="league_position",
    stats=None, step: float = STRENGTH_STEP,
) -> DataFrame:
    """Defensive stats up by ``step`` in the bottom half of a league, down in the top half."""
    if league not in df.columns or rank not in df.columns:
        return df
    half = small_side(club_counts(df, league, rank).withColumn("_half", F.col("n_clubs") / 2))
    factor = (
        F.when(c(rank) > F.col("_half"), 1 + step)
        .when(c(rank) <= F.col("_half"), 1 - step)
        .otherwise(1.0)
    )
    new = {
        s: F.when(c(pos) == p, c(s) * factor).otherwise(c(s))
        for p, names in (STRENGTH_STATS if stats is None else stats).items()
        for s in names
        if s in df.columns
    }
    joined = df.join(half.drop("n_clubs"), league, "left")
    return joined.withColumns(new).select(*[c(x) for x in df.columns])


def minmax(df: DataFrame, league: str | None = "League", pos="Pos", overwrite=False) -> DataFrame:
    """Min-max of each position's own stats within (league, position), NULL as 0.

    Adds ``<stat>_norm``; with ``overwrite`` the stat itself is replaced. Rows
    outside the scored positions drop out; a constant stat becomes 0. The
    extremes are one aggregation with a row per group; only that is joined back.
    """
    keys = ([league] if league and league in df.columns else []) + [pos]
    df = df.withColumn(pos, primary_position(c(pos))).where(c(pos).isin(*POSITIONS))
    have = set(df.columns)
    used = {s: [p for p in POSITIONS if s in stats_of(p)] for p in POSITIONS for s in stats_of(p)}
    present = [s for s in used if s in have]
    if not present:
        return df
    # generated column lists are written as SQL text: one call each instead of dozens
    filled = {s: f"coalesce(`{s}`, 0D)" for s in present}
    bounds = df.groupBy(*[c(k) for k in keys]).agg(
        *[F.expr(f"min({v}) AS `_lo_{s}`") for s, v in filled.items()],
        *[F.expr(f"max({v}) AS `_hi_{s}`") for s, v in filled.items()],
    )
    joined = df.join(small_side(bounds), keys)

    def norm(s: str) -> str:
        lo, hi = f"`_lo_{s}`", f"`_hi_{s}`"
        mine = ", ".join(f"'{p}'" for p in used[s])
        return (
            f"CASE WHEN `{pos}` IN ({mine}) THEN "
            f"CASE WHEN {hi} > {lo} THEN ({filled[s]} - {lo}) / nullif({hi} - {lo}, 0D) ELSE 0D END END"
        )

    out = [f"`{x}`" for x in df.columns]
    if overwrite:
        out = [f"coalesce({norm(x)}, `{x}`) AS `{x}`" if x in present else f"`{x}`" for x in df.columns]
    else:
        out += [f"{norm(s)} AS `{s}_norm`" for s in present]
    return joined.selectExpr(*out)


def add_scores(df: DataFrame, pos="Pos", suffix="_norm") -> DataFrame:
    """Five pillar scores and their sum, as generated column expressions."""
    have = set(df.columns)

    def pillar(name: str) -> str:
        cases = []
        for p in POSITIONS:
            rule = next(x for x in pillars_of(p) if x.name == name)
            terms = [f"`{s}{suffix}` * {w}D" for s, w in rule.stats if f"{s}{suffix}" in have]
            cases.append(f"WHEN '{p}' THEN ({' + '.join(['0D', *terms])}) * {float(rule.weight)}D")
        return f"CASE `{pos}` {' '.join(cases)} END AS score_{name}"

    scored = df.selectExpr("*", *[pillar(n) for n in PILLARS])
    return scored.selectExpr("*", " + ".join(f"score_{n}" for n in PILLARS) + " AS scout_score")


def scout_scores(df: DataFrame, league: str | None = "League", pos="Pos", overwrite=True) -> DataFrame:
    """Normalise and score; ``overwrite`` leaves the normalised value in the stat column."""
    normed = minmax(df, league, pos, overwrite=False)
    scored = add_scores(normed, pos)
    if not overwrite:
        return scored
    kept, stats = scored.columns, {x for x in df.columns if f"{x}_norm" in scored.columns}
    return scored.selectExpr(
        *[
            f"coalesce(`{x}_norm`, `{x}`) AS `{x}`" if x in stats else f"`{x}`"
            for x in kept
            if not (x.endswith("_norm") and x[:-5] in stats)
        ]
    )


def age_weighted(df: DataFrame, age="Age", uv="uv_score") -> DataFrame:
    if uv not in df.columns:
        return df.withColumn("uv_score_age_weighted", F.lit(0.0))
    weight = age_multiplier(c(age)) if age in df.columns else F.lit(1.0)
    return df.withColumn("uv_score_age_weighted", c(uv) * weight)


def league_weighted(df: DataFrame, league="League", factors=None) -> DataFrame:
    """Keep the league factor as a column and apply it to the age-weighted score."""
    factor = league_factor(c(league), factors) if league in df.columns else F.lit(1.0)
    df = df.withColumn("league_quality_multiplier", factor)
    if "uv_score_age_weighted" in df.columns:
        df = df.withColumn(
            "uv_score_age_weighted",
            F.col("uv_score_age_weighted") * F.col("league_quality_multiplier"),
        )
    return df
