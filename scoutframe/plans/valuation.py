"""The batch valuation: stat tables, values and xG in, scored master table out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import JOIN_KEYS, MIN_MINUTES_PER_SEASON
from ..functions.text import primary_position
from ..operators.matching import attach_xg, match_market_values
from ..operators.merge import star_join
from ..operators.neighbours import similar_players
from ..operators.regression import undervaluation
from ..operators.rollup import (
    add_per90, career_minutes, coerce_numeric, derive_rates, league_span, season_rollup, still_active,
)
from ..operators.scoring import adjust_team_strength, age_weighted, league_weighted, scout_scores
from ..operators.standings import attach_rank
from ..session import c, cut_lineage, small_side


def build_dataset(
    tables: dict[str, DataFrame],
    values: DataFrame | None,
    xg: DataFrame | None = None,
    standings: DataFrame | None = None,
    per_season: float = MIN_MINUTES_PER_SEASON,
    order=("Rk",),
    seasons: int | None = None,
) -> DataFrame | None:
    """One row per (league, player).

    ``tables`` maps a table name to one DataFrame with ``League`` and ``season``
    columns holding every league and season. ``standings`` has (League, season,
    Squad, Rk); each league's latest season is used. ``seasons`` is the number of
    seasons supplied, where one may be empty, and sets the minutes threshold. Order of steps: roll-up,
    position, minutes, activity, xG, per-90, standings, market values.
    """
    wide = star_join(tables)
    if wide is None:
        return None
    wide = coerce_numeric(wide, ("League", "season", *JOIN_KEYS, "Nation", *order))
    players = cut_lineage(season_rollup(wide, order=order))
    span = small_side(league_span(players, supplied=seasons))
    players = derive_rates(players).withColumn("Pos", primary_position(c("Pos")))
    players = career_minutes(players, span, per_season=per_season)
    players = still_active(players, span).drop("last_season", "seasons")
    if xg is not None:
        players = attach_xg(players, xg)
    players = add_per90(players)
    if standings is not None:
        standings = standings.join(span.drop("n_seasons"), "League").where(c("season") == c("latest"))
    players = attach_rank(players, standings)
    if values is None:
        return players.withColumn("market_value_eur", F.lit(None).cast("double"))
    return match_market_values(players, values)


def score_players(players: DataFrame, factors: dict[str, float] | None = None) -> DataFrame:
    """Team strength, pillar and scout scores, undervaluation, age and league factors."""
    players = cut_lineage(players)  # scored in several passes, so the joins run once
    rated = undervaluation(scout_scores(adjust_team_strength(players)))
    return league_weighted(age_weighted(rated), factors=factors)


def value_players(tables, values, xg=None, standings=None, factors=None, **options) -> DataFrame | None:
    """The whole job, neighbours included."""
    players = build_dataset(tables, values, xg, standings, **options)
    if players is None:
        return None
    return similar_players(score_players(players, factors))
