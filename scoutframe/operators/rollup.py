"""Season roll-up, derived rates, playing-time and activity filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MIN_MINUTES_PER_SEASON, PER90_STATS, SUM_STATS
from ..functions.parse import clean_double, comma_number, to_number
from ..functions.rates import per90, ratio
from ..session import c, small_side

TEXT_COLUMNS = ("League", "season", "Player", "Squad", "Pos", "Age", "Nation")


def coerce_numeric(df: DataFrame, keep=TEXT_COLUMNS) -> DataFrame:
    """Every column but the named ones becomes a double, unparsable text NULL."""

    def one(name: str, kind: str):
        if name in keep:
            return c(name)
        return (to_number(c(name)) if kind == "string" else clean_double(c(name))).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def named_players(df: DataFrame, player="Player") -> DataFrame:
    return df.where(c(player).isNotNull() & (c(player) != ""))


def min_minutes(df: DataFrame, minutes="Min", threshold: float = MIN_MINUTES_PER_SEASON) -> DataFrame:
    """Per-table playing-time filter; a table without minutes passes whole."""
    if minutes not in df.columns:
        return df
    if dict(df.dtypes)[minutes] == "string":
        df = df.withColumn(minutes, comma_number(c(minutes)))
    return df.where(F.coalesce(c(minutes), F.lit(0.0)) >= threshold)


def season_rollup(
    df: DataFrame,
    keys=("League", "Player"),
    season="season",
    stats=SUM_STATS,
    last=("Squad", "Pos", "Age", "Nation"),
    order=("Rk",),
) -> DataFrame:
    """Sum counts over seasons; text fields are the last ones that are not NULL.

    The sum of nothing is 0. One partial/final aggregation: the last value comes
    from ``max_by`` over (season, order...), ``order`` being numbers of rows inside a
    season where the table has them. Rows equal in these go by their text fields, so
    the result never depends on how rows arrive. ``seasons`` lists a player's seasons,
    which also tells the single-season players and the last season.
    """
    keys = list(keys)
    ties = [c(x) for x in last if x in df.columns and x not in keys]
    rank = F.struct(c(season), *[to_number(c(o).cast("string")).alias(o) for o in order if o in df.columns], *ties)
    aggs = [F.coalesce(F.sum(c(s).cast("double")), F.lit(0.0)).alias(s) for s in stats if s in df.columns]
    for name in last:
        if name in df.columns and name not in keys:
            aggs.append(F.max_by(c(name), F.when(c(name).isNotNull(), rank)).alias(name))
    aggs.append(F.array_sort(F.collect_set(c(season))).alias("seasons"))
    out = df.where(c(keys[-1]).isNotNull()).groupBy(*[c(k) for k in keys]).agg(*aggs)
    return out.withColumns(
        {"single_season": F.size("seasons") == 1, "last_season": F.array_max("seasons")}
    )


# derived name -> (numerator, denominator terms, scale); built where the inputs exist
RATES = {
    "Cmp%": ("Cmp", ("Att",), 100.0),
    "DrbSucc%": ("Succ", ("Att_drb",), 100.0),
    "DuelsWon%": ("AerWon", ("AerWon", "AerLost"), 100.0),
    "Save%": ("Saves", ("Saves", "GA"), 100.0),
    "PSxG/SoT": ("PSxG", ("SoTA",), 1.0),
}


def derive_rates(df: DataFrame, rates=None) -> DataFrame:
    """Rates re-derived from the summed counts."""
    for name, (num, den, scale) in (RATES if rates is None else rates).items():
        if num in df.columns and all(d in df.columns for d in den):
            total = sum((c(d) for d in den[1:]), c(den[0]))
            df = df.withColumn(name, ratio(c(num), total, scale))
    return df


def add_per90(df: DataFrame, stats=PER90_STATS, minutes="Min") -> DataFrame:
    """``<stat>_p90`` for every stat present; NULL at zero minutes."""
    if minutes not in df.columns:
        return df
    m, have = c(minutes), set(df.columns)
    new = {f"{s}_p90": per90(c(s), m) for s in stats if s in have}
    if "AerWon" in have:
        new["DuelsWon_p90"] = per90(c("AerWon"), m)
    return df.withColumns(new) if new else df


def league_span(players: DataFrame, league="League", supplied: int | None = None) -> DataFrame:
    """Per league the number of seasons and the latest one, from a roll-up.

    ``supplied`` is the number of seasons given to the job where some may hold no
    rows; each league then counts that many.
    """
    span = (
        players.select(c(league), F.explode("seasons").alias("s"))
        .groupBy(c(league))
        .agg(F.size(F.collect_set("s")).alias("n_seasons"), F.max("s").alias("latest"))
    )
    return span if supplied is None else span.withColumn("n_seasons", F.lit(supplied))


def career_minutes(
    df: DataFrame,
    season_counts: DataFrame,
    league="League",
    minutes="Min",
    per_season: float = MIN_MINUTES_PER_SEASON,
) -> DataFrame:
    """Minutes over all seasons against ``per_season`` times the league's seasons.

    ``season_counts`` is (league, n_seasons), one row per league; pass it through
    ``small_side`` when it may be broadcast.
    """
    n = season_counts.select(c(league), c("n_seasons").alias("_n"))
    return (
        df.join(n, league)
        .where(F.coalesce(c(minutes), F.lit(0.0)) >= per_season * F.col("_n"))
        .drop("_n")
    )


def latest_season(df: DataFrame, league="League", season="season") -> DataFrame:
    return df.groupBy(c(league)).agg(F.max(c(season)).alias("latest"))


def active_in_latest(df: DataFrame, standard: DataFrame, league="League", player="Player", season="season") -> DataFrame:
    """Players of their league's latest season (semi-join on the standard table)."""
    latest = small_side(latest_season(standard, league, season))
    now = (
        standard.where(c(player).isNotNull())
        .join(latest, league)
        .where(c(season) == F.col("latest"))
        .select(c(league), c(player))
        .distinct()
    )
    return df.join(now, [league, player], "left_semi")


def still_active(df: DataFrame, latest: DataFrame, league="League") -> DataFrame:
    """The same filter on a roll-up, whose ``last_season`` makes the semi-join needless.

    ``latest`` is (league, latest), one row per league.
    """
    now = latest.select(c(league), F.col("latest").alias("_latest"))
    return df.join(now, league).where(F.col("last_season") == F.col("_latest")).drop("_latest")
