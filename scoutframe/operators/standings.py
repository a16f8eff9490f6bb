"""League tables from match results, and the club's rank on each player."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TEAM_NAMES
from ..functions.parse import clean_double, to_number
from ..functions.text import mapped
from ..session import c, small_side

REQUIRED = ("HomeTeam", "AwayTeam", "FTR")


def known_results(matches: DataFrame) -> DataFrame:
    missing = [x for x in REQUIRED if x not in matches.columns]
    if missing:
        raise ValueError(f"match results lack {missing}")
    return matches.where(
        F.col("FTR").isin("H", "A", "D")
        & F.col("HomeTeam").isNotNull()
        & F.col("AwayTeam").isNotNull()
    )


def map_team(df: DataFrame, team: str, names: dict[str, str] | None = None) -> DataFrame:
    table = TEAM_NAMES if names is None else names
    return df.withColumn(team, mapped(c(team), table, c(team)))


def league_table(matches: DataFrame, by=("League", "season"), names: dict[str, str] | None = None) -> DataFrame:
    """Each match gives two rows; points, goal difference and rank per team.

    Goals count only when both goal columns are there. Equal (Pts, GD, GF) are
    ordered by name. The rank window runs over the finished table, whose groups
    are the clubs of one league season.
    """
    by = [b for b in by if b in matches.columns]
    games = known_results(matches)
    kinds = dict(games.dtypes)

    def goals(name: str):
        if not {"FTHG", "FTAG"} <= set(games.columns):
            return F.lit(0)
        v = to_number(c(name)) if kinds[name] == "string" else clean_double(c(name))
        return F.coalesce(v, F.lit(0.0)).cast("long")

    def side(team, won, lost, scored, conceded):
        return F.struct(
            c(team).alias("Squad"),
            (F.col("FTR") == won).cast("long").alias("W"),
            (F.col("FTR") == "D").cast("long").alias("D"),
            (F.col("FTR") == lost).cast("long").alias("L"),
            goals(scored).cast("long").alias("GF"),
            goals(conceded).cast("long").alias("GA"),
        )

    sides = F.array(side("HomeTeam", "H", "A", "FTHG", "FTAG"), side("AwayTeam", "A", "H", "FTAG", "FTHG"))
    table = (
        games.select(*[c(b) for b in by], F.explode(sides).alias("s"))
        .groupBy(*[c(b) for b in by], F.col("s.Squad").alias("Squad"))
        .agg(*[F.sum(f"s.{x}").alias(x) for x in ("W", "D", "L", "GF", "GA")])
        .withColumn("Pts", F.col("W") * 3 + F.col("D"))
        .withColumn("GD", F.col("GF") - F.col("GA"))
    )
    table = map_team(table, "Squad", names)
    order = Window.partitionBy(*[c(b) for b in by]).orderBy(
        F.desc("Pts"), F.desc("GD"), F.desc("GF"), F.asc("Squad")
    )
    return table.withColumn("Rk", F.row_number().over(order))


def attach_rank(df: DataFrame, standings: DataFrame | None, league="League", squad="Squad", order: str | None = None) -> DataFrame:
    """The club's rank as ``league_position``; unknown and multi-club squads stay NULL.

    A squad listed twice takes the row loaded last: the last by ``order``, which is ``loaded``
    where the table has it; a table without any row order, such as a computed one, takes the
    highest rank. The reader of standings files gives one row per squad, the last one loaded. ``standings`` covers one season per league; without
    any, the column is all NULL.
    """
    if standings is None:
        return df.withColumn("league_position", F.lit(None).cast("double"))
    order = order or ("loaded" if "loaded" in standings.columns else "Rk")
    one = standings.groupBy(c(league), c(squad)).agg(
        F.max_by(c("Rk"), c(order)).cast("double").alias("league_position")
    )
    return df.join(small_side(one), [league, squad], "left")
