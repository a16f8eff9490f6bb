"""A stored season roll-up that new seasons are merged into.

Two tables lie below one path. ``partials`` has a row per league, season and
player with mergeable sums and last values, in a directory per league and season;
``totals`` has the roll-up, in a directory per league. Loading seasons replaces
their partials, so a season loaded again takes the place of what it was, and then
the totals of the leagues concerned, from partials alone: stat rows of seasons
that did not change are never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SUM_STATS
from ..session import c, small_side
from ..sources.catalog import read_table, store_tables
from .rollup import season_rollup

LAST = ("Squad", "Pos", "Age", "Nation")


def season_partials(rows: DataFrame, stats=SUM_STATS, last=LAST, order=("Rk",)) -> DataFrame:
    """One row per league, season and player; the same rules as the roll-up of all seasons."""
    seasonal = season_rollup(rows, ("League", "season", "Player"), stats=stats, last=last, order=order)
    return seasonal.drop("seasons", "single_season", "last_season")


def merge_seasons(spark: SparkSession, path: str, rows: DataFrame, stats=SUM_STATS, last=LAST, order=("Rk",)) -> None:
    """Take the seasons in ``rows`` in; each replaces what was stored of it."""
    store_tables({"partials": season_partials(rows, stats, last, order)}, path)
    leagues = rows.select(c("League")).distinct()
    partials = read_table(spark, path, "partials").join(small_side(leagues), "League", "left_semi")
    totals = season_rollup(partials, stats=stats, last=last, order=())
    store_tables({"totals": totals}, path, keys=("League",))


def stored_rollup(spark: SparkSession, path: str, leagues=None) -> DataFrame:
    df = spark.read.parquet(f"{path}/table_type=totals").withColumn("League", c("League").cast("string"))
    return df if leagues is None else df.where(c("League").isin(*leagues))
