"""The star-schema test tables seen as the domain tables the operators expect.

A customer is a player, their nation the club, the region the league, an order
year the season; an order line is an event counted into the stats. Suppliers'
nations host customers' nations in matches. Parts carry names for the matching
operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rollup import (
    add_per90, career_minutes, derive_rates, latest_season, league_span, season_rollup, still_active,
)
from ..operators.scoring import adjust_team_strength, age_weighted, league_weighted, scout_scores
from ..operators.standings import attach_rank, league_table
from ..operators.regression import undervaluation
from ..session import cut_lineage, small_side, spread

PER_SEASON = 120.0
POSITION_OF = {"HOUSEHOLD": "FW", "MACHINERY": "MF", "BUILDING": "DF", "FURNITURE": "GK", "AUTOMOBILE": "XX"}
LEAGUE_FACTOR_OF = {"AFRICA": 1.10, "AMERICA": 1.08, "ASIA": 1.05, "EUROPE": 1.03}
MATCH_RESULT_OF = {"R": "H", "A": "A", "N": "D"}


_schemas: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; its schema is read from the footer once per path."""
    path = f"{sf}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _n(condition: Column) -> Column:
    return F.count_if(condition).cast("double")


def _year(col: str) -> Column:
    return F.year(col).cast("string")


def cust_season(spark: SparkSession, sf: str) -> DataFrame:
    """One row per player and season. Lines are summed before names are joined on."""
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", _year("o_orderdate").alias("season")
    )
    price = F.col("l_extendedprice")
    stats = (
        lines.join(orders, "l_orderkey")
        .groupBy(F.col("o_custkey").alias("c_custkey"), "season")
        .agg(
            F.sum("l_quantity").alias("Min"),
            _n(F.col("l_returnflag") == "R").alias("Gls"),
            _n(F.col("l_returnflag") == "A").alias("Ast"),
            F.count(F.lit(1)).cast("double").alias("Sh"),
            _n(F.col("l_discount") >= 0.05).alias("SoT"),
            _n(F.col("l_linestatus") == "O").alias("Int"),
            _n(F.col("l_tax") >= 0.04).alias("TklW"),
            _n(F.col("l_quantity") < 10).alias("Fls"),
            _n(F.col("l_quantity") >= 40).alias("Fld"),
            _n(F.col("l_linenumber") >= 5).alias("Crs"),
            _n(F.col("l_linestatus") == "F").alias("Saves"),
            _n(F.col("l_returnflag") == "N").alias("GA"),
            _n(price > 50000).alias("SoTA"),
            F.round(F.sum(price * F.col("l_discount")) / 1e4, 8).alias("xG"),
            F.round(F.sum(price * F.col("l_tax")) / 1e4, 8).alias("xA"),
        )
    )
    return stats.join(players_dim(spark, sf), "c_custkey")


def players_dim(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey")
    pos = F.create_map(*[F.lit(x) for kv in POSITION_OF.items() for x in kv])
    age = F.concat_ws("-", (17 + key % 22).cast("string"), F.lpad((key % 365).cast("string"), 3, "0"))
    return table(spark, sf, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        "c_custkey",
        F.col("c_name").alias("Player"),
        F.col("n_name").alias("Squad"),
        F.col("r_name").alias("League"),
        F.try_element_at(pos, F.col("c_mktsegment")).alias("Pos"),
        age.alias("Age"),
        (F.col("c_acctbal") * 1e4).alias("market_value_eur"),
    )


LAST = ("Squad", "Pos", "Age", "market_value_eur")


def rolled(spark: SparkSession, sf: str) -> DataFrame:
    return season_rollup(cust_season(spark, sf), last=LAST)


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """Rolled up, with rates, after the minutes and activity filters.

    The roll-up is stored; all that follows is narrow work on one row per player.
    """
    players = cut_lineage(rolled(spark, sf))
    span = small_side(league_span(players))
    players = career_minutes(derive_rates(players), span, per_season=PER_SEASON)
    return add_per90(still_active(players, span).drop("seasons"))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """A line is a match of the supplier's nation at home against the customer's.

    Both nations are of one region, and a nation does not meet itself. Sides are
    resolved by key; only the small nation table is joined by name. Customers meet
    the orders first, so that the lines are shuffled once less.
    """
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name")
    home = nations.select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("HomeTeam"), F.col("r_name").alias("League")
    )
    away = nations.select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("AwayTeam"), F.col("r_name").alias("_al")
    )
    hosts = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(home, "s_nationkey")
    guests = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(away, "c_nationkey")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"),
        _year("o_orderdate").alias("season"),
    )
    result = F.create_map(*[F.lit(x) for kv in MATCH_RESULT_OF.items() for x in kv])
    return (
        table(spark, sf, "lineitem")
        .join(orders.join(guests, "c_custkey"), "l_orderkey")
        .join(hosts, F.col("l_suppkey") == F.col("s_suppkey"))
        .where((F.col("League") == F.col("_al")) & (F.col("HomeTeam") != F.col("AwayTeam")))
        .select(
            "League", "season", "HomeTeam", "AwayTeam",
            F.try_element_at(result, F.col("l_returnflag")).alias("FTR"),
            F.col("l_linenumber").alias("FTHG"),
            (F.col("l_quantity").cast("int") % 6).alias("FTAG"),
        )
    )


def standings(spark: SparkSession, sf: str) -> DataFrame:
    return league_table(matches(spark, sf), names={})


def current_standings(spark: SparkSession, sf: str) -> DataFrame:
    """Each league's latest season, latest meaning that of its players."""
    every = cut_lineage(standings(spark, sf).select("League", "season", "Squad", "Rk"))
    return every.join(latest_season(every), "League").where(F.col("season") == F.col("latest")).drop("latest")


def with_rank_column(spark: SparkSession, sf: str) -> DataFrame:
    return attach_rank(rated(spark, sf), current_standings(spark, sf))


def strength_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return adjust_team_strength(with_rank_column(spark, sf))


def scored(spark: SparkSession, sf: str, overwrite: bool = True) -> DataFrame:
    return scout_scores(strength_adjusted(spark, sf), overwrite=overwrite)


def valued(spark: SparkSession, sf: str) -> DataFrame:
    return undervaluation(scored(spark, sf))


def master(spark: SparkSession, sf: str) -> DataFrame:
    return league_weighted(age_weighted(valued(spark, sf)), factors=LEAGUE_FACTOR_OF)


# --- names for the matching operators -------------------------------------------

_HEX, _LETTERS = "0123456789abcdef", "bcdfghklmnaeiour"


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    """A name per part: its own name and a made-up surname."""
    surname = F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8), _HEX, _LETTERS)
    first = F.col("p_name")
    # the table is one small file, its names are much work
    return spread(table(spark, sf, "part"), "p_partkey").select(
        "p_partkey", "p_size", "p_retailprice",
        first.alias("first"), surname.alias("surname"),
        F.concat_ws(" ", first, surname).alias("name"),
        F.col("p_brand").alias("club"), F.col("p_type").alias("League"),
    )


def name_values(spark: SparkSession, sf: str) -> DataFrame:
    """Two seasons of values per name."""
    p = part_names(spark, sf)
    year = F.explode(F.array(
        F.struct(F.lit("2023-24").alias("season"), F.lit(1000.0).alias("f")),
        F.struct(F.lit("2024-25").alias("season"), F.lit(1500.0).alias("f")),
    ))
    return p.select("*", year.alias("y")).select(
        F.col("name").alias("player_name_tm"), F.concat(F.col("club"), F.lit(" FC")).alias("club_tm"),
        (F.col("p_retailprice") * F.col("y.f")).alias("market_value_eur"),
        F.col("y.season").alias("season"), F.col("League").alias("league_tm"),
    )


def misspelt_players(spark: SparkSession, sf: str) -> DataFrame:
    """The same people as another source spells them, by part size.

    Kept, a letter lost, words swapped, a middle name added, or mangled; every
    third part size plays for another club.
    """
    how = F.col("p_size") % 5
    s = F.col("surname")
    name = (
        F.when(how == 0, F.col("name"))
        .when(how == 1, F.concat_ws(" ", "first", F.concat(F.substring(s, 1, 2), F.substring(s, 4, 5))))
        .when(how == 2, F.concat_ws(" ", s, F.concat(F.upper(F.substring("first", 1, 1)), F.expr("substring(first, 2)"))))
        .when(how == 3, F.concat_ws(" ", "first", F.lit("de"), s))
        .otherwise(F.concat_ws(" ", "first", F.concat(F.substring(s, 1, 1), F.lit("xx"), F.substring(s, 4, 3), F.lit("yy"))))
    )
    club = F.when(F.col("p_size") % 3 == 0, "Brand#0").otherwise(F.col("club"))
    return part_names(spark, sf).select(
        F.col("p_partkey").alias("id"), name.alias("Player"), club.alias("Squad"), "League"
    )


def name_xg(spark: SparkSession, sf: str) -> DataFrame:
    p = part_names(spark, sf)
    return p.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("year")).select(
        "League", F.col("name").alias("Player"),
        (F.col("year") * F.col("p_size")).cast("string").alias("xG"), F.col("p_size").cast("string").alias("xA"),
    )
