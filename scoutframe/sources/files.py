"""CSV and Parquet sources and sinks; the key of a legacy file lies in its name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SEASONS
from ..functions.parse import comma_number, to_number
from ..operators.rollup import min_minutes, named_players
from ..session import c
from .incremental import file_exists

# --- fixed values: column order of the stored stat files ------------------------
STAT_FILE_COLUMNS = {
    "stats_standard": (
        "Rk", "Player", "Nation", "Pos", "Squad", "Age", "Born", "MP", "Starts", "Min", "90s",
        "Gls", "Ast", "G+A", "G-PK", "PK", "PKatt", "CrdY", "CrdR",
        "Gls.1", "Ast.1", "G+A.1", "G-PK.1", "G+A-PK", "Matches",
    ),
    "stats_keeper": (
        "Rk", "Player", "Nation", "Pos", "Squad", "Age", "Born", "MP", "Starts", "Min", "90s",
        "GA", "GA90", "SoTA", "Saves", "Save%", "W", "D", "L", "CS", "CS%",
        "PKatt", "PKA", "PKsv", "PKm", "Save%.1", "Matches",
    ),
    "stats_keeper_adv": (
        "Rk", "Player", "Nation", "Pos", "Squad", "Age", "Born", "90s", "GA", "PKA", "FK", "CK",
        "OG", "PSxG", "PSxG/SoT", "PSxG+/-", "/90", "Cmp", "Att", "Cmp%", "Att (GK)", "Thr",
        "Launch%", "AvgLen", "Att.1", "Launch%.1", "AvgLen.1", "Opp", "Stp", "Stp%", "#OPA",
        "#OPA/90", "AvgDist", "Matches",
    ),
}
NO_SOURCE = "No cache"


def text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def unique_names(names: list[str]) -> list[str]:
    """Repeated headers get .1, .2, ... from the second copy on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Header of a CSV as Spark sees it, repeated names made unique."""
    row = spark.read.option("header", False).csv(path).limit(1).head()
    return unique_names([v or f"_c{i}" for i, v in enumerate(row)])


def named(pattern: str, group: int):
    """A part of the file's name; names come with blanks and the like as %20."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(name, pattern, group)


def read_csv(spark: SparkSession, path: str, columns=None, modified_after: str | None = None) -> DataFrame:
    """All-text read with a positional schema, so repeated headers are safe.

    Where no header is repeated, a file whose header differs is an error.
    ``modified_after`` keeps only files written since, before any is opened.
    """
    columns = list(columns or header_of(spark, path))
    plain = not any(re.fullmatch(r".+\.\d+|_c\d+", x) for x in columns)
    reader = spark.read.schema(text_schema(columns)).option("header", True).option("enforceSchema", not plain)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return reader.csv(path)


def read_stat_table(
    spark: SparkSession, folder: str, table: str, columns=None, modified_after: str | None = None
) -> DataFrame:
    """Every ``<source>_<league>_<table>_<season>.csv`` of one table as one DataFrame."""
    path = f"{folder}/*_{table}_[0-9]*.csv"
    columns = columns or STAT_FILE_COLUMNS.get(table) or header_of(spark, path)
    raw = read_csv(spark, path, columns, modified_after)
    pattern = rf"^[^_]+_(.+)_{table}_(\d{{4}}-\d{{2}})\.csv$"
    return raw.select(
        named(pattern, 1).alias("League"),
        named(pattern, 2).alias("season"),
        *[c(x) for x in raw.columns],
    )


def clean_stat_table(df: DataFrame, table: str, threshold: float = 900) -> DataFrame:
    """What is stored of a fetched table: named players, enough minutes, xAG as xA."""
    if table == "stats_standard" and "xAG" in df.columns and "xA" not in df.columns:
        df = df.withColumnRenamed("xAG", "xA")
    df = named_players(df)
    if "Min" in df.columns:
        df = min_minutes(df.withColumn("Min", comma_number(c("Min"))), threshold=threshold)
    return df


def read_values(spark: SparkSession, folder: str, seasons=SEASONS) -> DataFrame:
    """All value files of the wanted seasons with the league taken from the name."""
    columns = ("player_name_tm", "club_tm", "season", "market_value_eur")
    raw = read_csv(spark, f"{folder}/*_values_*_[0-9]*.csv", columns)
    league = named(r"_values_(.+)_\d{4}-\d{2}\.csv$", 1)
    return value_table(
        raw.withColumn("league_tm", league).withColumn(
            "market_value_eur", to_number(c("market_value_eur"))
        ),
        seasons,
    )


def value_table(df: DataFrame, seasons=SEASONS) -> DataFrame:
    """Union of seasons and leagues: wanted seasons only, no NULL values, five columns."""
    return (
        df.where(c("season").isin(*seasons))
        .dropna(subset=["market_value_eur"])
        .select("player_name_tm", "club_tm", "market_value_eur", "season", "league_tm")
    )


def read_xg(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """xG files ``<prefix>_<league>_<season>.csv``; others in the folder are not read."""
    columns = ("Player", "Squad", "Pos", "Min", "xG", "xA", "season")
    raw = read_csv(spark, f"{folder}/{prefix}_*_[0-9]*.csv", columns)
    league = named(rf"^\Q{prefix}\E_(.+)_\d{{4}}-\d{{2}}\.csv$", 1)
    return raw.where(league != "").select(
        league.alias("League"), "Player", "Squad", "Pos",
        *[to_number(c(x)).alias(x) for x in ("Min", "xG", "xA")], "season",
    )


def read_standings(spark: SparkSession, folder: str) -> DataFrame:
    """Standings, one row per squad: of a squad listed twice in a file the row further down counts."""
    raw = read_stat_table(spark, folder, "standings", ("Rk", "Squad"))
    raw = raw.withColumn("Rk", c("Rk").try_cast("int")).withColumn("loaded", F.monotonically_increasing_id())
    one = raw.groupBy("League", "season", "Squad").agg(F.max_by("Rk", "loaded").alias("Rk"))
    return one.select("League", "season", "Rk", "Squad")


def read_matches(spark: SparkSession, path: str, required=("HomeTeam", "AwayTeam", "FTR")) -> DataFrame:
    """Match results; a file set without the required columns is an error."""
    df = read_csv(spark, path)
    missing = [x for x in required if x not in df.columns]
    if missing:
        raise ValueError(f"match results lack {missing}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", by=("League", "season")) -> None:
    """Partitioned sink; each league and season in ``df`` replaces its directory, others stay."""
    keys = [b for b in by if b in df.columns]
    if keys:
        df = df.hint("rebalance", *keys)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*keys) if keys else writer).save(path)


def source_freshness(spark: SparkSession, path: str) -> DataFrame:
    """Latest modification time of the files as 'd MMM yyyy, HH:mm'; a path without files says so."""
    if not file_exists(spark, path):
        return spark.range(1).select(F.lit(NO_SOURCE).alias("freshness"))
    files = spark.read.format("binaryFile").load(path).select("modificationTime")
    latest = F.date_format(F.max("modificationTime"), "d MMM yyyy, HH:mm")
    return files.agg(F.coalesce(latest, F.lit(NO_SOURCE)).alias("freshness"))
