"""A stored catalogue of stat tables: ``table_type=…/League=…/season=…`` directories.

One reader serves every table; filters on league and season, also those that come
from a joined table, prune directories before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import SMALL_SIDE_ROWS, c
from .files import write_table

KEYS = ("League", "season")


def store_tables(tables: dict[str, DataFrame], root: str, keys=KEYS) -> None:
    """Each table below ``root``; a league and season in it replaces what was stored of them."""
    for name, df in tables.items():
        write_table(df, f"{root}/table_type={name}", by=keys)


def read_table(spark: SparkSession, root: str, table: str, schema=None, leagues=None, seasons=None) -> DataFrame:
    """One table of the catalogue, of the named leagues and seasons only; keys are text.

    Without ``schema`` the stored one is looked up, with key columns read as text either way.
    """
    path = f"{root}/table_type={table}"
    if schema is None:
        stored = spark.read.option("recursiveFileLookup", True).parquet(path).schema
        schema = stored.add("League", "string").add("season", "string")
    df = spark.read.schema(schema).parquet(path)
    if leagues is not None:
        df = df.where(c("League").isin(*leagues))
    if seasons is not None:
        df = df.where(c("season").isin(*seasons))
    return df


def only_keys(df: DataFrame, wanted: DataFrame, keys=KEYS) -> DataFrame:
    """Rows of the (league, season) pairs in ``wanted``, a small filtered table: pruned when the query runs.

    ``wanted`` is broadcast after a check of its size; its own filters are what
    dynamic partition pruning starts from.
    """
    names = [k for k in keys if k in wanted.columns]
    pairs = wanted.select(*[c(k) for k in names])
    few = pairs.limit(SMALL_SIDE_ROWS + 1).count() <= SMALL_SIDE_ROWS
    return df.join(F.broadcast(pairs) if few else pairs, names, "left_semi")
