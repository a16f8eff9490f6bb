"""One wide row per player and season out of nine stat tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import JOIN_KEYS, STAT_TABLES, TABLE_DROP_SUFFIXES, TABLE_DROPS, TABLE_RENAMES
from ..session import c

SCOPE = ("League", "season")


def is_summary(squad: Column) -> Column:
    """'2 Clubs' / '2 teams': the season total of a player who moved."""
    return F.coalesce(squad.rlike(r"^\d+\s+([Cc]lub|[Tt]eam)"), F.lit(False))


def dedup_multiclub(df: DataFrame, keys=("League", "season", "Player"), squad="Squad") -> DataFrame:
    """Where a player has a summary row keep only that, otherwise keep every row.

    An anti-join against the distinct players with a summary row: no group is
    ever gathered, and a moved player's club rows simply drop out.
    """
    keys = [k for k in keys if k in df.columns]
    flag = is_summary(c(squad))
    movers = df.where(flag).select(*[c(k) for k in keys]).distinct()
    singles = df.where(~flag).join(movers, keys, "left_anti")
    return df.where(flag).unionByName(singles.select(*[c(x) for x in df.columns]))


def first_seen(df: DataFrame, keys, order) -> DataFrame:
    """First row per key in the given order, by aggregation (no window, no sort)."""
    keys, order = list(keys), list(order)
    rest = [x for x in df.columns if x not in keys]
    picked = F.min_by(F.struct(*[c(x) for x in rest]), F.struct(*[c(x) for x in order]))
    out = df.groupBy(*[c(k) for k in keys]).agg(picked.alias("_row"))
    return out.select(*[c(k) for k in keys], "_row.*").select(*[c(x) for x in df.columns])


def prune_table(df: DataFrame, table: str) -> DataFrame:
    """Apply the canonical-source rules: drops, suffix drops, renames."""
    suffixes = TABLE_DROP_SUFFIXES.get(table, ())
    gone = set(TABLE_DROPS.get(table, ()))
    renames = TABLE_RENAMES.get(table, {})
    return df.select(
        *[
            c(x).alias(renames.get(x, x))
            for x in df.columns
            if x not in gone and not any(x.endswith(s) for s in suffixes)
        ]
    )


def star_join(tables: dict[str, DataFrame], scope=SCOPE, keys=JOIN_KEYS, dedup=True) -> DataFrame | None:
    """Left-join every stat table onto the standard one.

    Only columns not there yet are taken, so the first table to bring a column
    wins. Keys are matched null-safely. All joins share one key list: each table
    is shuffled once and the running result keeps its partitioning.
    """
    if "stats_standard" not in tables:
        return None
    all_keys = [*scope, *keys]
    prepared = {}
    for name in STAT_TABLES:
        if name in tables:
            t = dedup_multiclub(tables[name]) if dedup else tables[name]
            prepared[name] = prune_table(t, name)
    out = prepared.pop("stats_standard")
    for name, right in prepared.items():
        fresh = [x for x in right.columns if x not in out.columns and x not in all_keys]
        if not fresh:
            continue
        r = right.select(
            *[c(k).alias(f"_r_{k}") for k in all_keys], *[c(x) for x in fresh]
        )
        cond = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_r_{k}")) for k in all_keys])
        out = out.join(r, cond, "left").drop(*[f"_r_{k}" for k in all_keys])
    return out


def union_aligned(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column missing in one frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
