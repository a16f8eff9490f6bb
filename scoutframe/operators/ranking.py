"""Exact ranks by a range-partitioned prefix sum.

A rank needs to know how many values lie below. Values are rounded to
``decimals`` places and counted per distinct value. The distinct values are dealt
to ranges whose cut points are sampled from them, so ranges follow the data
whatever its tails and ties; counts accumulate inside each range, and each range
starts from the total of those before it. A range list has no more rows than
there are ranges and groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import c, cut_lineage, ships_with_tasks, small_side

ships_with_tasks(__name__)


def running_counts(batches, by: list[str]):
    """Adds ``_inside``: rows of the group in this sorted range below each value."""
    held = None  # the last group and what it has so far
    for pdf in batches:
        if not len(pdf):
            continue
        if by:
            group = pdf[by].apply(tuple, axis=1)
            new = (group != group.shift()).to_numpy()
            same = held is not None and _equal(group.iloc[0], held[0])
        else:
            group, new = None, (pdf.index == pdf.index[0])
            same = held is not None
        sums = pdf["ties"].cumsum()
        first = (sums - pdf["ties"]).where(new).ffill()
        inside = sums - pdf["ties"] - first
        if same:
            opening = pd.Series(new).cumsum().to_numpy() == 1
            inside = inside + opening * held[1]
        pdf["_inside"] = inside.astype("int64")
        total = int(pdf["_inside"].iloc[-1] + pdf["ties"].iloc[-1])
        held = (group.iloc[-1] if by else None, total)
        yield pdf


def _equal(a: tuple, b: tuple) -> bool:
    return all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def value_counts(df: DataFrame, value: str, by=(), decimals: int = 9) -> DataFrame:
    """Per distinct value: ``ties`` rows equal to it, ``below`` smaller, ``n`` in all."""
    by = list(by)
    keys = [c(b) for b in by]
    distinct = (
        df.where(c(value).isNotNull())
        .groupBy(*keys, F.round(c(value), decimals).alias(value))
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    order = [*keys, c(value)]
    ranged = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select(*[c(x) for x in ranged.columns], F.spark_partition_id().alias("_range"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    counted = cut_lineage(ranged.mapInPandas(lambda it: running_counts(it, by), f"{kinds}, _inside long"))

    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*keys, "_range").agg(F.sum("ties").alias("_in"))
    ranges = totals.select(
        *[c(b).alias(f"_g{i}") for i, b in enumerate(by)],
        F.col("_range").alias("_r"),
        F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"),
        F.sum("_in").over(Window.partitionBy(*keys)).alias("n"),
    )
    met = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        met = met & c(b).eqNullSafe(F.col(f"_g{i}"))
    return counted.join(small_side(ranges), met).select(
        *keys, c(value), "ties", (F.col("_before") + F.col("_inside")).alias("below"), "n"
    )


def with_rank(df: DataFrame, value: str, out: str, expr, by=(), decimals: int = 9) -> DataFrame:
    """Add ``out = expr(below, ties, n)`` to every row; NULL values get NULL."""
    by = list(by)
    counts = value_counts(df, value, by, decimals)
    table = counts.select(
        *[c(b) for b in by],
        c(value).alias("_v"),
        expr(F.col("below"), F.col("ties"), F.col("n")).alias(out),
    )
    keyed = df.withColumn("_v", F.round(c(value), decimals))
    return keyed.join(table, by + ["_v"], "left").select(*[c(x) for x in df.columns], c(out))


def average_percent(below: Column, ties: Column, n: Column) -> Column:
    """Average-tie percent rank in (0, 100]."""
    return (below + (ties + 1) / 2) / n * 100


def peer_percentile(below: Column, ties: Column, n: Column) -> Column:
    """Lowest-tie rank of a value appended to its own population, in percent."""
    return (below + 1) / (n + 1) * 100


def exact_median(df: DataFrame, value: str, by=(), out="median", decimals: int = 9) -> DataFrame:
    """Median per group from the counts: the mean of the one or two middle values."""
    by = list(by)
    counts = value_counts(df, value, by, decimals)
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    reach = F.col("below") + F.col("ties")

    def holds(position: Column) -> Column:
        return (F.col("below") < position) & (position <= reach)

    return (
        counts.groupBy(*[c(b) for b in by])
        .agg(
            (
                (F.max(F.when(holds(low), c(value))) + F.max(F.when(holds(high), c(value)))) / 2
            ).alias(out)
        )
    )
