"""A stored trigram index of names for "contains" search.

The index has a row per trigram and name, sorted by trigram, so the file format's
statistics leave out all row groups but those with a wanted one. A search joins
the few lists of its trigrams, keeps names that are in all of them, and verifies
these only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_name
from ..session import c

GRAM = 3


def grams(text: Column) -> Column:
    """Distinct trigrams; none in a shorter text."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))


def build_name_index(df: DataFrame, path: str, keys=("League", "Player"), name: str = "Player") -> None:
    """Write ``names`` (keys, normalised name) and ``grams`` (trigram, id) below ``path``."""
    names = df.select(*[c(k) for k in keys], normalize_name(c(name)).alias("norm")).distinct()
    names.withColumn("id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/names")
    stored = df.sparkSession.read.parquet(f"{path}/names")
    rows = stored.select("id", F.explode(grams(F.col("norm"))).alias("gram"))
    ordered = rows.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")
    ordered.write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/grams")


def search_names(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(keys) of names that contain ``pattern``, of which ``%`` stands for any letters; blank finds all.

    Case and accents do not count. Pieces of under three letters have no trigram;
    where no piece has one, the names are scanned.
    """
    names = spark.read.parquet(f"{path}/names")
    wanted = spark.range(1).select(F.transform(F.split(F.lit(pattern), "%"), lambda p: normalize_name(p)).alias("p")).first()[0]
    pieces = [p for p in wanted if p]
    parts = sorted({p[i : i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})
    out = names
    if parts:
        lists = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(*parts))
        found = lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(parts)).select("id")
        out = names.join(found, "id", "left_semi")
    if pieces:
        literal = "%".join(p.replace("\\", "\\\\").replace("_", "\\_") for p in pieces)
        out = out.where(F.col("norm").like(f"%{literal}%"))
    return out.drop("id", "norm")
