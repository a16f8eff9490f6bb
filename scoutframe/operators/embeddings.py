"""Exact nearest vectors of a group by cosine, in many dimensions.

A tree of boxes excludes nothing in 64 dimensions, so blocks with a ball around
each are used instead:

1. Equal directions collapse into one entry that keeps its k + 1 first keys.
2. Every direction goes to the nearest of a bounded number of sampled centres;
   what lies together is packed into blocks of bounded size with centre and radius.
3. Every direction searches its own block, which gives it a radius of its own.
4. A block is compared with another only where their balls allow a direction to
   come nearer than what it has (triangle inequality): the stop is exact. The
   comparison is one matrix product.
5. The finds are merged to the k nearest.

Rows are ranked by similarity rounded to nine places, then by key. Where vectors
have no structure every two blocks of a group meet, as exactness then demands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NEIGHBOURS
from ..session import c, cut_lineage, ships_with_tasks, small_side
from .neighbours import nearest

ships_with_tasks(__name__)

BLOCK_ROWS = 8192
MOST_CENTRES = 1024
SAMPLE_ROWS = 20_000
SEARCH_ROWS = 128  # rows compared with a block at once
_SLACK = 1e-6  # covers the rounding of similarities in the radius


def _vectors(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), dtype=float).reshape(len(values), -1)


def pack_block(label, keys: np.ndarray, x: np.ndarray, block: int, want: int) -> dict:
    """A block in order of its keys, with its ball and each row's similarity to its worst find at home."""
    order = np.argsort(keys, kind="stable")
    keys, x = keys[order], x[order]
    centre = x.mean(axis=0)
    worst = np.full(len(x), -1.0)
    if len(x) >= want:
        for at in range(0, len(x), SEARCH_ROWS):
            r, _, s = nearest(x[at : at + SEARCH_ROWS], x, want)
            here = worst[at : at + SEARCH_ROWS]
            here[:] = s[np.searchsorted(r, np.arange(len(here)), "right") - 1]
    return {
        "label": label, "block": block, "centre": centre.tolist(),
        "radius": float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())),
        "reach": float(np.sqrt(max(0.0, 2 - 2 * worst.min()))),
        "keys": keys.astype(np.int64).tobytes(), "vectors": x.tobytes(), "worst": worst.tobytes(),
    }


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(row["keys"], np.int64)
    return keys, np.frombuffer(row["vectors"], float).reshape(len(keys), -1), np.frombuffer(row["worst"], float)


def nearest_vectors(
    df: DataFrame, key: str, vector: str, group: str, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS,
    most_centres: int = MOST_CENTRES,
) -> DataFrame:
    """(group, key, rank, neighbour, similarity): the k most similar rows of the group.

    ``key`` is a unique bigint. Rows with a NULL group or vector, or a component
    that is NULL or no finite number, take no part; vectors of a group must have
    one length. A zero vector has similarity 0 to everything.
    """
    want = k + 1  # a row may find itself
    values = F.transform(c(vector), lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = (
        df.where(c(group).isNotNull() & c(vector).isNotNull())
        .select(c(group).cast("string").alias("label"), c(key).cast("long").alias("key"), F.when(~bad, values).alias("v"))
        .where("v is not null")
        .withColumn("norm", norm)
    )
    unit = F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm") + 0.0)).otherwise(
        F.transform("v", lambda x: F.lit(0.0))
    )
    rows = cut_lineage(rows.select("label", "key", (F.col("norm") == 0).alias("zero"), unit.alias("v")))

    # 1. distinct directions with their first keys
    copies = Window.partitionBy("label", "v").orderBy("key")
    dirs = cut_lineage(
        rows.withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= want)
        .groupBy("label", "zero", "v").agg(F.array_sort(F.collect_list("key")).alias("members"))
        .withColumn("dir", F.col("members")[0])
    )
    points = dirs.where("not zero")

    # 2. centres from a bounded sample, blocks of what lies together
    n = points.count()
    wanted = min(most_centres, -(-n // block_rows))
    centres: dict[str, np.ndarray] = {}
    if wanted > 1:
        sample = points.orderBy(F.xxhash64("dir"), "dir").limit(min(SAMPLE_ROWS, 16 * wanted)).select("label", "v").toPandas()
        for label, part in sample.groupby("label"):
            centres[label] = _vectors(part["v"])[: max(1, round(wanted * len(part) / len(sample)))]
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        for pdf in batches:
            pdf["cell"] = 0
            for label, part in pdf.groupby("label"):
                if label in shared.value:
                    pdf.loc[part.index, "cell"] = np.argmax(_vectors(part["v"]) @ shared.value[label].T, axis=1)
            yield pdf

    order = ["label", "cell", "dir"]
    placed = points.select("label", "dir", "v").mapInPandas(place, "label string, dir long, v array<double>, cell long")
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed():
            part = pd.concat(held)
            return pack_block(part["label"].iloc[0], part["dir"].to_numpy(), _vectors(part["v"]), block, want)

        for pdf in batches:
            for _, part in pdf.groupby(["label", "cell"], sort=False):
                at = 0
                while at < len(part):
                    here = (part["label"].iloc[at], part["cell"].iloc[at])
                    if held and (size >= block_rows or here != (held[0]["label"].iloc[0], held[0]["cell"].iloc[0])):
                        yield pd.DataFrame([packed()])
                        block, held, size = block + 1, [], 0
                    held.append(part.iloc[at : at + block_rows - size])
                    size += len(held[-1])
                    at += len(held[-1])
        if held:
            yield pd.DataFrame([packed()])

    blocks = cut_lineage(
        placed.mapInPandas(
            pack,
            "label string, block long, centre array<double>, radius double, reach double, keys binary, vectors binary, worst binary",
        )
    )

    # 3. and 4. a block meets itself and the blocks its rows may find something in
    mine = blocks.select("label", "block", "centre", "radius", "reach")
    other = blocks.select("label", F.col("block").alias("block2"), F.col("centre").alias("centre2"), F.col("radius").alias("radius2"))
    apart = F.sqrt(F.aggregate(
        F.zip_with("centre", "centre2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    ))
    near = apart - F.col("radius") - F.col("radius2") <= F.col("reach") + _SLACK
    pairs = mine.join(other, "label").where((F.col("block") == F.col("block2")) | near).select("block", "block2")
    theirs = blocks.select(F.col("block").alias("block2"), F.col("keys").alias("keys2"), F.col("vectors").alias("vectors2"))
    met = pairs.join(theirs, "block2").join(blocks.select("label", "block", "keys", "vectors", "worst"), "block")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                # views of the batch: a copy of its vectors would be as large as all blocks in it
                row = {x: batch.column(x)[i].as_buffer() for x in ("keys", "vectors", "worst", "keys2", "vectors2")}
                keys, x, worst = _unpacked(row)
                keys2 = np.frombuffer(row["keys2"], np.int64)
                y = np.frombuffer(row["vectors2"], float).reshape(len(keys2), -1)
                for at in range(0, len(x), SEARCH_ROWS):
                    r, col, s = nearest(x[at : at + SEARCH_ROWS], y, want)
                    keep = s >= worst[at + r]
                    found = [keys[at + r[keep]], keys2[col[keep]], s[keep]]
                    label = pa.array([batch.column("label")[i].as_py()] * len(found[0]), pa.string())
                    yield pa.RecordBatch.from_arrays([label, *map(pa.array, found)], ["label", "dir", "near", "sim"])

    finds = met.mapInArrow(search, "label string, dir long, near long, sim double")

    # 5. the best directions, then the best keys
    best = Window.partitionBy("label", "dir").orderBy(F.desc("sim"), "near")
    top = finds.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= want)
    members = dirs.select("label", F.col("dir").alias("near"), "members")
    hits = top.join(members, ["label", "near"]).select("label", "dir", F.explode("members").alias("neighbour"), "sim")
    zero = small_side(dirs.where("zero").select("label", F.col("members").alias("zeros")))
    hits = hits.unionByName(
        points.select("label", "dir").join(zero, "label")
        .select("label", "dir", F.explode("zeros").alias("neighbour"), F.lit(0.0).alias("sim"))
    )
    first = Window.partitionBy("label").orderBy("key")
    opening = (
        rows.select("label", "key").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= want)
        .select("label", F.col("key").alias("neighbour"))
    )
    hits = hits.unionByName(
        dirs.where("zero").select("label", "dir").join(opening, "label").withColumn("sim", F.lit(0.0))
    )
    ranked = Window.partitionBy("label", "dir").orderBy(F.desc("sim"), "neighbour")
    lists = (
        hits.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= want)
        .groupBy("label", "dir").agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour", "sim"))).alias("l"))
    )
    # back to the rows: all copies of a direction share its list
    given = dirs.join(lists, ["label", "dir"]).select("label", "v", "l")
    own = F.slice(F.filter("l", lambda e: e["neighbour"] != F.col("key")), 1, k)
    kind = dict(df.dtypes)[group]
    return (
        rows.join(given, ["label", "v"]).select("label", "key", F.posexplode(own).alias("at", "e"))
        .select(
            F.col("label").cast(kind).alias(group), F.col("key").alias(key), (F.col("at") + 1).alias("rank"),
            F.col("e.neighbour").alias("neighbour"), F.col("e.sim").alias("similarity"),
        )
    )
