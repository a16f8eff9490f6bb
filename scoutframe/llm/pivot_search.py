"""Exact inner-product top-k by pivot-table elimination.

A table holds every vector's distance to a set of pivots.  For a query the largest difference of pivot
distances bounds the distance to a candidate from below, hence the score from above; candidates are scored in
order of the bound until no bound can reach the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.llm.common import pick

EXACT = 2.0**52


def quantised(column: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component; NULL if the vector is NULL or a component is no finite number."""
    values = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(values, lambda x: F.floor(x * factor)))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each next pivot is the vector farthest from those chosen."""
    at = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(at) < min(count, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[at[-1]]) ** 2).sum(1))
    return sample[at]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def search_block(queries, query_ids, vectors, ids, pivots, k: int, step: int = 256):
    """(query, rank-free candidate id, score) rows: the block's k best for every query, ties to smaller ids."""
    x, q = vectors.astype(np.float64), queries.astype(np.float64)
    table, mine = _distances(x, pivots), _distances(q, pivots)
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < EXACT
    out = []
    for i in range(len(q)):
        low = np.zeros(len(x))
        for p in range(len(pivots)):
            np.maximum(low, np.abs(table[:, p] - mine[i, p]), out=low)
        bound = (xx + qq[i] - low * low) / 2
        bound += 1e-9 * (xx + qq[i]) + 1e-6  # covers rounding of the distances
        order = np.argsort(-bound, kind="stable")
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(order), step):
            if len(best_s) >= k and bound[order[a]] < best_s[k - 1]:
                break
            part = order[a : a + step]
            part = part[ids[part] != query_ids[i]]
            score = x[part] @ q[i] if exact else vectors[part].astype(object) @ queries[i].astype(object)
            s = np.concatenate((best_s, np.array(score).astype(np.int64)))
            j = np.concatenate((best_i, ids[part]))
            top = np.lexsort((j, -s))[:k]
            best_s, best_i = s[top], j[top]
        out.append((np.full(len(best_i), query_ids[i]), best_i, best_s))
    return out


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    pivots: int = 24,
    sample: int = 2000,
    block_rows: int = 8192,
    query_rows: int = 1024,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query's ``k`` largest integer inner products, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``.  Pivots come from the ``sample`` vectors whose ids hash smallest;
    they affect speed only.  Vectors go in blocks of about ``block_rows``, queries in blocks of about
    ``query_rows``, and each block of queries meets each block of vectors, so the work is queries times
    vectors as stated; no block grows with the input.  Vectors that are NULL or hold NULL or a non-finite number
    take no part, nor do NULL ids; vectors only meet those of their own dimension.  A candidate is any row with
    another id than the query; rows that repeat an id count once each.  Scores must fit in 64 bits.
    """
    spark = vectors.sparkSession
    rows = (
        pick(vectors, vec_id=vec_id, embedding=embedding)
        .select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v"))
        .where("vec_id is not null and v is not null").withColumn("dim", F.size("v"))
    )
    query_sql = is_query
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(query_sql).alias("q")).collect()
    n, q = sum(r["n"] for r in counts), sum(r["q"] for r in counts)
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-q // query_rows))
    tables: dict[int, np.ndarray] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("dim", "v").collect():
        tables.setdefault(r["dim"], []).append(r["v"])
    tables = {d: choose_pivots(np.array(v, np.float64).reshape(len(v), d), pivots) for d, v in tables.items()}

    def packed(kind):
        def run(group: pa.Table) -> pa.Table:
            flat = group["v"].combine_chunks().flatten().to_numpy().astype(np.int64)
            return pa.table({
                "dim": group["dim"].slice(0, 1), kind: group[kind].slice(0, 1),
                kind + "_ids": pa.array([group["vec_id"].to_numpy().tobytes()], pa.binary()),
                kind + "_values": pa.array([flat.tobytes()], pa.binary()),
            })

        return run

    def blocked(df, kind, count):
        part = F.pmod(F.xxhash64("vec_id", F.lit(kind)), F.lit(count))
        schema = f"dim int, {kind} long, {kind}_ids binary, {kind}_values binary"
        return df.withColumn(kind, part).groupBy("dim", kind).applyInArrow(packed(kind), schema)

    data = blocked(rows, "block", blocks).withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    data = data.withColumn("query", F.col("query").cast("long"))
    asked = blocked(rows.where(query_sql), "query", query_blocks)
    schema = "query_id long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, qi, qv, bi, bv = (batch.column(c)[r].as_py() for c in names)
                qi, bi = np.frombuffer(qi, np.int64), np.frombuffer(bi, np.int64)
                qv = np.frombuffer(qv, np.int64).reshape(len(qi), dim)
                bv = np.frombuffer(bv, np.int64).reshape(len(bi), dim)
                table = tables.get(dim, np.zeros((0, dim)))
                found = search_block(qv, qi, bv, bi, table, k)
                cols = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    names = ["dim", "query_ids", "query_values", "block_ids", "block_values"]
    met = data.join(asked, ["dim", "query"]).select(*names).repartition("block_ids", "query_ids")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
