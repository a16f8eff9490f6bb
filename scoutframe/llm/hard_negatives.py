"""Hard negatives by inner product, found with coordinate pruning in length buckets.

Vectors lie in blocks of similar length.  In a task a block is cut into buckets; a bucket has, for each
coordinate, its unit vectors' values in ascending order.  A score threshold becomes a least cosine for the
bucket, which allows every coordinate of a unit vector only a range of values around the anchor's; the rows in
the ranges of the anchor's few largest coordinates are intersected, and what is left is scored exactly.
Buckets go by falling length, so thresholds rise early, and a bucket too short for the threshold is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.llm.common import pick
from scoutframe.llm.pivot_search import quantised
from scoutframe.session import cut_lineage

EXACT = 2.0**52
SLACK = 1e-9
BUCKET = 512
FOCUS = 4
NO_SCORE = -(2**63)
HELD = 10_000  # anchors whose best a task holds


class Bucket:
    """Rows [a, b) of a block in falling order of length, with their sorted coordinate lists."""

    def __init__(self, unit: np.ndarray, lengths: np.ndarray, a: int, b: int):
        self.a, self.b, self.longest = a, b, float(lengths[a]) if b > a else 0.0
        self.order = np.argsort(unit[a:b], axis=0, kind="stable")
        self.lists = np.take_along_axis(unit[a:b], self.order, axis=0).T.copy()

    def candidates(self, unit_anchor: np.ndarray, focus: np.ndarray, least_cosine: float) -> np.ndarray | None:
        """Rows whose focus coordinates all lie in their ranges (None: every row)."""
        if least_cosine <= 0:  # a range then excludes next to nothing, and short vectors need more care
            return None
        t = min(least_cosine, 1.0)
        found = None
        for f in focus:
            x = float(unit_anchor[f])
            spread = np.sqrt(max(0.0, (1 - t * t) * (1 - x * x)))
            low = -1.0 if x <= -t else x * t - spread
            high = 1.0 if x >= t else x * t + spread
            i, j = np.searchsorted(self.lists[f], (low - SLACK, high + SLACK))
            here = np.zeros(self.b - self.a, bool)
            here[self.order[i:j, f]] = True
            found = here if found is None else found & here
        return self.a + np.flatnonzero(found)


class Block:
    """Vectors in falling order of length, cut into buckets."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        lengths = np.sqrt((x * x).sum(1))
        order = np.argsort(-lengths, kind="stable")
        self.rows, self.ids, self.labels, self.vectors = rows[order], ids[order], labels[order], vectors[order]
        self.x, lengths = x[order], lengths[order]
        unit = self.x / np.where(lengths > 0, lengths, 1)[:, None]
        self.largest = float(np.abs(x).max(initial=0))
        self.buckets = [Bucket(unit, lengths, a, min(a + BUCKET, len(x))) for a in range(0, len(x), BUCKET)]

    def scores(self, anchor: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        if self.largest * float(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self.x[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return (self.vectors[rows].astype(object) @ anchor.astype(object)).astype(np.int64)

    def search(self, anchor: np.ndarray, threshold, offer) -> None:
        """Offer (rows, scores) of all that may score at ``threshold()``, which may rise meanwhile."""
        a = anchor.astype(np.float64)
        length = float(np.sqrt((a * a).sum()))
        unit = a / length if length else a
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for bucket in self.buckets:
            least = threshold()
            most = length * bucket.longest
            if least > most * (1 + SLACK) + SLACK:
                return  # this bucket and all after it are too short
            rows = bucket.candidates(unit, focus, (least - SLACK) / most - SLACK) if most > 0 and least > 0 else None
            rows = slice(bucket.a, bucket.b) if rows is None else rows
            offer(np.arange(bucket.a, bucket.b) if isinstance(rows, slice) else rows, self.scores(anchor, rows))


class Best:
    """The first ``k`` (score descending, id ascending) of what was offered."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else NO_SCORE

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        keep = scores >= self.least()
        ids, scores = np.concatenate((self.ids, ids[keep])), np.concatenate((self.scores, scores[keep]))
        top = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[top], scores[top]


def best_positives(block: Block, row: int, anchor: np.ndarray, best: Best) -> None:
    def offer(rows, scores):
        other = block.rows[rows] != row
        best.offer(block.ids[rows[other]], scores[other])

    block.search(anchor, best.least, offer)


def best_negatives(block: Block, label: int, anchor: np.ndarray, bounds: list[tuple[int, int]], best: list[Best]) -> None:
    """For each (least, most) score the first rows of another label inside it."""

    def offer(rows, scores):
        rows, scores = rows[block.labels[rows] != label], scores[block.labels[rows] != label]
        for (low, high), b in zip(bounds, best, strict=True):
            inside = (scores >= low) & (scores <= high)
            b.offer(block.ids[rows[inside]], scores[inside])

    def threshold():
        return min(max(low, b.least()) for (low, _), b in zip(bounds, best, strict=True))

    block.search(anchor, threshold, offer)


def _smallest(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    high = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if high < 2**15 else np.int32 if high < 2**31 else np.int64)


PACKED = "dim int, longest double, rows binary, ids binary, labels binary, item int, vectors binary"


def _blocks(df: DataFrame, keys: list[str], rows_per_block: int) -> DataFrame:
    """Rows in blocks of one key and similar length, longest first; none has more than ``rows_per_block``."""
    order = [*keys, F.desc("length"), "vec_id", "row"]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        v = _smallest(table["v"].combine_chunks().flatten().to_numpy().astype(np.int64))
        first = {k: table[k][0].as_py() for k in [*keys, "dim"]}
        return pa.RecordBatch.from_pylist([{
            **first, "longest": table["length"][0].as_py(), "rows": table["row"].to_numpy().tobytes(),
            "ids": table["vec_id"].to_numpy().tobytes(), "labels": table["label"].to_numpy().tobytes(),
            "item": v.itemsize, "vectors": v.tobytes(),
        }], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, key = [], 0, None
        for batch in batches:
            here, at = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)), 0
            while at < len(here):
                if held and (here[at] != key or n >= rows_per_block):
                    yield packed(held)
                    held, n = [], 0
                key, end = here[at], at + 1
                while end < len(here) and here[end] == key and n + end - at < rows_per_block:
                    end += 1
                held.append(batch.slice(at, end - at))
                n, at = n + end - at, end
        if held:
            yield packed(held)

    extra = [k for k in keys if k != "dim"]
    out = pa.schema(
        [(k, pa.int64()) for k in extra]
        + [("dim", pa.int32()), ("longest", pa.float64())]
        + [(k, pa.binary()) for k in ("rows", "ids", "labels")] + [("item", pa.int32()), ("vectors", pa.binary())]
    )
    columns = list(dict.fromkeys([*keys, "dim", "length", "row", "vec_id", "label", "v"]))
    return dealt.select(*columns).mapInArrow(run, "".join(f"{k} long, " for k in extra) + PACKED)


def _unpack(r: dict) -> Block:
    ids = np.frombuffer(r["ids"], np.int64)
    vectors = np.frombuffer(r["vectors"], f"i{r['item']}").astype(np.int64).reshape(len(ids), r["dim"])
    return Block(np.frombuffer(r["rows"], np.int64), ids, np.frombuffer(r["labels"], np.int64), vectors)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            yield r, _unpack(r)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", factor: int = 256,
    block_rows: int = 8192, anchor_rows: int = 512,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components x become floor(``factor`` * x), a score is the integer inner product with the anchor; higher
    scores come first, ties by smaller id.  An anchor (``is_anchor``, a condition on ``vec_id`` and ``label``)
    has its first ``positives`` other rows of the same label, and each of these the first ``negatives`` rows of
    another label with low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a NULL id, label or vector, or a component that is NULL or not finite, take no part; vectors only
    meet those of their own dimension.  Rows that repeat an id are rows of their own: each is an anchor, a
    positive (also of its twin) and a negative.  Fewer rows than asked for are all given; an anchor without a
    positive and a positive without a negative give none.  Other columns are ignored.  Scores must fit in 64 bits.

    Blocks of at most ``block_rows`` vectors meet groups of at most ``anchor_rows`` anchors, the anchors being
    a stated query set; positives are sought in the anchor's label only, negatives only in blocks long enough
    for the least score any of the group's anchors asks for.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=vec_id, embedding=embedding, label=label)
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        quantised(F.col("embedding"), factor).alias("v"),
    ).where("vec_id is not null and label is not null and v is not null")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = cut_lineage(
        rows.select("*", F.size("v").alias("dim"), length.alias("length"), F.monotonically_increasing_id().alias("row"))
    )
    anchors = rows.where(is_anchor)
    n_parts = max(1, -(-anchors.count() // anchor_rows))
    n_salts = max(1, -(-rows.count() // (2 * block_rows)))
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def met(blocks: DataFrame, asking: DataFrame, keys: list[str]) -> DataFrame:
        """Every block beside every group of anchors of its key, a couple of blocks to a cell."""
        one = F.struct("row", "vec_id", "label", "v", "chosen")
        part = F.pmod(F.xxhash64("row"), F.lit(n_parts)).cast("int").alias("part")
        groups = asking.groupBy(*keys, part).agg(
            F.collect_list(one).alias("asked"), F.max("length").alias("reach"), F.min("floor").alias("floor")
        )
        groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
        blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("rows"), F.lit(n_salts)).cast("int"))
        blocks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
        cell = [*keys, "part", "salt"]
        # an explicit count: adaptive coalescing goes by bytes, and these few bytes are much work
        return blocks.repartition(tasks, *cell).join(groups.repartition(tasks, *cell), cell)

    # positives: the anchor's label only
    near = "row long, positive_id long, positive_score long"
    names = ["row", "positive_id", "positive_score"]

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an anchor's best go from block to block of a task, so thresholds start high and rows come out once
        def flushed():
            out = [(np.full(len(b.ids), row), b.ids, b.scores) for row, b in best.items()]
            columns = zip(*out, strict=True) if out else [[np.zeros(0, np.int64)]] * 3
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in columns], names)

        best: dict[int, Best] = {}
        for r, block in _blocks_of(batches):
            for a in r["asked"]:
                best_positives(block, a["row"], np.array(a["v"], np.int64), best.setdefault(a["row"], Best(positives)))
            if len(best) >= HELD:
                yield flushed()
                best = {}
        yield flushed()

    label_key = ["dim", "label"]
    unbound = anchors.withColumn("chosen", F.lit(None).cast("string")).withColumn("floor", F.lit(None).cast("double"))
    pairs = met(_blocks(rows, label_key, block_rows), unbound, label_key)
    found = pairs.mapInArrow(positive, near)
    first = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    chosen = cut_lineage(found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives))

    # negatives: scores between the least and the most that a positive allows
    least = F.col("positive_score").cast("double") * (low / 100)
    wanted = chosen.where("positive_score >= 0").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("chosen"),
        F.min(least).alias("floor"),
    )
    asking = anchors.join(wanted, "row")
    schema = "row long, anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long"
    out_names = [x.split()[0] for x in schema.split(", ")]

    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed():
            out = []
            for row, (anchor, chosen, found) in best.items():
                for c, b in zip(chosen, found, strict=True):
                    given = [row, anchor, c["nth"], c["positive_id"], c["positive_score"]]
                    out += [(*given, x, s) for x, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
            columns = zip(*out, strict=True) if out else [()] * len(out_names)
            kinds = [pa.int32() if n == "nth" else pa.int64() for n in out_names]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], out_names)

        best: dict[int, tuple] = {}
        for r, block in _blocks_of(batches):
            for a in r["asked"]:
                scores = [c["positive_score"] for c in a["chosen"]]
                bounds = [(-(-low * s // 100), high * s // 100) for s in scores]
                _, _, found = best.setdefault(a["row"], (a["vec_id"], a["chosen"], [Best(negatives) for _ in bounds]))
                best_negatives(block, a["label"], np.array(a["v"], np.int64), bounds, found)
            if len(best) >= HELD:
                yield flushed()
                best = {}
        yield flushed()

    long_enough = F.col("longest") * F.col("reach") * (1 + SLACK) + 1 >= F.col("floor")
    pairs = met(_blocks(rows, ["dim"], block_rows), asking, ["dim"]).where(long_enough)
    top = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id")
    return (
        pairs.mapInArrow(negative, schema).withColumn("rank", F.row_number().over(top))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
