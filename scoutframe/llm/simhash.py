"""SimHash near-duplicates: exact comparison of fingerprint tiles by exclusive-or and bit counts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm.common import pick, release_memory, slabs, text_bytes
from scoutframe.llm.components import components, star_labels
from scoutframe.session import cut_lineage

BLOCKS, BLOCK_BITS, SHIFT = 4, 16, 5
TILE = 1024


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, fp, *carry) with the 64-bit fingerprint of every whole text.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a bit is set if it is set in
    over half of the XXH64 values (seed 42) of the shingles.  Fewer words than a shingle are one shingle; text
    that is NULL or has no word has fingerprint 0.  Columns named in ``carry`` come along, others are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts, out = text_bytes(batch.column("text")), []
            for i, j in slabs(texts, 1 << 20):
                values, counts = [], []
                for t in texts[i:j]:
                    words = t.lower().split()
                    line = b" ".join(words)
                    ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else []
                    m = max(len(words) - shingle + 1, min(len(words), 1))
                    first = [0, *(ends[: m - 1] + 1).tolist()] if m else []
                    last = ends[-m:].tolist() if m else []
                    values += [xxh64_intdigest(line[a:b], 42) for a, b in zip(first, last, strict=True)]
                    counts.append(m)
                h, n = np.array(values, np.uint64), np.array(counts, np.int64)
                sums = np.zeros((len(n), 64), np.int64)
                at = np.concatenate(([0], np.cumsum(n)))
                for a in range(0, len(h), 1 << 16):
                    b = min(a + (1 << 16), len(h))
                    bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    d0, d1 = (int(np.searchsorted(at, x, "right")) - 1 for x in (a, b - 1))
                    which = np.arange(d0, d1 + 1)
                    which = which[n[which] > 0]
                    edges = np.maximum(at[which] - a, 0)
                    sums[which] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
                set_ = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little")
                out.append(np.ascontiguousarray(set_).view(np.int64).ravel())
            fp = np.concatenate(out) if out else np.zeros(0, np.int64)
            more = [batch.column(k) for k in carried]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), *more], ["doc_id", "fp", *carried])
        release_memory()

    carried = {f"carry{i}": name for i, name in enumerate(carry)}
    rows = pick(docs, doc_id=doc_id, text=text, **carried).withColumn("doc_id", F.col("doc_id").cast("long"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {k} {types[k]}" for k in carried))


def _steps(radius: int) -> list[int]:
    """Differences of tile keys, one of each pair of opposites, whose counts differ by ``radius`` at most."""
    out = []
    for d in itertools.product(range(-radius, radius + 1), repeat=BLOCKS):
        if 0 < sum(map(abs, d)) <= radius and d > tuple(-x for x in d):
            out.append(sum(x << (SHIFT * i) for i, x in enumerate(d)))
    return out


def _compare(home: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join every two fingerprints linked between ``home`` and ``home`` + ``other``."""
    both = np.concatenate((home, other))
    count = np.bitwise_count(both)
    order_h = np.argsort(count[: len(home)], kind="stable")
    order = np.argsort(count, kind="stable")
    labels = np.arange(len(both))
    for i in range(0, len(order_h), TILE):
        rows = order_h[i : i + TILE]
        low, high = int(count[rows[0]]), int(count[rows[-1]])
        for j in range(0, len(order), 4 * TILE):
            cols = order[j : j + 4 * TILE]
            if int(count[cols[0]]) - high > radius or low - int(count[cols[-1]]) > radius:
                continue
            near = np.bitwise_count(both[rows][:, None] ^ both[cols][None]) <= radius
            a, b = np.nonzero(near)
            labels = star_labels(labels, rows[a], cols[b])
    tied = np.flatnonzero(labels != np.arange(len(both)))
    return both[tied], both[labels[tied]]


def links(distinct: DataFrame, radius: int, home_rows: int = 4096, other_rows: int = 65536) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, each once) within ``radius`` bits, as stars.

    A tile holds the fingerprints whose four 16-bit blocks have the same numbers of set bits.  Two
    fingerprints within the radius lie in tiles whose counts differ by no more than that in sum, so only such
    tile pairs meet.  There are at most 17**4 tiles; a large one is cut into parts, and every part of it meets
    every part of its neighbours.
    """
    key = sum(
        (
            F.shiftleft(F.bit_count(F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit(0xFFFF))) + radius, SHIFT * i)
            for i in range(BLOCKS)
        ),
        F.lit(0),
    )
    tiles = distinct.select("fp", key.cast("int").alias("tile"))
    steps = _steps(radius)
    size = {r["tile"]: r["count"] for r in tiles.groupBy("tile").count().collect()}  # 17**4 rows at most
    parts = []
    for t, n in size.items():
        h = -(-n // home_rows)
        others = sum(size.get(t - s, 0) for s in steps) + (n if h > 1 else 0)
        o = max(1, -(-others // other_rows))
        if h > 1 or o > 1:
            parts.append((t, h, o))
    cut = distinct.sparkSession.createDataFrame(parts, "tile int, h int, o int")
    whole = F.coalesce("h", F.lit(1)), F.coalesce("o", F.lit(1))

    def part(n):
        return F.pmod(F.xxhash64("fp"), n).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    homes = (
        tiles.join(F.broadcast(cut), "tile", "left").select("tile", part(whole[0]).alias("i"), whole[1].alias("n"), "fp")
        .select("tile", "i", every(F.col("n")).alias("j"), F.lit(True).alias("home"), "fp")
    )
    moves = F.array(*[F.lit(s) for s in [0, *steps]])
    others = (
        tiles.select("fp", F.col("tile").alias("own"), F.explode(F.transform(moves, lambda s: F.col("tile") + s)).alias("tile"))
        .join(F.broadcast(cut), "tile", "left")
        .where("tile <> own or coalesce(h, 1) > 1")
        .select("tile", whole[0].alias("n"), part(whole[1]).alias("j"), "fp")
        .select("tile", every(F.col("n")).alias("i"), "j", F.lit(False).alias("home"), "fp")
    )

    def run(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy().view(np.uint64)
        home = group["home"].to_numpy()
        a, b = _compare(fp[home], fp[~home], radius) if home.any() else (fp[:0], fp[:0])
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    met = homes.unionByName(others).groupBy("tile", "i", "j")
    return met.applyInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, fingerprint, component_id, component, *carry): texts linked at ``radius`` bits or fewer, directly or by others.

    ``fingerprint`` has 16 lower-case hex digits; ``component_id`` is the smallest id that can be reached.
    Equal fingerprints are one node, so copies cost nothing; repeated rows give a row each.  A NULL id is no
    component's name unless all its ids are NULL; ``component``, a fingerprint, tells components apart in any case.
    Columns named in ``carry`` come along unchanged.  See ``fingerprints`` for NULL and empty texts.
    """
    prints = cut_lineage(fingerprints(docs, doc_id, text, shingle, carry))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut_lineage(named.join(names, "root").select("fp", "component_id", F.col("root").alias("component")))
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component",
        *[F.col(f"carry{i}").alias(name) for i, name in enumerate(carry)],
    )
