"""Hard negatives against scoring every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.llm.hard_negatives import Best, Block, best_positives, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, part int, chosen string, length double, v int"


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    data = []
    for i, (vec_id, x, label) in enumerate(rows):
        ok = vec_id is not None and x is not None and label is not None
        if ok and all(v is not None and math.isfinite(v) for v in x):
            data.append((i, vec_id, [math.floor(256 * float(np.float32(v))) for v in x], label))
    out = []
    for a in data:
        if not is_anchor(a[1]):
            continue
        scored = [(-sum(p * q for p, q in zip(a[2], c[2])), c[1], c[3]) for c in data if c[0] != a[0] and len(c[2]) == len(a[2])]
        same = sorted(s[:2] for s in scored if s[2] == a[3])[:positives]
        other = sorted(s[:2] for s in scored if s[2] != a[3])
        for p, positive in same:
            inside = [(s, n) for s, n in other if low * -p <= 100 * -s <= high * -p]
            out += [(a[1], positive, r, n, -p, -s) for r, (s, n) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", 0.5, 3) for r in rows], SCHEMA).repartition(3)


def made_up(n, dim, seed, lengths=(1.0,)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        x = centres[rng.integers(4)] + rng.normal(size=dim) * 0.4
        x = x / np.linalg.norm(x) * rng.choice(lengths)
        rows.append((i, [float(v) for v in x], int(rng.integers(3))))
    return rows


ODD = [
    (7, None, 1), (11, [0.1, 0.2], None), (None, [0.3] * 6, 1), (20, [float("nan")] + [0.1] * 5, 1),
    (30, [None, 0.1, 0.1, 0.1, 0.1, 0.1], 1), (40, [float("inf")] * 6, 1), (50, [0.0] * 6, 1), (60, [0.0] * 6, 2),
    (70, [0.5, 0.5], 1), (71, [0.5, 0.5], 1), (72, [0.4, 0.4], 2), (80, [], 1), (90, [-0.5] * 6, 1), (100, [0.2] * 6, 99),
]


@pytest.mark.parametrize("block_rows, anchor_rows", [(8192, 512), (16, 4)])
def test_hard_negatives_equal_brute_force(spark, block_rows, anchor_rows):
    """NULLs, no numbers, ties, zero vectors, two dimensions, and rows that repeat an id."""
    rows = made_up(220, 6, 1, (0.5, 1.0, 3.0)) + ODD
    rows += rows[10:14] + [(10, [0.1] * 6, 0), (15, rows[20][1], 2)] * 2
    random.Random(1).shuffle(rows)
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, block_rows=block_rows, anchor_rows=anchor_rows)
    want = brute(rows, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_a_vector_that_a_third_of_all_rows_hold(spark):
    rows = made_up(200, 5, 2) + [(1000 + i, [0.4] * 5, 1) for i in range(100)]
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 25 == 0, block_rows=32, anchor_rows=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 25 == 0)


def test_empty_table_and_large_numbers(spark):
    assert hard_negatives(frame(spark, ODD).where("false"), F.col("vec_id") % 10 == 0).count() == 0
    rows = [(i, [float(np.float32(3e5 * (i % 13 + 1))), 1e5 * i], i % 3) for i in range(60)]
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_ranges_leave_most_rows_of_a_clear_neighbourhood_out():
    """The pruning is real where vectors differ: few rows are scored, and the result stays exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 16))
    x = np.floor(256 * (centres[rng.integers(64, size=4096)] + 0.05 * rng.normal(size=(4096, 16)))).astype(np.int64)
    block = Block(np.arange(4096), np.arange(4096), np.zeros(4096, np.int64), x)
    seen = []
    scores = block.scores
    block.scores = lambda anchor, rows: (seen.append(len(range(4096)[rows]) if isinstance(rows, slice) else len(rows)), scores(anchor, rows))[1]
    for a in range(20):
        best = Best(5)
        best_positives(block, a, x[a], best)
        s = x @ x[a]
        want = sorted((-int(s[i]), i) for i in range(4096) if i != a)[:5]
        assert [(-v, i) for i, v in zip(best.ids.tolist(), best.scores.tolist())] == want
    assert sum(seen) < 20 * 4096 / 2
