"""Forms for large inputs against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutframe.operators import ranking
from scoutframe.operators.embeddings import nearest_vectors


def brute_neighbours(rows, k=5):
    data = [(i, np.array(v, float), g) for i, v, g in rows if g is not None and v is not None and np.isfinite(np.array(v, float)).all()]
    out = []
    for i, v, g in data:
        scored = []
        for j, w, h in data:
            if i != j and g == h:
                length = np.linalg.norm(v) * np.linalg.norm(w)
                scored.append((-round(float(v @ w) / length, 9) if length else 0.0, j))
        out += [(i, g, r, j, round(-s, 6) + 0.0) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[rng.integers(6)] + rng.normal(size=12) * 0.2).tolist(), int(rng.integers(2))) for i in range(260)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(90)]  # one vector on a third of a group's rows
    rows += [(2000 + i, [3.0 * x for x in rows[8][1]], 1) for i in range(3)]  # one direction, other lengths
    rows += [(3000, [0.0] * 12, 0), (3001, [0.0] * 12, 0), (3002, [0.0] * 12, 1), (3003, None, 0), (3004, rows[0][1], None)]
    rows += [(3005, [float("nan")] * 12, 0), (3006, rows[1][1], 7), (3007, [-x for x in rows[9][1]], 0)]
    return rows


@pytest.mark.parametrize("block_rows", [8192, 24])
def test_nearest_vectors_equal_brute_force(spark, block_rows):
    df = spark.createDataFrame([(*r, "x") for r in vectors()], "vec_id long, e array<double>, label int, v string").repartition(3)
    got = nearest_vectors(df, "vec_id", "e", "label", block_rows=block_rows, most_centres=6).collect()
    mine = sorted((r.vec_id, r.label, r["rank"], r.neighbour, r.similarity) for r in got)
    want = brute_neighbours(vectors())
    assert [r[:4] for r in mine] == [r[:4] for r in want]
    assert [r[4] for r in mine] == pytest.approx([r[4] for r in want], abs=2e-6)


def test_balls_exclude_far_blocks(spark):
    """Where vectors lie in clusters, most pairs of blocks never meet."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 32))
    rows = [(i, (centres[i % 16] + rng.normal(size=32) * 0.01).tolist(), 0) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>, label int")
    found = nearest_vectors(df, "vec_id", "e", "label", block_rows=100, most_centres=16)
    assert found.where(F.col("vec_id") % 16 != F.col("neighbour") % 16).isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    assert nearest_vectors(df.where("false"), "vec_id", "e", "label").isEmpty()


def test_ranks_on_heavy_tails_and_ties(spark):
    rng = np.random.default_rng(2)
    values = [float(x) for x in np.round(np.exp(rng.normal(scale=9, size=3000)), 2)] + [7.25] * 1500 + [-1e12, 1e15, None, None]
    groups = ["a", "b", None]
    rows = [(i, groups[i % 3], v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    known = np.sort([v for v in values if v is not None])
    low, high = np.searchsorted(known, [v for v in values if v is not None], "left"), np.searchsorted(known, [v for v in values if v is not None], "right")
    want = {i: (a + (b - a + 1) / 2) / len(known) * 100 for (i, _, v), a, b in zip([r for r in rows if r[2] is not None], low, high)}
    got = {r.i: r.r for r in ranking.with_rank(df, "v", "r", ranking.average_percent, decimals=2).collect()}
    assert {i: r for i, r in got.items() if r is not None} == pytest.approx(want) and sum(r is None for r in got.values()) == 2
    counted = {(r.g, r.v): (r.below, r.ties, r.n) for r in ranking.value_counts(df, "v", ["g"], 2).collect()}
    for g in groups:
        mine = sorted(v for _, h, v in rows if h == g and v is not None)
        for v in set(mine):
            assert counted[g, v] == (sum(x < v for x in mine), mine.count(v), len(mine))
    median = {r.g: r["median"] for r in ranking.exact_median(df, "v", ["g"], decimals=2).collect()}
    assert median == {g: pytest.approx(float(np.median([v for _, h, v in rows if h == g and v is not None]))) for g in groups}
    windows = ranking.value_counts(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "floor" not in windows


def test_a_block_is_searched_some_rows_at_a_time(spark, monkeypatch):
    """A block of vectors is never compared with another as a whole."""
    from scoutframe.operators import embeddings

    seen = []
    one = embeddings.nearest
    monkeypatch.setattr(embeddings, "nearest", lambda x, y, k: seen.append(len(x)) or one(x, y, k))
    x = np.random.default_rng(2).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    packed = embeddings.pack_block("a", np.arange(300), x, 0, 6)
    assert max(seen) == embeddings.SEARCH_ROWS and sum(seen) == 300
    assert np.allclose(np.frombuffer(packed["worst"]), np.sort(np.round(x @ x.T, 9), axis=1)[:, -6])
