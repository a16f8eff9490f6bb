"""The neighbour search against brute force."""

import json

import numpy as np
import pandas as pd
import pytest

from scoutframe.operators.neighbours import (
    enrich_similar, grow_tree, nearest_keys, parse_similar, similar_players,
)

SCORES = ["a", "b", "c", "d", "e"]


def brute(pdf, k=5):
    out = set()
    for pos, g in pdf.groupby("Pos"):
        x = g[SCORES].fillna(0).to_numpy(float)
        n = np.sqrt((x * x).sum(axis=1))
        u = np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0)
        sims = np.round(u @ u.T, 9)
        keys = g["key"].to_numpy()
        for i, key in enumerate(keys):
            order = sorted((-sims[i, j], keys[j]) for j in range(len(keys)) if j != i)
            out |= {(pos, key, r + 1, o, -s) for r, (s, o) in enumerate(order[:k])}
    return out


def make(n, seed, signed=False):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 5)) - (0.5 if signed else 0)
    x[rng.random(n) < 0.33] = [1, 2, 3, 4, 5]  # a third are copies
    x[rng.random(n) < 0.05] = 0
    x[:, 4][rng.random(n) < 0.4] = 0  # an axis with a heavy value
    x[3, 1] = np.nan
    return pd.DataFrame(x, columns=SCORES).assign(
        key=[f"k{i:04d}" for i in range(n)], Pos=rng.choice(["FW", "GK"], n, p=[0.9, 0.1])
    )


@pytest.mark.parametrize("n,leaf,signed", [(400, 1024, False), (400, 16, False), (300, 8, True), (9, 4, False)])
def test_same_as_brute_force(spark, n, leaf, signed):
    pdf = make(n, n + leaf, signed)
    got = nearest_keys(spark.createDataFrame(pdf), "key", SCORES, leaf_rows=leaf).collect()
    mine = {(r["Pos"], r["key"], r["rank"], r["neighbour"], round(r["similarity"], 9)) for r in got}
    assert mine == brute(pdf)


def test_tree_covers_space():
    x = np.random.default_rng(1).random((500, 5))
    x[:200, 0] = 0.25
    tree = grow_tree(x, 5, 16)
    home = tree.locate(x)
    assert len(np.unique(home)) == 16 and np.bincount(home).max() < 100
    rows, leaves = tree.reach(x, np.zeros(len(x)))
    assert set(zip(range(len(x)), home)) <= set(zip(rows, leaves))
    rows, _ = tree.reach(x[:1], np.array([100.0]))
    assert len(rows) == 16


def players(spark):
    rows = [
        ("A", "Club1", "EPL", "FW", 1.0, 0.0, 70.0, "25-100", 1e6),
        ("B", "Club2", "LaLiga", "FW", 0.9, 0.1, None, "30", 2e6),
        ("C", "Club3", "EPL", "FW", 0.0, 1.0, 50.0, None, None),
        ("D", "Club4", "EPL", "GK", 1.0, 1.0, 40.0, "21-001", 5e6),
        ("E", "Club5", "EPL", "XX", 1.0, 1.0, 40.0, "21-001", 5e6),
    ]
    return spark.createDataFrame(
        rows, "Player string, Squad string, League string, Pos string, score_attacking double,"
        "score_defense double, uv_score_age_weighted double, Age string, market_value_eur double",
    )


def test_json_contract_and_enrichment(spark):
    df = similar_players(players(spark), scores=["score_attacking", "score_defense"]).persist()
    got = {r["Player"]: json.loads(r["similar_players"]) for r in df.collect()}
    assert [p["player"] for p in got["A"]] == ["B", "C"]
    assert got["A"][0] == {"player": "B", "club": "Club2", "league": "LaLiga", "uv_score_age_weighted": 0.0}
    assert got["D"] == [] and got["E"] == []  # alone in its position; outside the four
    cards = {(r["of_Player"], r["player"]): (r["age"], r["market_value_m"]) for r in enrich_similar(df).collect()}
    assert cards[("A", "B")] == (30, 2.0) and cards[("A", "C")] == (None, None)


def test_malformed_json_is_an_empty_list(spark):
    d = spark.createDataFrame([("not json",), (None,), ('[{"player":"X"}]',)], "similar_players string")
    assert [len(r["similar"]) for r in parse_similar(d).collect()] == [0, 0, 1]
