"""The fuzzy join against brute force over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from scoutframe.functions.text import match_text, normalize_name
from scoutframe.operators.fuzzy import fuzzy_best, name_score, token_sort_ratio
from scoutframe.session import salted_join


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def score(a, b):
    edit = lambda x, y: 100 * (1 - lev(x, y) / max(len(x), len(y)))
    ts = lambda x: " ".join(sorted(x.split(" ")))
    ta, tb = set(a.split(" ")), set(b.split(" "))
    nested = 90 if ta <= tb or tb <= ta else 0
    return round(max(edit(a, b), 0.95 * edit(ts(a), ts(b)), nested), 6)


def brute(left, right, threshold):
    out = {}
    for a in left:
        best = min(((-score(a, b), b) for b in right), default=(0, ""))
        if -best[0] >= threshold:
            out[a] = (best[1], -best[0])
    return out


def names(rng, n, firsts):
    made = set()
    while len(made) < n:
        parts = [rng.choice(firsts)] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 2))]
        made.add(" ".join(p for p in parts if p))
    return sorted(made)


@pytest.mark.parametrize(
    "threshold,heavy,band", [(80, 1000, 1000), (70, 1000, 10), (80, 3, 1000), (70, 5, 10), (92, 4, 10), (60, 4, 10), (50, 1000, 1000), (40, 5, 10)]
)
def test_same_as_all_pairs(spark, threshold, heavy, band):
    """Also with tiny bounds, so that every refinement level and both bands are used."""
    rng = random.Random(threshold + heavy)
    firsts = ["maria", "mari", "joao", "de", ""]
    left, right = names(rng, 90, firsts), names(rng, 90, firsts)
    l = spark.createDataFrame([(x.strip(),) for x in left if x.strip()], "norm string")
    r = spark.createDataFrame([(x.strip(),) for x in right if x.strip()], "norm string")
    got = {x["norm_l"]: (x["norm_r"], x["score"]) for x in fuzzy_best(l, r, threshold, heavy_rows=heavy, band_rows=band).collect()}
    want = brute([x.strip() for x in left if x.strip()], sorted({x.strip() for x in right if x.strip()}), threshold)
    assert got == want and len(want) > 4


def test_equi_key_keeps_groups_apart(spark):
    l = spark.createDataFrame([("A", "anna berg"), ("B", "anna berg")], "g string, norm string")
    r = spark.createDataFrame([("A", "anna bergh"), ("B", "otto")], "g string, norm string")
    assert [(x["g"], x["norm_r"]) for x in fuzzy_best(l, r, 80, ["g"]).collect()] == [("A", "anna bergh")]


def test_threshold_bounds(spark):
    d = spark.createDataFrame([("a",)], "norm string")
    for bad in (0, 101):
        with pytest.raises(ValueError):
            fuzzy_best(d, d, bad)


@pytest.mark.parametrize("band", [1000, 10])
def test_a_known_score_bounds_the_search(spark, band):
    """Names that some right name is known to match are searched from that score on, and the best is the same."""
    rng = random.Random(band)
    left, right = ({x.strip() for x in names(rng, 80, ["maria", "mari", "joao", "de"]) if x.strip()} for _ in range(2))
    best = brute(sorted(left), sorted(right), 70)
    rows = [(x, max(70.0, float(score) - rng.choice([0, 0, 3, 40]))) for x, (_, score) in best.items()]
    l = spark.createDataFrame(rows + rows[:3], "norm string, score double")
    r = spark.createDataFrame([(x,) for x in right], "norm string")
    found = fuzzy_best(l, r, 70, known="score", band_rows=band)
    assert {x["norm_l"]: (x["norm_r"], x["score"]) for x in found.collect()} == best
    assert fuzzy_best(l.where("false"), r, 70, known="score").isEmpty()


def test_gate_and_special_names(spark):
    rows = [
        ("Known Player", "Unknown Player"), ("Alexander Arnold", "Trent Alexander-Arnold"),
        ("Vinicius Junior", "Vinicius Jr."), ("", "x"),
    ]
    a, b = (match_text(normalize_name(F.col(x))) for x in "ab")
    got = spark.createDataFrame(rows, "a string, b string").select(
        name_score(a, b).alias("s"), token_sort_ratio(a, b).alias("t")
    ).collect()
    assert got[0]["s"] >= 80 and got[0]["t"] < 60  # a near name the gate turns away
    assert got[1]["s"] >= 80 and got[1]["t"] >= 60
    assert got[2]["s"] == 100
    assert got[3]["s"] == 0


def test_salted_join_is_the_plain_join(spark):
    probe = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("p"))
    index = spark.range(200).select(F.when(F.col("id") < 120, 0).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("q"))
    plain = sorted(map(tuple, probe.join(index, "k").select("k", "p", "q").collect()))
    salted = salted_join(probe, index, ["k"], rows_per_salt=10)
    assert sorted(map(tuple, salted.select("k", "p", "q").collect())) == plain


def test_names_are_not_fetched_to_the_driver(spark, tmp_path):
    """Rows that explode makes of names are joined by shuffle, however small the files they come from."""
    spark.createDataFrame([(f"anna berg{i}",) for i in range(300)], "norm string").write.parquet(str(tmp_path / "n"))
    d = spark.read.parquet(str(tmp_path / "n"))
    plan = fuzzy_best(d, d, 80)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_no_open_names_leave_the_right_names_uncut(spark):
    """A search for no names has an empty plan, whatever the size of the right side."""
    r = spark.createDataFrame([("A", "anna berg")], "g string, norm string")
    found = fuzzy_best(r.where("false"), r, 80, ["g"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == ["g", "norm_l", "norm_r", "score"] and "Join" not in plan and found.isEmpty()
