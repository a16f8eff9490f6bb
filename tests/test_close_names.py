"""The block search of names against all pairs, and how much of them it looks at."""

import random

import numpy as np
import pytest
from test_fuzzy import brute, lev, names

from scoutframe.functions.text import normalize_name
from scoutframe.operators import close_names, fuzzy
from scoutframe.operators.fuzzy import fuzzy_best


def by_token(texts):
    return [" ".join(sorted(x.split(" "))) for x in texts]


def found(left, bound, right):
    i, j = close_names.closest((left, by_token(left)), np.array(bound, float), (right, by_token(right)), 0.95)
    assert len({*zip(i, j, strict=True)}) == len(i)
    return {(left[x], right[y]) for x, y in zip(i, j, strict=True)}


def all_pairs(left, bound, right):
    out = set()
    for a, least in zip(left, bound, strict=True):
        edit = lambda x, y: 100 * (1 - lev(x, y) / max(len(x), len(y)))
        scores = {b: max(edit(a, b), 0.95 * edit(*by_token([a, b]))) for b in right}
        best = max(scores.values())
        out |= {(a, b) for b, s in scores.items() if best >= least - 1e-9 and s > best - 1e-6}
    return out


@pytest.mark.parametrize("alphabet,n_right", [("ab", 40), ("abcdefgh", 300), ("aé漢\U0001f600\x00", 120), ("abc", 1), ("".join(map(chr, range(300, 500))), 90)])
def test_closest_equals_all_pairs(alphabet, n_right):
    """Letters beyond the basic plane, NUL, more letters than classes, one text; each left text has its own bound."""
    rng = random.Random(n_right)
    some = lambda n: sorted({" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 3))) for _ in range(n)})
    left, right = some(60), some(n_right)
    right += [x + alphabet[0] for x in left[:20]] + ["z" * 64, left[0] + "y" * (64 - len(left[0]))]
    right = sorted(set(right))
    bound = [rng.choice([40, 60, 73.684211, 80, 90, 100]) for _ in left]
    assert found(left, bound, right) == all_pairs(left, bound, right)
    assert found([], [], right) == found(left, bound, []) == set()


def test_few_pairs_are_compared(monkeypatch):
    """Names with a common first name meet in their letters only, and few of all pairs come to an edit distance."""
    rng = random.Random(4)
    made = lambda n: [f"{rng.choice(['maria', 'joao', 'anna'])} {''.join(rng.choice('bcdfghklmnaeiour') for _ in range(8))}" for _ in range(n)]
    right = made(6000)
    left = [x[:-2] + x[-1] for x in right[:300]]
    compared, one = [], close_names.distances
    monkeypatch.setattr(close_names, "distances", lambda masks, i, *a: compared.append(len(i)) or one(masks, i, *a))
    assert {(x, y) for x, y in zip(left, right, strict=False)} <= found(left, [85] * 300, right)
    assert sum(compared) < 0.005 * len(left) * len(right)


@pytest.mark.parametrize("equi", [[], ["g"]])
def test_many_blocks_and_groups(spark, monkeypatch, equi):
    """Blocks of a few names, groups of one and of several blocks, names without a group."""
    for x, n in (("LEFT_ROWS", 16), ("RIGHT_ROWS", 24), ("LEAST_ROWS", 8)):
        monkeypatch.setattr(fuzzy, x, n)
    rng = random.Random(6)
    firsts = ["maria", "mari", "joao", "de", ""]
    left, right = ([(rng.choice(["a", "a", "a", "b", None]), x.strip()) for x in names(rng, 120, firsts) if x.strip()] for _ in range(2))
    l, r = (spark.createDataFrame([*x, *x[:9]], "g string, norm string") for x in (left, right))
    got = {(x["g"] if equi else None, x["norm_l"]): (x["norm_r"], x["score"]) for x in fuzzy_best(l, r, 70, equi, band_rows=20).collect()}
    want = {}
    for g in ["a", "b"] if equi else [None]:
        mine, theirs = ([x for h, x in rows if not equi or h == g] for rows in (left, right))
        want |= {(g, k): v for k, v in brute(mine, theirs, 70).items()}
    assert got == want and len(want) > 30


@pytest.mark.parametrize("threshold", [80, 50])
def test_names_longer_than_a_word(spark, threshold):
    """Pairs with a name of over 64 letters are found too, whichever side it is on."""
    rng = random.Random(threshold)
    some = lambda n, m: "".join(rng.choice("abcd ") for _ in range(rng.randint(n, m))).strip() + "x"
    base = [" ".join(some(55, 80).split()) for _ in range(25)] + [" ".join(some(5, 9).split()) for _ in range(15)]
    cut = lambda x: "".join(y for y in x if rng.random() > 0.08).strip()
    left, right = sorted(set(base)), sorted({" ".join(cut(x).split()) for x in base} | {x + "qqqqqqqq" for x in base[:5]})
    l, r = (spark.createDataFrame([(y,) for y in x], "norm string") for x in (left, right))
    got = {x["norm_l"]: (x["norm_r"], x["score"]) for x in fuzzy_best(l, r, threshold).collect()}
    want = brute(left, right, threshold)
    assert got == want and max(map(len, want)) > 64 > min(map(len, want))


def test_known_scores_need_one_search(spark, monkeypatch):
    """Each name is searched from its own known score on; names of other scores do not make another search."""
    searches, one = [], fuzzy._best_pairs
    monkeypatch.setattr(fuzzy, "_best_pairs", lambda *a, **k: searches.append(1) or one(*a, **k))
    l = spark.createDataFrame([("anna berg", 70.0), ("bruno silva", 76.0), ("carla costa", 81.0), ("dora dias", 88.0)], "norm string, score double")
    r = spark.createDataFrame([("anna bergh",), ("bruno silvo",), ("carla kosta",), ("dora diaz",)], "norm string")
    got = {(x["norm_l"], x["norm_r"]) for x in fuzzy_best(l, r, 70, known="score", band_rows=1).collect()}
    assert got == {("anna berg", "anna bergh"), ("bruno silva", "bruno silvo"), ("carla costa", "carla kosta"), ("dora dias", "dora diaz")}
    assert len(searches) == 1


def test_pairs_are_scored_once(spark, tmp_path):
    """No filter on the score goes below the step that makes it, where every pair would be scored again."""
    spark.createDataFrame([(f"anna berg{i}",) for i in range(50)], "norm string").write.parquet(str(tmp_path / "n"))
    d = spark.read.parquet(str(tmp_path / "n"))
    plan = fuzzy_best(d, d, 80)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == 2


def test_plain_letters_are_not_translated(spark):
    """Accents are looked up only in names that have a letter beyond ASCII; the result is the same."""
    rows = ["  Ana\tMaria ", "Æsir Ørn", "İnan Çelik", "a\x1cb", "", None, "José-María"]
    d = spark.createDataFrame([(x,) for x in rows], "n string")
    got = d.select(normalize_name(d["n"]).alias("n"))
    assert [x["n"] for x in got.collect()] == ["ana maria", "sir rn", "inan celik", "a b", "", "", "jose-maria"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("translate(")
