"""The grouped prefix join against comparing every two documents."""

import random
import re

import numpy as np
import pytest

from scoutframe.llm import jaccard_join
from scoutframe.llm.jaccard_join import least_overlap, prefix_length, shingle_sets, similar_documents

SCHEMA = "doc_id long, text string, n int, k string, sig string, g int, c long, label string, token string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 3:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "s", 2, 3, "l", "t") for r in rows], SCHEMA).repartition(4)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]

    def prose(n):
        return [rng.choice(words) for _ in range(n)]

    def edited(text, edits):
        text = list(text)
        for _ in range(edits):
            text[rng.randrange(len(text))] = rng.choice(words)
        return text

    passage, out = prose(60), []
    for length in (12, 40, 45, 120, 300):
        base = prose(length)
        out += [base] * 3 + [edited(base, rng.randint(1, max(1, length // 40))) for _ in range(12)]
        out += [base + prose(1), base[:-1], base + base[: length // 8]]
    out += [prose(rng.randint(1, 30)) + passage for _ in range(25)]  # a passage that many share
    out += [passage + prose(3) for _ in range(20)]  # of which some are near copies by it alone
    chain = prose(100)  # neighbours link, the ends do not
    for i in range(6):
        out.append(chain[i * 3 :] + prose(0) + [f"x{j}" for j in range(i * 3)])
    texts = [" ".join(t) for t in out] + ["", None, " \n", "one", "One", "one two", "ONE\ttwo", "a b c", "É b c", "é b c", "a b c a b c"]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    rows += [(None, texts[0]), (None, texts[50]), (None, "only a null id here"), (0, texts[20]), rows[5], rows[5], (None, None)]
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark, rows):
    """NULL and empty texts, copies, near copies, repeated rows and ids, a chain, a shared passage, clashing columns."""
    assert result(similar_documents(frame(spark, rows))) == brute(rows)


def test_other_thresholds(spark, rows):
    assert result(similar_documents(frame(spark, rows), percent=60)) == brute(rows, 60)
    assert result(similar_documents(frame(spark, rows), percent=100)) == brute(rows, 100)


def test_moved_shingles_and_cut_tokens_lose_nothing(spark, rows, monkeypatch):
    """Common shingles go last in the order, every token is cut into parts, and stars are few."""
    monkeypatch.setattr(jaccard_join, "PART_ROWS", 3)
    monkeypatch.setattr(jaccard_join, "MOST_MOVED", 10**6)
    assert result(similar_documents(frame(spark, rows), most=3)) == brute(rows)


def test_a_third_of_all_rows_are_copies_and_empty_table(spark, rows):
    many = rows + [(5000 + i, rows[0][1] or "a b c d") for i in range(len(rows) // 2)]
    assert result(similar_documents(frame(spark, many))) == brute(many)
    assert similar_documents(frame(spark, rows).where("false")).count() == 0


def test_sets_and_bounds():
    texts = ["a b c d", "B  c\nD a", "", "x", "x y", "x y z", " ".join(f"v{i}" for i in range(9000))]
    h, at = shingle_sets([t.encode() for t in texts], 3)
    sets = [set(h[a:b].tolist()) for a, b in zip(at, at[1:])]
    for i, t in enumerate(texts):
        assert len(sets[i]) == len(shingles(t)) and h[at[i] : at[i + 1]].tolist() == sorted(sets[i])
        for j, u in enumerate(texts):
            assert len(sets[i] & sets[j]) == len(shingles(t) & shingles(u))
    for n in range(1, 200):  # the least that any partner of the size shares, and the prefix that must meet it
        most = int(prefix_length(np.array([n]), 90)[0])
        assert n - most + 1 == -(-9 * n // 10)
        for m in range(n, 200):
            least = int(least_overlap(np.array([n]), np.array([m]), 90)[0])
            alike = [x for x in range(n + 1) if 100 * x >= 90 * (n + m - x)]
            assert (least <= n) == bool(alike) and (not alike or alike[0] == least)
