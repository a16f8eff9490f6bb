"""Each operator against a brute-force version, with NULLs, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoutframe.llm import tokens
from scoutframe.llm.common import crc_mod
from scoutframe.llm.components import components
from scoutframe.llm.decontam import decontaminate
from scoutframe.llm.langid import fit_profiles, identify
from scoutframe.llm.packing import LevelPacker, pack
from scoutframe.llm.pivot_search import top_inner_products
from scoutframe.llm.quality import fit_quality, score_quality
from scoutframe.llm.queries import vocabulary
from scoutframe.llm.simhash import near_duplicates
from scoutframe.llm.substring_dedup import SuffixAutomaton, substring_dedup
from scoutframe.llm.suffix_dedup import suffix_dedup, window_classes
from scoutframe.llm.token_store import Block, read_tokens, write_block, write_tokens
from scoutframe.llm.tokens import ByteEncoder, WordEncoder
from scoutframe.llm.toxicity import fit_toxicity, score_toxicity
from scoutframe.session import scratch_path

# names that the operators use inside stand beside the columns they read
SCHEMA = "doc_id long, text string, lang string, chunk int, fp string, score double, start string"
random.seed(5)
WORDS = ["the", "and", "of", "né", "Über", "x", "ß", "stone,", "river.", "green", "two", "日本", "a1", "it's"]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


COMMON = prose(40)
TEXTS = [
    (3, prose(60) + " " + COMMON), (1, COMMON + "\n" + prose(30)), (2, None), (4, ""), (5, "short one"),
    (6, prose(20) + COMMON + prose(20)), (7, COMMON), (9, COMMON), (9, COMMON), (10, prose(9000) + " " + COMMON),
    (11, "  \t\n "), (12, prose(25)), (None, prose(30) + " " + COMMON), (13, "x" * 70_000), (14, "né " * 500),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "aa", 1, "f", 0.5, "s") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(i):
    return -(2**63) if i is None else i


def covered_units(texts, length, joiner):
    """Brute force: which units of each text lie in a window that a smaller id also has."""
    first = {}
    for i, u in texts:
        for a in range(len(u) - length + 1):
            w = joiner(u[a : a + length])
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, u in texts:
        gone = [False] * len(u)
        for a in range(len(u) - length + 1):
            if first[joiner(u[a : a + length])] < key(i):
                gone[a : a + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("chunk_bytes", [1000, 1 << 20])
def test_suffix_dedup(docs, empty, chunk_bytes):
    data = [(i, (t or "").encode()) for i, t in TEXTS]
    want = sorted(
        (key(i), len(u), sum(g), bytes(b for b, x in zip(u, g) if not x))
        for (i, u), g in zip(data, covered_units(data, 50, bytes))
    )
    got = suffix_dedup(docs, chunk_bytes=chunk_bytes).collect()
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("chunk_bytes", [1000, 1 << 20])
def test_substring_dedup(docs, empty, chunk_bytes):
    data = [(i, (t or "").encode().split()) for i, t in TEXTS]
    want = sorted(
        (key(i), len(u), sum(g), b" ".join(w for w, x in zip(u, g) if not x).decode())
        for (i, u), g in zip(data, covered_units(data, 13, tuple))
    )
    out = substring_dedup(docs, carry=("lang", "chunk"), chunk_bytes=chunk_bytes)
    got = out.collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want
    assert {(r.lang, r.chunk) for r in got} == {("aa", 1)}
    assert substring_dedup(empty).count() == 0
    as_is = {r.doc_id: r.kept for r in substring_dedup(docs, untouched_as_is=True).collect()}
    assert as_is[11] == "  \t\n " and as_is[14] == "né " * 500


def test_window_classes_and_automaton():
    texts = [bytes(random.choice(b"ab") for _ in range(random.randint(6, 90))) for _ in range(30)]
    classes = window_classes([np.frombuffer(t, np.uint8) for t in texts], 6)
    seen = {}
    for t, c in zip(texts, classes, strict=True):
        for i, x in enumerate(c.tolist()):
            assert seen.setdefault(t[i : i + 6], x) == x
    assert len(set(seen.values())) == len(seen)
    known = SuffixAutomaton()
    for t in texts[:10]:
        known.add(list(t))
    for t in texts[10:]:
        hit = {i for s, n in known.matches(list(t), 5) for i in range(s, s + n)}
        want = {j for i in range(len(t) - 4) if any(t[i : i + 5] in k for k in texts[:10]) for j in range(i, i + 5)}
        assert hit == want


def test_packing(docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    library, ids = Tokenizer.from_file(path), {}
    for i, t in TEXTS:
        ids.setdefault(i, [*library.encode(t or "", add_special_tokens=False).ids, 0])
    rows = pack(docs, path, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(len(ids[i]) for i, _ in TEXTS)
    sequences = {}
    for r in rows:
        part = np.frombuffer(bytes(r.ids), np.uint32).tolist()
        assert part == ids[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert pack(empty, path).count() == 0


def test_packer_picks_the_smallest_sum_of_squares():
    p = LevelPacker(10)
    for size in (3, 6, 3, 2, 5, 1, 7, 4, 4, 2):
        def total(level):
            n = p.counts.copy()
            n[level] -= bool(level)
            if level + size < 10:
                n[level + size] += 1
            return int((n[1:10] ** 2).sum())

        best = p.best_level(size)
        choices = [h for h in range(10 - size + 1) if h == 0 or p.counts[h]]
        assert total(best) == min(map(total, choices))
        p.place((0, 0, np.zeros(size, np.uint32), size))
    small = LevelPacker(8, most_open=2)
    out = [w for n in (5, 6, 7, 5, 6, 7, 3) for w in small.place((0, 0, np.zeros(n, np.uint32), n))]
    sizes = [sum(len(x[2]) for x in w) for w in out + small.flush()]
    assert sum(sizes) == 39 and sizes[:4] == [8] * 4 and all(s & (s - 1) == 0 for s in sizes)


@pytest.mark.parametrize("low, high", [(600, 1023), (1, 1023), (1, 200)])
def test_a_full_packer_keeps_its_placements(low, high):
    """Past the bound one window is topped up for each that opens; the others stay, and no id is lost or doubled."""
    rng, packer, out, ids = np.random.default_rng(high), LevelPacker(1024, most_open=1100), [], []
    for i in range(9000):
        size = int(rng.integers(low, high + 1))
        ids.append((i, size))
        before = {id(w) for level in packer.open for w in level}
        done = packer.place((i, 0, np.arange(size, dtype=np.uint32), size))
        out += done
        assert len(done) <= 1 and packer.held == sum(map(len, packer.open)) == packer.counts.sum() <= 1100
        if i % 500 == 499:
            after = {id(w) for level in packer.open for w in level}
            assert len(before - after) <= 1 + 1024 // max(1, low)
    pieces = [p for w in out + packer.flush() for p in w]
    for i, size in ids[::97]:
        mine = sorted((start, part.tolist()) for doc, start, part, _ in pieces if doc == i)
        assert [x for _, part in mine for x in part] == list(range(size))
    assert sum(len(p[2]) for p in pieces) == sum(size for _, size in ids)
    assert all(sum(len(p[2]) for p in w) == 1024 for w in out)


def test_the_automaton_knows_all_substrings_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    passages = [rng.integers(0, 2**63, 40).tolist() for _ in range(40)] + [rng.integers(0, 3, 300).tolist() for _ in range(3)]
    known = SuffixAutomaton()
    for p in passages:
        known.add(p)
    parts = {tuple(p[a : a + 6]) for p in passages for a in range(len(p) - 5)}
    text = [x for p in passages[::3] for x in p[3:30]] + rng.integers(0, 3, 200).tolist()
    got = {i for start, size in known.matches(text, 6) for i in range(start, start + size)}
    assert got == {i + j for i in range(len(text) - 5) if tuple(text[i : i + 6]) in parts for j in range(6)}
    words = rng.integers(0, 2**63, 50_000).tolist()
    tracemalloc.start()
    large = SuffixAutomaton()
    large.add(words)
    assert tracemalloc.get_traced_memory()[0] < 250 * len(words)
    tracemalloc.stop()


def test_tokens_equal_the_library(monkeypatch):
    word, byte = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
    letters = [*"abDEéß'’.,!?1２ \n\t ​ΣİK中ा́\x1c\x85\x00ﬁ😀<|>", "'re", "<|endoftext|>", "tion", "the "]
    monkeypatch.setattr(tokens, "LONG_TEXT", 30)
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(800)]
    for mine in (WordEncoder(word, most=50), ByteEncoder(byte, most=50)):
        library = Tokenizer.from_file(word if isinstance(mine, WordEncoder) else byte)
        for t in texts:
            assert np.frombuffer(mine.encode(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids


def test_texts_are_split_together(monkeypatch):
    """Ids of many texts equal the library's; new parts go to its model together, not one by one."""
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    signs = [*"aBsSdtMrevl1²'.,!ÉßªµÀÿ÷×\x00\x7f\x80\x85\xa0\xad \n\t ", "'re", "'LL", " 's", "''s", "'VEx", "tion", "</w>", "the "]
    odd = [*signs, "’", "Σ", "\x1c", "中", "<|endoftext|>"]
    few = [*signs * 3, "’", "中", "İ", "\u2003", "\u0301", "ﬁ", "😀", "'"]
    rng = random.Random(5)
    latin = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    mixed = ["".join(rng.choice(x) for _ in range(rng.randint(0, 60))) for x in (odd, few) for _ in range(800)]
    every = [chr(c) for c in range(256)] + [f"a{chr(c)}'{chr(c)}s" for c in range(256)]
    for slab, together, long, most in ((1, 1, 30, 50), (500, 7, 30, 50), (4 << 20, 20_000, 1 << 20, 10_000)):
        monkeypatch.setattr(tokens, "SLAB", slab)
        monkeypatch.setattr(tokens, "LONG_TEXT", long)
        monkeypatch.setattr(WordEncoder, "TOGETHER", together)
        for texts in (latin, mixed, every, [], ["", "", " "], ["x" * 200, "it's"]):
            found = list(WordEncoder(path, most=most).encode_all(texts))
            assert len(found) == len(texts)
            for t, x in zip(texts, found, strict=True):
                assert np.frombuffer(x, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    mine = WordEncoder(path, most=10)
    monkeypatch.setattr(mine.parts, "make", None)
    assert len(list(mine.encode_all(latin))) == len(latin)


def test_token_store(spark, docs, empty):
    path, folder = vocabulary("word_bpe_49k.json"), scratch_path(spark)
    encoder = Tokenizer.from_file(path)
    write_tokens(docs, folder, path, block_tokens=300, least=2)
    got = read_tokens(spark, folder).orderBy("start").collect()
    want = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(ids) // 4, ids)
        start += r.n_tokens
    write_tokens(empty, empty_folder := scratch_path(spark), path)
    assert read_tokens(spark, empty_folder).count() == 0


def test_block_random_access():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.choice([5, 6, 7], n), 1).astype(np.uint32) for n in (0, 1, 500, 3, 900)]
    image = write_block([4, None, 2, 2, 9], [d.tobytes() for d in docs], 6, 16, 2)
    block = Block(image)
    assert len(block.rules) and [d for d, _, _ in block.documents()] == [4, None, 2, 2, 9]
    for (_, start, ids), want in zip(block.documents(), docs, strict=True):
        assert ids.tolist() == want.tolist() == block.tokens(start, len(want)).tolist()
        assert block.tokens(start + len(want) // 2, 1).tolist() == want[len(want) // 2 : len(want) // 2 + 1].tolist()
    with pytest.raises(ValueError):
        Block(b"XXXX" + image[4:])


def test_no_frequent_pair_is_left():
    """With the settings that write_tokens has, every pair of the symbols is below ``least``, counted plainly."""
    import inspect

    given = inspect.signature(write_tokens).parameters
    rounds, most, least = (given[k].default for k in ("rounds", "pairs_per_round", "least"))
    rng = np.random.default_rng(3)
    passage = rng.integers(10, 40_000, 1000)
    copies = [np.concatenate((rng.integers(10, 40_000, 5), passage, [1])).astype(np.uint32) for _ in range(40)]
    mixed = [rng.choice(30, n).astype(np.uint32) for n in (4000, 1, 0, 3000)] + [np.full(n, 7, np.uint32) for n in (15, 16, 17, 900)]
    many = [np.append(np.repeat(rng.permutation(50_000), 2), 1).astype(np.uint32) for _ in range(9)]
    for docs in (copies, mixed, many):
        docs = [d for d in docs if len(d)]
        block = Block(write_block(list(range(len(docs))), [d.tobytes() for d in docs], rounds, most, least))
        assert all(got.tolist() == d.tolist() for (_, _, got), d in zip(block.documents(), docs, strict=True))
        ends, counts, before = set(np.cumsum([len(d) for d in docs]).tolist()), {}, None
        seq, at = block.seq.tolist(), block.at.tolist()
        for i, p in enumerate(zip(seq, seq[1:])):
            if at[i + 1] in ends or p == before:
                before = None
                continue
            counts[p], before = counts.get(p, 0) + 1, p
        assert len(block.rules) and max(counts.values(), default=0) < least
    assert len(Block(write_block(list(range(40)), [d.tobytes() for d in copies], rounds, most, least)).seq) <= 40 * 8


def test_pivot_search(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(0, 0.3, 8).astype(float).tolist()) for i in range(300)]
    data[7] = data[8] = (8, data[50][1])  # an id twice, and ties
    data += [(1000, None), (1001, [0.1] * 7 + [None]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8)]
    data += [(None, [1.0] * 8), (1050, [0.5, 0.5]), (1051, [0.25, 0.5])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    q = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all()]
    want = []
    for i, v in q:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v))[:5]
            want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    got = top_inner_products(frame, F.col("vec_id") % 50 == 0, block_rows=64, query_rows=3, pivots=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_inner_products(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_language(spark, docs, empty):
    a, b = "qa wa ka sa na".split(), "il om ul im ol".split()
    rows = [(i, " ".join(random.choice(w) for _ in range(60)), n) for i in range(40) for w, n in ((a, "one"), (b, "two"))]
    train = spark.createDataFrame([*rows, (99, None, "one"), (98, "zz", None)], "doc_id long, text string, lang string")
    profiles = fit_profiles(train, F.lit(True))
    assert list(profiles) == ["one", "two"]
    asked = [("QA WA KA", "one"), ("il, om; ul!", "two"), (None, "und"), ("", "und"), ("12 ... 7", "und"), ("qa " * 90_000, "one")]
    frame = spark.createDataFrame(asked, "text string, want string").withColumn("score", F.lit(9))
    out = identify(frame, profiles).collect()
    assert all(r.lang_pred == r.want and 0 <= r.score <= 1 for r in out) and len(out) == len(asked)
    assert identify(empty, profiles).count() == 0
    assert {r.lang_pred for r in identify(docs, fit_profiles(empty, F.lit(True))).collect()} == {"und"}


def test_decontaminate(spark, docs, empty):
    item = "One two, three FOUR five six; seven eight nine ten eleven twelve"
    bench = [(1, item), (1, item), (20, item.upper()), (3, "Tiny item"), (4, None), (5, "..."), (None, "né né né"), (7, "naïve É " * 5)]
    texts = [
        (1, "before " + item.lower() + " after"), (2, "two three four five six seven eight nine ten"),
        (3, "a tiny, ITEM here"), (4, None), (5, ""), (6, "NÉ né né"), (6, "NÉ né né"), (None, item), (8, "né né né né"),
        (9, ("x " * 5000) + item + " tiny item"), (10, "naïve É naïve É naïve É naïve É naïve É"), (11, "naïve é " * 5),
    ]

    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in t).split(" ")

    windows = set()
    for i, t in bench:
        w = [x for x in words(t) if x]
        n = min(10, len(w))
        windows |= {(i, tuple(w[a : a + n])) for a in range(len(w) - n + 1) if n}
    want = {}
    for i, t in texts:
        w, hit, items = [x for x in words(t) if x], set(), set()
        for k, x in windows:
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    items |= {str(k)} if k is not None else set()
        want[i] = (len(w), len(hit), sorted(items))
    frame = spark.createDataFrame([(*r, 0) for r in texts], "doc_id long, text string, n int")
    marks = spark.createDataFrame([(*r, "c") for r in bench], "item_id long, text string, doc_id string")
    for most in (100_000, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(frame, marks, broadcast_rows=most).collect()}
        assert got == want
        assert decontaminate(frame, marks, broadcast_rows=most).count() == len(texts)
    assert decontaminate(empty, marks).count() == 0
    assert decontaminate(frame, marks.where("false")).where("n_hit > 0").count() == 0


def test_decontaminate_keeps_rows_of_one_id_apart(spark):
    """Repeated and NULL ids with different texts, and whole rows repeated."""
    texts = [(None, "a b c d e"), (None, "tiny item x y"), (5, "tiny item"), (5, "nothing here at all"), (5, "tiny item"), (5, None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(7, "Tiny item")], "item_id long, text string")
    for most in (100_000, 0):
        got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate(frame, marks, broadcast_rows=most).collect()]
        want = [(i, len((t or "").split()), 2 * ("tiny" in (t or "")), ["7"] * ("tiny" in (t or ""))) for i, t in texts]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decontaminate_capital_sigma(spark):
    """A capital sigma at a word's end is the same word before a full stop as before a space."""
    frame = spark.createDataFrame([(1, "x ΝΟΜΟΣ.ΑΡΘΡΟ y"), (2, "νομος αρθρο")], "doc_id long, text string")
    marks = spark.createDataFrame([(7, "ΝΟΜΟΣ ΑΡΘΡΟ")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate(frame, marks).collect()}
    assert got == {1: (4, 2, ["7"]), 2: (2, 0, [])}


def test_decontamination_plan_is_native(spark, docs):
    marks = spark.createDataFrame([(1, COMMON)], "item_id long, text string")
    plan = decontaminate(docs, marks)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_duplicates(spark, docs, empty):
    import xxhash

    base = [prose(200) for _ in range(6)]
    rows = list(TEXTS) + [(100 + 10 * i + j, t + " " + prose(j)) for i, t in enumerate(base) for j in range(6)]
    prints = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[a : a + 3]) for a in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    group = list(range(len(prints)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                group[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for a, (i, _) in enumerate(prints):
        if i is not None:
            least[root(a)] = min(least.get(root(a), i), i)
    want = sorted((key(i), f"{f:016x}", least.get(root(a))) for a, (i, f) in enumerate(prints))
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = near_duplicates(frame).collect()
    assert sorted((key(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert near_duplicates(empty).count() == 0


def test_links_of_cut_tiles(spark):
    from scoutframe.llm.simhash import links

    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 2**63, 40)}
    for x in list(fps):
        fps |= {x ^ (1 << int(b)) for b in rng.integers(0, 62, 8)}
    fps = sorted(fps)
    want = {}
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    for h, o in ((4096, 65536), (3, 5)):
        roots = {r.node: r.root for r in components(links(frame, 2, h, o)).collect()}
        want[h] = [roots.get(x, x) for x in fps]
    assert want[4096] == want[3]
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    named = dict(zip(fps, want[3]))
    assert near and all(named[a] == named[b] for a, b in near)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 180)} | {300: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_and_quality(spark, empty):
    rows, labels = [], []
    for i in range(400):
        s = [prose(random.randint(3, 9)) + "." for _ in range(8)]
        toxic, bad = int(i % 4 == 0), int(i % 5 == 0)
        if toxic:
            s[3] = "you " + random.choice(["slur", "insult"]) + " x."
        t = " ".join(s)
        rows.append((i, "*** ".join(t.split()) if bad else t))
        labels.append((i, 1 - bad, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    train, held = crc_mod("doc_id", 3) != 1, crc_mod("doc_id", 3) == 1
    tox = score_toxicity(docs, fit_toxicity(docs, marks, train, least_docs=2))
    out = tox.join(marks, "doc_id").where(held).collect()
    assert np.mean([r.predicted == r.toxic for r in out if r.toxic is not None]) > 0.95
    texts = {i: t.encode() for i, t in rows}
    found = [texts[r.doc_id][s.start :][:30] for r in out if r.toxic for s in r.toxic_sentences]
    assert found and np.mean([b"slur" in f or b"insult" in f for f in found]) > 0.9
    model = fit_quality(docs, marks, train, bits=16)
    out = score_quality(docs, model).join(marks, "doc_id").where(held).collect()
    assert np.mean([r.predicted == r.quality for r in out if r.quality is not None]) > 0.95
    odd = spark.createDataFrame([(None,), ("",), ("...",), (prose(40_000),)], "text string")
    for scored in (score_toxicity(odd, fit_toxicity(empty, marks, train)), score_quality(odd, model)):
        assert all(0 <= r.score <= 1 for r in scored.collect())
    assert score_quality(empty, fit_quality(empty, marks.where("false"), train)).count() == 0


def test_digests_of_queries(spark):
    """The byte-exact query over a whole table against brute force."""
    from scoutframe.llm.queries import op2_suffix_dedup, op10_token_store

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first = {}
    for i in sorted(texts):
        for a in range(len(texts[i]) - 49):
            first.setdefault(texts[i][a : a + 50], i)
    for r in op2_suffix_dedup(spark, sf).collect():
        b, gone = texts[r.doc_id], bytearray(len(texts[r.doc_id]))
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < r.doc_id:
                gone[a : a + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (r.n_removed, r.kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())
    encoder, start = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    for r in op10_token_store(spark, sf).orderBy("doc_id").collect():
        ids = np.array([*encoder.encode(texts[r.doc_id].decode(), add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens


def test_pipeline(spark):
    """Every stage's decisions against plain versions of them."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicate", "substrings", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark)
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
    language = kept["language"].collect()
    assert all(any(c.isalpha() for c in r.text) for r in language)
    near = {r.doc_id for r in kept["near_duplicate"].collect()}
    assert near == {r.doc_id for r in near_duplicates(kept["language"]).where("doc_id = component_id").collect()}
    data = [(r.doc_id, r.text.encode().split()) for r in kept["near_duplicate"].collect()]
    gone = {i: (u, g) for (i, u), g in zip(data, covered_units(data, 13, tuple))}
    for r in kept["substrings"].collect():
        u, g = gone[r.doc_id]
        assert r.text.encode().split() == [w for w, x in zip(u, g) if not x] and r.n_chars == len(r.text)
    clean = {r.doc_id for r in kept["decontamination"].collect()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    flags = decontaminate(kept["substrings"], bench).collect()
    assert clean == {r.doc_id for r in flags if not r.n_hit} and len(clean) > 0
    assert {r.doc_id for r in kept["packing"].collect()} == clean


def test_pipeline_stages_tell_rows_apart(spark):
    """Repeated and NULL ids, an empty table and extra columns: one row of a group stays, only rows with a hit go."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").first().text
    plain = [prose(60) for _ in range(4)]
    rows = [
        (1, plain[0]), (1, plain[0]), (None, plain[0]), (None, plain[1]), (None, plain[1]), (3, plain[2]), (3, plain[3]),
        (None, plain[2] + " " + item), (3, item), (4, None), (4, ""), (9, plain[3]),
    ]
    frame = spark.createDataFrame(
        [(i, t, "aa", "s", 1, "z", 2) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, component string, _hash int",
    )
    out = corpus_pipeline.near_duplicate(spark, frame, sf)
    assert out.columns == list(corpus_pipeline.COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    texts = {t for _, t in got}
    assert texts >= {plain[0], plain[1], plain[2], plain[3]} and len(got) == len({(t or "").strip() for t in texts})
    assert (1, plain[0]) in got and (3, plain[3]) in got and (4, None) in got or (4, "") in got
    out = corpus_pipeline.decontamination(spark, frame, sf)
    clean = [r for r in rows if item not in (r[1] or "")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(clean, key=repr)
    for stage in (corpus_pipeline.near_duplicate, corpus_pipeline.decontamination, corpus_pipeline.substrings, corpus_pipeline.packing):
        assert stage(spark, frame.where("false"), sf).count() == 0


def test_language_stage_without_profiles(spark):
    """Documents with a letter stay where lang is all NULL or no labelled row is trained on."""
    import corpus_pipeline

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1)
    texts = [(200, "né ja"), (201, "12 ... 7"), (202, None), (203, ""), (held, "日本"), (None, "plain words")]
    for label in (None, "aa"):
        rows = [(i, t, label if i == held else None, "s", 1) for i, t in texts]
        frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        out = corpus_pipeline.language(spark, frame, "")
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert sorted(key(r.doc_id) for r in out.collect()) == sorted(key(i) for i in (200, held, None))
