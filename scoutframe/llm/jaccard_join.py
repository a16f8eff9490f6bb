"""Documents whose sets of word shingles are nearly equal: a grouped prefix join.

Shingles have a global order: by hash, but those common in a bounded sample come last.  Two sets as alike as
asked share one of their first few shingles, the prefix; sets of one size and one prefix form a group, and only
groups meet, on the shingles of their prefixes.

1. Equal sets are one class, so copies cost nothing.
2. On the first few shingles of the prefixes groups are tied to leaders; these star pairs are verified on whole
   sets and give components.  A family of near copies mostly becomes one component here, without all of its pairs.
3. Shingles on which very many components still meet are moved to the end of the order, and prefixes are drawn anew.
4. Every two groups that meet on a shingle, may be alike, and have members in different components are expanded
   into such members and verified.  Nothing else can add a link between components.

Sizes, places in the prefix, how many shingles long prefixes share, the parity of 256 hash bits and the prefixes' own difference (both bound that of
the sets from below) filter pairs; none of these filters loses a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.llm.common import distinct, join_counted, mix, pick, slabs, text_bytes, word_units
from scoutframe.llm.components import components
from scoutframe.session import cut_lineage, small_side

WORDS = 4  # of 64 parity bits
BITS = [f"b{i}" for i in range(WORDS)]
PART_ROWS = 16_384
TILE = 1024
LEADERS = 32
LONG_RUN = 256
LONG_PREFIX = 64
STAR_PLACES = 24
MOST_MOVED = 100_000
ROUNDS = 2
SAMPLE, COMMON = 5000, 5
BROADCAST_ROWS = 200_000  # of 24 bytes


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct shingle hashes, ascending, and where each text's begin (one entry more at the end).

    Words are runs other than ASCII white space, A-Z lower-cased; fewer words than ``shingle`` are one shingle.
    """
    units, bounds = word_units([t.lower() for t in texts])
    words = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), words)
    n = max(0, len(units) - shingle + 1)
    powers = [np.uint64(pow(0x9E3779B97F4A7C15, i, 2**64)) for i in range(shingle)]
    h = np.zeros(n, np.uint64)
    for i, p in enumerate(powers):
        h += units[i : n + i] * p
    inside = doc[:n] == doc[shingle - 1 :] if n else np.zeros(0, bool)
    few = np.flatnonzero((words > 0) & (words < shingle))
    short = np.zeros(len(few), np.uint64)
    for i, p in enumerate(powers[:-1]):
        has = words[few] > i
        short[has] += units[bounds[few[has]] + i] * p
    short += words[few].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    h = mix(np.concatenate((h[inside], short)))
    doc = np.concatenate((doc[:n][inside], few))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


def spare_length(n: np.ndarray, percent: int) -> np.ndarray:
    """By how many shingles the prefixes of large sets are drawn longer; so many more must then be shared."""
    p = prefix_length(n, percent)
    return np.where(p >= LONG_PREFIX, p // 4, 0)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return -(-(n + m) * percent // (100 + percent))


def parity_bits(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per set 64 * WORDS bits: the parity of the shingles that fall on each."""
    size = 64 * WORDS
    out = np.zeros((len(at) - 1, WORDS), np.uint64)
    step = 4096  # sets at a time
    for a in range(0, len(at) - 1, step):
        b = min(a + step, len(at) - 1)
        part = h[at[a] : at[b]]
        which = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        ones = np.bincount(which * size + (part >> np.uint64(56)).astype(np.int64), minlength=(b - a) * size) & 1
        out[a:b] = np.packbits(ones.astype(np.uint8).reshape(b - a, size), axis=1).view(np.uint64).reshape(b - a, WORDS)
    return out


def _prints(docs: DataFrame, shingle: int, percent: int, moved: np.ndarray) -> DataFrame:
    """(doc_id, k, n, sig, gkey, prefix, bits) of every row; ``moved`` shingles come last in the order."""
    names = ["doc_id", "k", "n", "sig", "gkey", "prefix", *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in slabs(texts, 2 << 20):
                h, at = shingle_sets(texts[a:b], shingle)
                n = np.diff(at)
                doc = np.repeat(np.arange(b - a), n)
                ordered = h
                if len(moved):
                    late = np.isin(h, moved)
                    ordered = h[np.lexsort((h, late, doc))]
                p = np.minimum(prefix_length(n, percent) + spare_length(n, percent), n)
                chosen = ordered[np.arange(len(h)) - at[:-1][doc] < p[doc]]
                ends = np.concatenate(([0], np.cumsum(p)))
                sig = [xxh3_128_digest(h[x:y].tobytes()) for x, y in zip(at, at[1:])]
                gkey = [
                    xxh3_128_digest(chosen[x:y].tobytes() + int(z).to_bytes(8, "little")) for x, y, z in zip(ends, ends[1:], n)
                ]
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chosen.view(np.int64)))
                bits = parity_bits(h, at).view(np.int64)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("k"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()),
                     pa.array(gkey, pa.binary()), prefix, *[pa.array(bits[:, i]) for i in range(WORDS)]], names,
                )

    schema = "doc_id long, k long, n long, sig binary, gkey binary, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)
    return docs.mapInArrow(run, schema)


def _may_link(rows: dict, i, j, percent: int, bitwise) -> np.ndarray:
    """Whether entries ``i`` and ``j`` of a run can be alike; ``bitwise`` says where the bits tell."""
    n, m = rows["n"][i], rows["n"][j]
    least = least_overlap(n, m, percent)
    ok = 1 + np.minimum(n - 1 - rows["pos"][i], m - 1 - rows["pos"][j]) >= least  # if this is the first they share
    ok |= np.minimum(spare_length(n, percent), spare_length(m, percent)) > 0  # these are counted on every shingle
    ok &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    apart = sum(np.bitwise_count((rows[b][i] ^ rows[b][j]).view(np.uint64)).astype(np.int64) for b in BITS)
    return ok & ((apart <= n + m - 2 * least) | ~bitwise)


def _run_ids(rows: dict) -> np.ndarray:
    token, cell = rows["token"], rows["cell"]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
    return np.cumsum(new)


def _stars(rows: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, leader) pairs, all runs at a time: leaders have most copies, and an entry is tied to the first
    that it may be alike to."""
    run = _run_ids(rows)
    left = np.lexsort((rows["c"], -rows["copies"], run))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _ in range(LEADERS):
        new = np.ones(len(left), bool)
        new[1:] = run[left[1:]] != run[left[:-1]]
        lead = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        left, lead = left[~new], lead[~new]
        if not len(left):
            break
        tied = _may_link(rows, left, lead, percent, np.True_)
        a.append(left[tied])
        b.append(lead[tied])
        left = left[~tied]
    return np.concatenate(a), np.concatenate(b)


def _short_meetings(rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two entries of one run, all runs at a time; no run is long."""
    run = _run_ids(rows)
    for d in range(1, len(run)):
        i = np.flatnonzero(run[d:] == run[:-d])
        if not len(i):
            break
        yield i, i + d


def _long_meetings(rows: dict, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two entries of a run whose sizes are near enough, in tiles."""
    order = np.argsort(rows["n"], kind="stable")
    n = rows["n"][order]
    for x in range(0, len(order), TILE):
        high = int(n[min(x + TILE, len(order)) - 1]) * 100 // percent
        stop = int(np.searchsorted(n, high, "right"))
        for y in range(x, stop, TILE):
            i, j = order[x : x + TILE], order[y : min(y + TILE, stop)]
            p, q = (v.ravel() for v in np.meshgrid(i, j, indexing="ij"))
            if y == x:
                below = (np.arange(len(i))[:, None] < np.arange(len(j))[None]).ravel()
                p, q = p[below], q[below]
            yield p, q


def _meetings(rows: dict, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Entry pairs of different labels and groups that may be alike; in a cell of two parts those of two sides."""
    run = _run_ids(rows)
    size = np.bincount(run)[run]
    short = {c: v[size <= LONG_RUN] for c, v in rows.items()}
    found = [(short, _short_meetings(short))]
    for r in np.unique(run[size > LONG_RUN]):
        long = {c: v[run == r] for c, v in rows.items()}
        found.append((long, _long_meetings(long, percent)))
    for part, pairs in found:
        for i, j in pairs:
            cells, cell = part["cells"][i], part["cell"][i]
            ok = (part["label"][i] != part["label"][j]) & (part["g"][i] != part["g"][j])
            ok &= (cell // cells == cell % cells) | (part["side"][i] != part["side"][j])
            i, j = i[ok], j[ok]
            ok = _may_link(part, i, j, percent, part["single"][i] & part["single"][j])
            if ok.any():
                yield part, i[ok], j[ok]


def _differ(x: np.ndarray, y: np.ndarray, moved: np.ndarray) -> int:
    """How many shingles two sets differ in at least, from their prefixes: up to the nearer end both are known."""
    late_x, late_y = np.isin(x, moved), np.isin(y, moved)
    last = min((bool(late_x[-1]), int(x[-1])), (bool(late_y[-1]), int(y[-1])))
    x, y = (v[(w < last[0]) | ((w == last[0]) & (v <= np.uint64(last[1])))] for v, w in ((x, late_x), (y, late_y)))
    return 2 * len(distinct(np.concatenate((x, y)))) - len(x) - len(y)


COLUMNS = ["token", "cell", "side", "cells", "pos", "n", "g", "c", "copies", "single", "label", *BITS]


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Columns of whole runs of one (token, cell), several at a time, as the sorted rows stream by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [(b["token"][0].as_py(), b["cell"][0].as_py()) for b in (held[-1:] + [batch.slice(batch.num_rows - 1)])]
        token, cell = (batch.column(c).to_numpy() for c in ("token", "cell"))
        other = np.flatnonzero((token != last[-1][0]) | (cell != last[-1][1]))
        start = int(other[-1]) + 1 if len(other) else 0  # of the run that may go on
        if start or held and last[0] != last[-1]:
            table = pa.Table.from_batches([*held, batch.slice(0, start)])
            yield {c: table[c].to_numpy() for c in COLUMNS}
            held = []
        held.append(batch.slice(start))
    if held:
        table = pa.Table.from_batches(held)
        yield {c: table[c].to_numpy() for c in COLUMNS}


def _celled(entries: DataFrame) -> DataFrame:
    """Entries beside each other by token; a token with very many is cut into parts, and every two parts meet."""
    cells = F.ceil(F.col("rows") / PART_ROWS).cast("int")
    side = F.pmod(F.xxhash64("g"), cells).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    dealt = entries.withColumn("cells", cells).withColumn("side", side).withColumn("other", other)
    cell = F.least("side", "other") * F.col("cells") + F.greatest("side", "other")
    dealt = dealt.withColumn("cell", cell).select(*COLUMNS)
    return dealt.repartition("token", "cell").sortWithinPartitions("token", "cell")


def _star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs_of(batches):
            a, b = _stars(rows, percent)
            yield pa.RecordBatch.from_arrays([pa.array(rows["g"][a]), pa.array(rows["g"][b])], ["g1", "g2"])

    return _celled(entries.where(F.col("pos") < STAR_PLACES)).mapInArrow(run, "g1 long, g2 long").where("g1 <> g2").distinct()


def _group_pairs(entries: DataFrame, percent: int) -> DataFrame:
    names = ["g1", "l1", "n1", "g2", "l2", "n2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for every in _runs_of(batches):
            for rows, i, j in _meetings(every, percent):
                swap = rows["g"][i] > rows["g"][j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(rows[k][x]) for x in (i, j) for k in ("g", "label", "n")], names)

    met = _celled(entries).mapInArrow(run, ", ".join(f"{x} long" for x in names))
    shared = met.groupBy(*names).agg(F.count(F.lit(1)).alias("shared"))

    def spare(n: str) -> Column:
        p = F.col(n) - F.floor((F.col(n) * percent + 99) / 100) + 1
        return F.when(p >= LONG_PREFIX, F.floor(p / 4)).otherwise(0)

    return shared.where(F.col("shared") > F.least(spare("n1"), spare("n2"))).select("g1", "l1", "g2", "l2")


def _near(pairs: DataFrame, groups: DataFrame, percent: int, moved: np.ndarray) -> DataFrame:
    """Those of ``pairs`` (g1, g2, ...) whose prefixes do not differ too much; adds the leaders c1 and c2."""
    theirs = groups.select(F.col("g").alias("g2"), F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("prefix").alias("y"))
    hubs = pairs.groupBy("g2").agg(F.count(F.lit(1)).alias("rows")).join(theirs, "g2")
    mine = groups.select(F.col("g").alias("g1"), F.col("c").alias("c1"), F.col("n").alias("n1"), F.col("prefix").alias("x"))
    met = join_counted(pairs, hubs, "g2", "rows").drop("rows").join(mine, "g1")
    names = [x for x in met.columns if x not in ("x", "y", "n1", "n2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n1").to_numpy(), batch.column("n2").to_numpy()
            most, keep = n + m - 2 * least_overlap(n, m, percent), []
            for x, y, d in zip(batch.column("x"), batch.column("y"), most.tolist(), strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                keep.append(_differ(x, y, moved) <= d)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """The shingles that over ``COMMON`` texts of a bounded sample share, ascending, ``MOST_MOVED`` at most.

    The sample has about ``SAMPLE`` rows, chosen by hash.  What is common decides the order of shingles, hence
    the speed; results are the same for any order.
    """
    part = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(set(text_bytes(batch.column("text"))))
            for a, b in slabs(texts, 2 << 20):
                h, n = np.unique(shingle_sets(texts[a:b], shingle)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["token", "rows"])

    sample = docs.where(F.pmod(F.xxhash64("k", F.lit(1)), F.lit(part)) == 0).select("text")
    counts = sample.mapInArrow(run, "token long, rows long").groupBy("token").agg(F.sum("rows").alias("rows"))
    top = counts.where(F.col("rows") > COMMON).orderBy(F.desc("rows"), "token").limit(MOST_MOVED).select("token")
    return distinct(top.toArrow()["token"].to_numpy().view(np.uint64))


def _sets(docs: DataFrame, needed: DataFrame, shingle: int) -> DataFrame:
    """(c, shingles) of the classes in ``needed`` (k, c, copies), from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for a, b in slabs(texts, 2 << 20):
                h, at = shingle_sets(texts[a:b], shingle)
                sets = [h[x:y].tobytes() for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(a, b - a), pa.array(sets, pa.binary())], ["c", "shingles"])

    few = small_side(needed, BROADCAST_ROWS)
    chosen = docs.select("k", "text").join(few, "k") if few is not needed else join_counted(
        docs.select("k", "text"), needed, "k", "copies"
    )
    one = chosen.groupBy("c").agg(F.any_value("text").alias("text"))
    return one.mapInArrow(run, "c long, shingles binary")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are alike; b may be the partner of very many."""
    hubs = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("rows"))
    needed = pairs.select(F.col("a").alias("c")).unionByName(hubs.select(F.col("b").alias("c"))).distinct()
    needed = needed.join(classes.select("c", "k", "copies"), "c")
    sets = cut_lineage(_sets(docs, needed, shingle))
    theirs = hubs.join(sets.withColumnRenamed("c", "b"), "b").withColumnRenamed("shingles", "y")
    met = join_counted(pairs, theirs, "b", "rows").join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(x) + len(y) - len(distinct(np.concatenate((x, y))))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _entries(groups: DataFrame) -> DataFrame:
    """A row per group and prefix shingle that another group has too, with the group's leader."""
    every = groups.select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = every.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = join_counted(every, shared, "token", "rows")
    lead = groups.select("g", "c", "copies", (F.col("members") == 1).alias("single"), *BITS)
    return met.join(lead, "g").withColumn("label", F.col("c"))


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 90, most: int = 4096
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked, directly or by others, at a Jaccard similarity.

    Two link when 100 * |intersection| >= ``percent`` * |union| of their sets of distinct shingles of
    ``shingle`` words; see ``shingle_sets`` for words.  ``component_id`` is the smallest doc_id that links reach.
    A text that is NULL or has no word has an empty set and links with nothing.  Repeated rows give a row each,
    rows that share an id but not the text are documents of their own, and a NULL id names a component only
    where all its ids are NULL.  Other columns are ignored; an empty table gives no rows.

    Shingles are 64-bit hashes, sets and prefixes are told apart by 128-bit digests.  A shingle on which over
    ``most`` components meet is moved to the end of the order too (at most ``MOST_MOVED``, as the bound rises with
    the entries); one with over ``PART_ROWS`` groups is cut into parts.
    """
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumn("k", F.xxhash64("doc_id", "text"))
    moved = _common(docs, shingle)
    prints = cut_lineage(_prints(docs, shingle, percent, moved))
    classes = cut_lineage(
        prints.where("n > 0").groupBy("sig").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("k").alias("k"),
            F.min("n").alias("n"), *[F.min(b).alias(b) for b in BITS],
        ).withColumn("c", F.monotonically_increasing_id())
    )

    def grouped(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Groups with their leaders, and the group of every class."""
        of = prints.where("n > 0").groupBy("sig").agg(F.min("gkey").alias("gkey")).join(classes, "sig")
        of = cut_lineage(of.select("c", "gkey", "copies", *BITS))
        lead = F.max_by(F.struct("c", "copies", *BITS), F.struct("copies", -F.col("c"))).alias("lead")
        heads = of.groupBy("gkey").agg(lead, F.count(F.lit(1)).alias("members"))
        shapes = prints.where("n > 0").groupBy("gkey").agg(F.min("n").alias("n"), F.any_value("prefix").alias("prefix"))
        groups = cut_lineage(
            shapes.join(heads, "gkey").select("gkey", "n", "prefix", "members", "lead.*")
            .withColumn("g", F.monotonically_increasing_id())
        )
        members = join_counted(of.select("c", "gkey", *BITS), groups.select("gkey", "g", "members"), "gkey", "members")
        return groups, cut_lineage(members.select("c", "g", *BITS))

    groups, members = grouped(prints)
    entries = cut_lineage(_entries(groups))

    # stars on every shingle, and inside every group
    inside = members.join(groups.where("members > 1").select("g", F.col("c").alias("b")), "g")
    inside = inside.where("c <> b").select(F.col("c").alias("a"), "b")
    stars = _near(cut_lineage(_star_pairs(entries, percent)), groups, percent, moved)
    stars = stars.select(F.col("c1").alias("a"), F.col("c2").alias("b")).unionByName(inside)
    links = cut_lineage(_verified(cut_lineage(stars), docs, classes, shingle, percent))

    def labelled(of: DataFrame) -> DataFrame:
        roots = components(links).select(F.col("node").alias("c"), "root")
        return cut_lineage(of.join(roots, "c", "left").withColumn("label", F.coalesce("root", "c")).drop("root"))

    labels = labelled(classes.select("c"))

    def met(entries: DataFrame, members: DataFrame) -> DataFrame:
        owners = members.select("c", "g").join(labels, "c").select("g", "label").distinct()
        return entries.drop("label").join(owners, "g")

    # shingles on which too many components meet go last
    for _ in range(ROUNDS):
        open_ = met(entries, members)
        per_token = open_.groupBy("token").agg(F.approx_count_distinct("label").alias("labels"))
        bound = max(most, entries.count() // MOST_MOVED)
        hot = per_token.where(F.col("labels") > bound).select("token").toArrow()["token"].to_numpy().view(np.uint64)
        fresh = np.setdiff1d(hot, moved)
        if not len(fresh):
            break
        moved = distinct(np.concatenate((moved, fresh)))
        groups, members = grouped(cut_lineage(_prints(docs, shingle, percent, moved)))
        entries = cut_lineage(_entries(groups))

    # all that is left: members of different components in groups that may be alike
    pairs = cut_lineage(_group_pairs(met(entries, members), percent))
    pairs = _near(pairs, groups, percent, moved).select("g1", "l1", "g2", "l2")
    known = cut_lineage(members.join(labels, "c").join(classes.select("c", "n"), "c"))

    def side(i: int) -> DataFrame:
        named = {"c": f"c{i}", "g": f"g{i}", "label": f"l{i}", "n": f"n{i}", **{b: f"{b}_{i}" for b in BITS}}
        return known.select(*[F.col(k).alias(v) for k, v in named.items()])

    across = pairs.join(side(1), ["g1", "l1"]).join(side(2), ["g2", "l2"])
    mixed = known.groupBy("g").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g")
    same = side(1).join(mixed, F.col("g1") == F.col("g"), "left_semi").join(
        side(2), (F.col("g1") == F.col("g2")) & (F.col("l1") < F.col("l2"))
    )
    columns = ["c1", "c2", "n1", "n2", *[f"{b}_{i}" for b in BITS for i in (1, 2)]]
    expanded = across.select(*columns).unionByName(same.select(*columns))
    rest = cut_lineage(
        expanded.where(_close(percent)).select(F.greatest("c1", "c2").alias("a"), F.least("c1", "c2").alias("b")).distinct()
    )
    if not rest.isEmpty():
        links = cut_lineage(links.unionByName(_verified(rest, docs, classes, shingle, percent)))
        labels = labelled(classes.select("c"))

    names = classes.join(labels, "c").select("sig", "label", "least", "copies")
    roots = names.groupBy("label").agg(F.min("least").alias("component_id"))
    by_sig = cut_lineage(names.join(roots, "label").select("sig", "component_id", "copies"))
    worded = join_counted(prints.where("n > 0").select("doc_id", "n", "sig", "k"), by_sig, "sig", "copies")
    none = prints.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return worded.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(none)


def _close(percent: int) -> Column:
    """Whether the parity bits of two sets allow them to be alike."""
    apart = sum((F.bit_count(F.col(f"{b}_1").bitwiseXOR(F.col(f"{b}_2"))) for b in BITS), F.lit(0))
    total = F.col("n1") + F.col("n2")
    least = F.floor((total * percent + (99 + percent)) / (100 + percent))
    return apart <= total - 2 * least
