"""Exact nearest players by cosine similarity of their pillar scores.

Cosine order on unit vectors is Euclidean order, so the five nearest are found
by a spatial join instead of comparing everybody with everybody:

1. Equal directions collapse into one entry that keeps its k + 1 first keys;
   further copies can never be among anybody's k nearest.
2. A kd-tree grown from a bounded sample cuts each position into leaves.
3. Every direction searches its own leaf. The similarity of its (k+1)-th find
   is a radius; it then visits just the other leaves that radius touches.
4. The finds are merged to the k nearest.

Rows are ranked by similarity rounded to nine places, then by key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NEIGHBOURS, PILLARS, POSITIONS
from ..session import c, cut_lineage, ships_with_tasks, small_side

ships_with_tasks(__name__)

LEAF_ROWS = 1024
MAX_LEAVES = 8192
SAMPLE_PER_LEAF = 32
VISITS_PER_TASK = 50_000
BLOCK_CELLS = 4_000_000
_SLACK = 1e-8  # covers the rounding of similarities in the radius


@dataclass
class Tree:
    """A kd-tree: inner nodes split, leaves are numbered, every node has a box."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def locate(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = self.leaf[node] < 0
            if not inner.any():
                return self.leaf[node]
            here = node[inner]
            go_right = x[inner, self.dim[here]] > self.cut[here]
            node[inner] = np.where(go_right, self.right[here], self.left[here])

    def reach(self, x: np.ndarray, radius2: np.ndarray):
        """(row, leaf) for every leaf whose box lies within the row's radius."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, idx = todo.pop()
            p = x[idx]
            gap = np.maximum(self.low[node] - p, 0) + np.maximum(p - self.high[node], 0)
            idx = idx[(gap * gap).sum(axis=1) <= radius2[idx]]
            if not len(idx):
                continue
            if self.leaf[node] >= 0:
                rows.append(idx)
                leaves.append(np.full(len(idx), self.leaf[node]))
            else:
                todo += [(self.left[node], idx), (self.right[node], idx)]
        if not rows:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def grow_tree(sample: np.ndarray, dims: int, leaves: int) -> Tree:
    """Split the fullest node at the median of its widest axis until ``leaves`` exist."""
    nodes = [dict(rows=sample, low=np.full(dims, -np.inf), high=np.full(dims, np.inf))]
    queue, done = [(-len(sample), 0)], []
    while queue and len(queue) + len(done) < leaves:
        _, best = heapq.heappop(queue)
        node = nodes[best]
        pts = node.pop("rows")
        axis = int(np.argmax(np.ptp(pts, axis=0))) if len(pts) > 1 else 0
        vals = np.unique(pts[:, axis])
        if len(vals) < 2:
            done.append(best)
            continue
        cut = min(float(np.median(pts[:, axis])), float(vals[-2]))
        beyond = pts[:, axis] > cut
        low, high = node["low"].copy(), node["high"].copy()
        low[axis], high[axis] = cut, cut
        node.update(dim=axis, cut=cut, left=len(nodes), right=len(nodes) + 1)
        for rows, lo, hi in ((pts[~beyond], node["low"], high), (pts[beyond], low, node["high"])):
            heapq.heappush(queue, (-len(rows), len(nodes)))
            nodes.append(dict(rows=rows, low=lo, high=hi))
    open_leaves = done + [n for _, n in queue]
    number = {n: i for i, n in enumerate(open_leaves)}
    return Tree(
        dim=np.array([n.get("dim", 0) for n in nodes]),
        cut=np.array([n.get("cut", 0.0) for n in nodes]),
        left=np.array([n.get("left", 0) for n in nodes]),
        right=np.array([n.get("right", 0) for n in nodes]),
        leaf=np.array([number.get(i, -1) for i in range(len(nodes))]),
        low=np.array([n["low"] for n in nodes]),
        high=np.array([n["high"] for n in nodes]),
    )


def nearest(queries: np.ndarray, points: np.ndarray, k: int):
    """(row, column, similarity) of the k best points per query, in rank order.

    ``points`` must be sorted by key; equal similarities keep that order.
    """
    out_r, out_c, out_s = [], [], []
    k = min(k, len(points))
    step = max(1, BLOCK_CELLS // max(1, len(points)))
    for at in range(0, len(queries), step):
        sims = np.round(queries[at : at + step] @ points.T, 9)
        floor = np.partition(sims, len(points) - k, axis=1)[:, len(points) - k]
        r, col = np.nonzero(sims >= floor[:, None])
        s = sims[r, col]
        order = np.lexsort((col, -s, r))
        r, col, s = r[order], col[order], s[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        keep = nth < k
        out_r.append(r[keep] + at)
        out_c.append(col[keep])
        out_s.append(s[keep])
    return np.concatenate(out_r), np.concatenate(out_c), np.concatenate(out_s)


def _matrix(pdf: pd.DataFrame, axes: list[str]) -> np.ndarray:
    return pdf[axes].to_numpy(dtype=float)


def nearest_keys(
    df: DataFrame, key: str, scores, pos="Pos", k: int = NEIGHBOURS, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """(pos, key, rank, neighbour, similarity): the k most similar rows of the position.

    ``key`` must be unique. Missing scores count as 0; a zero vector has
    similarity 0 to everything.
    """
    scores = list(scores)
    want = k + 1  # a row may find itself
    axes = [f"u{i}" for i in range(len(scores))]
    filled = [F.coalesce(c(s).cast("double"), F.lit(0.0)) for s in scores]
    norm2 = filled[0] * filled[0]
    for f in filled[1:]:
        norm2 = norm2 + f * f
    rows = df.where(c(pos).isNotNull()).select(
        c(pos).alias("pos"), c(key).alias("key"), F.sqrt(norm2).alias("len"),
        *[f.alias(a) for f, a in zip(filled, axes)],
    )
    rows = rows.select(
        "pos", "key",
        *[F.coalesce(F.col(a) / F.nullif("len", F.lit(0.0)), F.lit(0.0)).alias(a) for a in axes],
    )

    # 1. distinct directions with their first keys
    copies = Window.partitionBy("pos", *axes).orderBy("key")
    dirs = cut_lineage(
        rows.withColumn("nth", F.row_number().over(copies))
        .where(F.col("nth") <= want)
        .groupBy("pos", *axes)
        .agg(F.array_sort(F.collect_list("key")).alias("members"))
        .withColumn("dir", F.col("members")[0])
    )
    is_zero = F.lit(True)
    for a in axes:
        is_zero = is_zero & (F.col(a) == 0)
    points = dirs.where(~is_zero)

    # 2. one tree per position from a bounded sample
    sizes = {r["pos"]: r["n"] for r in points.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect()}
    leaves = {p: min(MAX_LEAVES, max(1, -(-n // leaf_rows))) for p, n in sizes.items()}
    picks = {p: min(1.0, SAMPLE_PER_LEAF * leaves[p] / n) for p, n in sizes.items() if leaves[p] > 1}
    sample = points.sampleBy("pos", picks, seed=7).select("pos", *axes).toPandas() if picks else None
    trees = {}
    for p in sizes:
        part = _matrix(sample[sample["pos"] == p], axes) if p in picks else np.empty((0, len(axes)))
        trees[p] = grow_tree(part, len(axes), leaves[p])
    shared = df.sparkSession.sparkContext.broadcast({p: vars(t) for p, t in trees.items()})

    axis_type = ", ".join(f"{a} double" for a in axes)

    def locate(batches):
        for pdf in batches:
            pdf["leaf"] = 0
            for p, part in pdf.groupby("pos"):
                pdf.loc[part.index, "leaf"] = Tree(**shared.value[p]).locate(_matrix(part, axes))
            yield pdf

    placed = points.select("pos", "dir", *axes).mapInPandas(
        locate, f"pos string, dir string, {axis_type}, leaf long"
    )

    # 3a. the home leaf
    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dir").reset_index(drop=True)
        x = _matrix(pdf, axes)
        r, col, s = nearest(x, x, want)
        keys = pdf["dir"].to_numpy()[col]
        first = np.searchsorted(r, np.arange(len(pdf) + 1))
        pdf["found"] = [list(keys[a:b]) for a, b in zip(first, first[1:])]
        pdf["sims"] = [s[a:b] for a, b in zip(first, first[1:])]
        return pdf

    at_home = cut_lineage(
        placed.groupBy("pos", "leaf").applyInPandas(
            home,
            f"pos string, dir string, {axis_type}, leaf long, found array<string>, sims array<double>",
        )
    )

    # 3b. the other leaves within reach
    def visit(batches):
        for pdf in batches:
            out = []
            for p, part in pdf.groupby("pos"):
                x = _matrix(part, axes)
                worst = np.array([v[-1] if len(v) >= want else -1.0 for v in part["sims"]])
                r, leaf = Tree(**shared.value[p]).reach(x, np.maximum(2 - 2 * worst, 0) + _SLACK)
                away = leaf != part["leaf"].to_numpy()[r]
                got = part.iloc[r[away]][["pos", "dir", *axes]].copy()
                got["leaf"] = leaf[away]
                out.append(got)
            if out:
                yield pd.concat(out)

    def search(visitors: pd.DataFrame, residents: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty or residents.empty:
            return pd.DataFrame({"pos": [], "dir": [], "near": [], "sim": []})
        residents = residents.sort_values("dir")
        r, col, s = nearest(_matrix(visitors, axes), _matrix(residents, axes), want)
        return pd.DataFrame(
            {
                "pos": visitors["pos"].to_numpy()[r],
                "dir": visitors["dir"].to_numpy()[r],
                "near": residents["dir"].to_numpy()[col],
                "sim": s,
            }
        )

    finds = at_home.select(
        "pos", "dir", F.explode(F.arrays_zip("found", "sims")).alias("f")
    ).select("pos", "dir", F.col("f.found").alias("near"), F.col("f.sims").alias("sim"))
    if any(n > 1 for n in leaves.values()):
        visits = cut_lineage(at_home.mapInPandas(visit, f"pos string, dir string, {axis_type}, leaf long"))
        parts = small_side(
            visits.groupBy("pos", "leaf").agg(
                F.ceil(F.count(F.lit(1)) / VISITS_PER_TASK).cast("int").alias("parts")
            ),
            max_rows=MAX_LEAVES * len(sizes),
        )
        visits = visits.join(parts, ["pos", "leaf"]).withColumn(
            "part", F.pmod(F.xxhash64("dir"), F.col("parts")).cast("int")
        ).drop("parts")
        residents = (
            at_home.select("pos", "dir", *axes, "leaf")
            .join(parts, ["pos", "leaf"])
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .drop("parts")
        )
        by = ["pos", "leaf", "part"]
        finds = finds.unionByName(
            visits.groupBy(*by)
            .cogroup(residents.groupBy(*by))
            .applyInPandas(search, "pos string, dir string, near string, sim double")
        )

    # 4. the best directions, then the best keys
    best = Window.partitionBy("pos", "dir").orderBy(F.desc("sim"), "near")
    top = finds.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= want).drop("nth")
    members = dirs.select("pos", F.col("dir").alias("near"), "members")
    hits = top.join(members, ["pos", "near"]).select(
        "pos", "dir", F.explode("members").alias("neighbour"), "sim"
    )
    # zero vectors: similarity 0 to all, so their k + 1 first keys serve every direction
    zero = small_side(dirs.where(is_zero).select("pos", F.col("members").alias("zeros")))
    hits = hits.unionByName(
        points.select("pos", "dir").join(zero, "pos").select(
            "pos", "dir", F.explode("zeros").alias("neighbour"), F.lit(0.0).alias("sim")
        )
    )
    # and for a zero vector everyone ties, so the position's first keys are nearest
    first = Window.partitionBy("pos").orderBy("key")
    opening = (
        rows.select("pos", "key")
        .withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= want)
        .select("pos", F.col("key").alias("neighbour"))
    )
    hits = hits.unionByName(
        dirs.where(is_zero).select("pos", "dir").join(opening, "pos").withColumn("sim", F.lit(0.0))
    )
    ranked = Window.partitionBy("pos", "dir").orderBy(F.desc("sim"), "neighbour")
    lists = (
        hits.withColumn("nth", F.row_number().over(ranked))
        .where(F.col("nth") <= want)
        .groupBy("pos", "dir")
        .agg(F.array_sort(F.collect_list(F.struct("nth", "neighbour", "sim"))).alias("l"))
    )

    # back to the rows: all copies of a direction share its list
    shared_list = dirs.join(lists, ["pos", "dir"], "left").select("pos", *axes, "l")
    own = F.slice(F.filter("l", lambda e: e["neighbour"] != F.col("key")), 1, k)
    return (
        rows.join(shared_list, ["pos", *axes])
        .select("pos", "key", F.posexplode(own).alias("at", "e"))
        .select(
            F.col("pos").alias(pos),
            F.col("key").alias(key),
            (F.col("at") + 1).alias("rank"),
            F.col("e.neighbour").alias("neighbour"),
            F.col("e.sim").alias("similarity"),
        )
    )


SIMILAR_TYPE = "array<struct<player:string,club:string,league:string,uv_score_age_weighted:double>>"


def similar_players(
    df: DataFrame, keys=("League", "Player"), pos="Pos", scores=None, k: int = NEIGHBOURS, **options
) -> DataFrame:
    """Add ``similar`` (array of structs) and ``similar_players`` (the same as JSON)."""
    scores = scores or [f"score_{p}" for p in PILLARS]
    keyed = cut_lineage(df.withColumn("_key", F.concat_ws("\u0001", *[c(x) for x in keys])))
    pairs = nearest_keys(keyed.where(c(pos).isin(*POSITIONS)), "_key", scores, pos, k, **options)
    peer = keyed.select(
        F.col("_key").alias("neighbour"),
        F.struct(
            F.col("Player").alias("player"),
            F.col("Squad").alias("club"),
            F.col("League").alias("league"),
            F.coalesce("uv_score_age_weighted", F.lit(0.0)).alias("uv_score_age_weighted"),
        ).alias("peer"),
    )
    lists = (
        pairs.join(peer, "neighbour")
        .groupBy("_key")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "peer"))).alias("_l"))
        .select("_key", F.transform("_l", lambda e: e["peer"]).alias("similar"))
    )
    out = keyed.join(lists, "_key", "left").drop("_key")
    out = out.withColumn("similar", F.coalesce("similar", F.array().cast(SIMILAR_TYPE)))
    return out.withColumn("similar_players", F.to_json("similar"))


def parse_similar(df: DataFrame, text="similar_players") -> DataFrame:
    """JSON text back to the array; malformed or missing text gives an empty one."""
    parsed = F.from_json(c(text), SIMILAR_TYPE)
    return df.withColumn("similar", F.coalesce(parsed, F.array().cast(SIMILAR_TYPE)))


def enrich_similar(df: DataFrame, keys=("League", "Player"), text="similar_players", order=("League", "Player")) -> DataFrame:
    """One row per neighbour with age and value looked up by (player, club)."""
    from ..functions.parse import parse_age

    card = F.struct(
        parse_age(c("Age")).cast("int").alias("age"),
        (c("market_value_eur") / 1_000_000).alias("market_value_m"),
    )
    cards = df.groupBy(c("Player").alias("player"), c("Squad").alias("club")).agg(
        F.min_by(card, F.struct(*[c(o) for o in order])).alias("card")
    )
    each = parse_similar(df, text).select(
        *[c(x).alias(f"of_{x}") for x in keys], F.posexplode("similar").alias("at", "s")
    )
    return (
        each.select(*[f"of_{x}" for x in keys], (F.col("at") + 1).alias("rank"), "s.*")
        .join(cards, ["player", "club"], "left")
        .select(
            *[f"of_{x}" for x in keys], "rank", "player", "club", "league",
            "uv_score_age_weighted", "card.age", "card.market_value_m",
        )
    )
