"""Byte-exact removal of repeated substrings: prefix-free parsing and suffix arrays.

Inside a chunk of documents rolling-hash triggers cut the text into phrases; equal phrases are kept once (the
dictionary), the documents become sequences of phrases (the parse).  A suffix array of the dictionary gives
every window its place in the corpus order; read through the parse, windows in the same place are equal.
Chunks are merged by exchanging their distinct windows (see ``repeats``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm.common import hash_tables, mix, pick, prefix_sums, run_hashes, SLICE
from scoutframe.llm.repeats import Chunk, Windows, covered, repeated

TRIGGER_BYTES, TRIGGER_MODULUS = 8, 32


def triggers(text: np.ndarray) -> np.ndarray:
    """Where a phrase begins: the hash of the bytes there is divisible by the modulus."""
    out, codes = [], hash_tables()[2]
    for a in range(0, max(len(text) - TRIGGER_BYTES + 1, 0), SLICE):
        sums = prefix_sums(codes[text[a : a + SLICE + TRIGGER_BYTES - 1]])
        hit = mix(run_hashes(sums, TRIGGER_BYTES)) % np.uint64(TRIGGER_MODULUS) == 0
        out.append(np.flatnonzero(hit) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` bytes (zeros follow the text), by prefix doubling."""
    padded = np.concatenate((text, np.zeros(depth + 8, np.uint8)))
    span = min(8, 1 << (depth.bit_length() - 1))
    values = np.zeros(len(padded) - 8, np.uint64)
    for i in range(span):
        values = (values << np.uint64(8)) | padded[i : i + len(values)]
    rank = np.unique(values, return_inverse=True)[1].astype(np.uint64)
    while span < depth:
        step = min(span, depth - span)
        n = len(rank) - step
        rank = np.unique((rank[:n] << np.uint64(32)) | rank[step:], return_inverse=True)[1].astype(np.uint64)
        span += step
    return rank[: len(text)]


def window_classes(passages: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """For every passage the class of each ``depth``-byte window; equal windows and only those share one."""
    dictionary: dict[bytes, int] = {}
    parse = []
    for p in passages:
        cuts = triggers(p)
        cuts = np.unique(np.concatenate(([0], cuts[cuts <= len(p) - depth], [len(p) - depth + 1])))
        ids = [
            dictionary.setdefault(p[a : b + depth - 1].tobytes(), len(dictionary))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
        ]
        parse.append((ids, np.diff(cuts)))
    ranks = suffix_ranks(np.frombuffer(b"".join(dictionary), np.uint8), depth)
    at = np.zeros(len(dictionary) + 1, np.int64)
    np.cumsum([len(x) for x in dictionary], out=at[1:])
    return [
        np.concatenate([ranks[at[i] : at[i] + n] for i, n in zip(ids, sizes.tolist(), strict=True)])
        for ids, sizes in parse
    ]


def _settled(c: Chunk, length: int) -> np.ndarray:
    """Starts of the windows that a smaller doc_id also holds."""
    open_ = np.flatnonzero(~c.earlier)
    # windows whose hash no other id of the chunk has cannot be repeated
    _, first, place = np.unique(c.hashes[open_], return_index=True, return_inverse=True)
    ranks = c.ranks[c.owner[open_]]
    again = np.zeros(len(first), bool)
    again[place[ranks > ranks[first][place]]] = True
    open_ = open_[again[place]]
    starts, owner = c.starts[open_], c.owner[open_]
    if not len(starts):
        return c.starts[c.earlier]
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(owner) != 0)) + 1
    firsts, lasts = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
    passages = [c.units[a : b + length] for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]
    classes = np.concatenate(window_classes(passages, length))
    ranks = c.ranks[owner]
    least = np.full(int(classes.max()) + 1, len(c.ranks), np.int64)
    np.minimum.at(least, classes.astype(np.int64), ranks)
    later = starts[ranks > least[classes.astype(np.int64)]]
    return np.concatenate((c.starts[c.earlier], later))


def suffix_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, chunk_bytes: int = 8 << 20
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, spans): every byte goes that a ``length``-byte string covers which
    also starts in a document with a smaller id.

    ``kept`` is binary, ``spans`` the removed byte ranges [start, end).  NULL text is empty; empty and short
    texts stay as they are; a NULL id counts as the smallest.  Rows with equal ids are kept apart and never
    count against each other, so a repeated row is as whole as the first.  Other columns are ignored; an empty
    table gives an empty table.
    """
    spec = Windows("byte", length, length // 2 + 1, chunk_bytes)

    def finish(c: Chunk) -> pa.Table:
        gone = covered(c, _settled(c, length), length)
        kept, spans = [], []
        for i, d in enumerate(c.docs):
            mask = gone[c.bounds[i] : c.bounds[i + 1]]
            if mask.any():
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8))).reshape(-1, 2)
                kept.append(np.frombuffer(d, np.uint8)[~mask].tobytes())
                spans.append([{"start": a, "end": b} for a, b in edges.tolist()])
            else:
                kept.append(d)
                spans.append([])
        sizes = np.diff(c.bounds)
        return pa.table({
            "doc_id": c.table["doc_id"],
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_removed": pa.array(sizes - [len(k) for k in kept], pa.int64()),
            "kept": pa.array(kept, pa.binary()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    schema = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"
    out = repeated(pick(docs, doc_id=doc_id, text=text), spec, finish, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))
