"""Windows of a document that also start in a document with a smaller id: the exchange behind the
substring operators.

Documents are cut into chunks by ranges of doc_id, so that an earlier chunk holds only smaller ids.
Every window of ``length`` units has a key, the smallest hash of its ``gram``-unit pieces; equal windows
have equal keys and neighbouring windows mostly share theirs, so a chunk has few distinct keys.

1. Each chunk sends its distinct keys, dealt to buckets; a bucket answers which keys other chunks hold.
2. Each chunk sends the distinct hashes of windows with such keys; a bucket answers which of them an
   earlier chunk holds.
3. Each chunk knows now which windows stand in an earlier chunk; those repeated inside the chunk are
   settled there by the operator's own structure.

A chunk sends each key and window once whatever the number of copies, so no group of copies and no common
passage makes a hot task.  A chunk and a bucket have a bounded size, their number grows with the input.
Window hashes have 64 bits; equal hashes count as equal windows between chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutframe.llm.common import (
    NO_ID, SLICE, distinct, hash_tables, mix, prefix_sums, release_memory, run_hashes, text_bytes,
    word_units,
)

BUCKET_BITS, KEY_BYTES = 24, 5
BLOBS = "chunk long, bucket long, payload binary"


@dataclass(frozen=True)
class Windows:
    """``unit`` is "byte" or "word"; a window has ``length`` units; keys come from ``gram`` units."""

    unit: str
    length: int
    gram: int
    chunk_bytes: int = 8 << 20


@dataclass
class Chunk:
    """The documents of a chunk in order of doc_id, and the windows that may be repeated."""

    table: pa.Table
    docs: list[bytes]
    ranks: np.ndarray  # of each document's id among the chunk's ids
    units: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray | None = None  # of candidate windows, ascending
    owner: np.ndarray | None = None  # their documents
    hashes: np.ndarray | None = None
    earlier: np.ndarray | None = None  # whether an earlier chunk holds the window


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    p = 1
    while p * 2 <= width:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[: len(x) - (width - p)], x[width - p :]) if p < width else x


def _scan(c: Chunk, spec: Windows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, document, prefix sums, key) of all windows, a slice at a time."""
    n = int(c.bounds[-1]) - spec.length + 1
    codes = hash_tables()[2]
    for a in range(0, n, SLICE):
        b = min(a + SLICE, n)
        part = c.units[a : b + spec.length - 1]
        sums = prefix_sums(codes[part] if spec.unit == "byte" else part)
        d0, d1 = (int(np.searchsorted(c.bounds, x, "right")) - 1 for x in (a, b - 1))
        sizes = np.minimum(c.bounds[d0 + 1 : d1 + 2], b) - np.maximum(c.bounds[d0 : d1 + 1], a)
        doc = np.repeat(np.arange(d0, d1 + 1), sizes)
        starts = np.arange(a, b)
        ok = np.flatnonzero(c.bounds[doc + 1] >= starts + spec.length)
        keys = _sliding_min(mix(run_hashes(sums, spec.gram)), spec.length - spec.gram + 1)
        yield starts[ok], doc[ok], sums, keys[ok]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for x in columns:
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _code(keys: np.ndarray, buckets: int) -> np.ndarray:
    low = np.uint64(8 * KEY_BYTES)
    bucket = ((keys >> low) * np.uint64(buckets)) >> np.uint64(BUCKET_BITS)
    return (bucket << low) | (keys & ((np.uint64(1) << low) - np.uint64(1)))


def _chunk(table: pa.Table, spec: Windows) -> Chunk:
    import zstandard

    ids, expand = table["doc_id"].to_numpy(), zstandard.ZstdDecompressor().decompress
    docs = [expand(t) for t in table["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], docs[i]))
    table, docs = table.take(pa.array(order, pa.int64())), [docs[i] for i in order]
    ranks = np.unique(ids[order], return_inverse=True)[1]
    if spec.unit == "word":
        return Chunk(table, docs, ranks, *word_units(docs))
    bounds = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=bounds[1:])
    return Chunk(table, docs, ranks, np.frombuffer(b"".join(docs), np.uint8), bounds)


@dataclass
class _Keys:
    """Runs of neighbouring windows [start, end) with one key, and the chunk's distinct keys, ascending."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    which: np.ndarray  # the key of each run, as a place in ``codes``
    codes: np.ndarray
    local: np.ndarray  # which keys two of the chunk's ids share


def _keys(c: Chunk, spec: Windows, buckets: int) -> _Keys:
    none = np.zeros(0, np.int64)
    parts = [(none, none, none, none.astype(np.uint64))]
    for start, doc, _, key in _scan(c, spec):
        at = _runs(key, doc)
        if len(at):
            last = np.concatenate((at[1:], [len(key)])) - 1
            parts.append((start[at], start[last] + 1, doc[at], _code(key[at], buckets)))
    start, end, doc, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    rank = c.ranks[doc]
    order = np.lexsort((rank, code))
    at = _runs(code[order])
    which = np.empty(len(code), np.int64)
    which[order] = np.repeat(np.arange(len(at)), np.diff(np.concatenate((at, [len(code)]))))
    last = np.concatenate((at[1:], [len(code)])) - 1 if len(at) else at
    return _Keys(start, end, doc, which, code[order[at]], rank[order[at]] != rank[order[last]])


def _blobs(chunk: int, values: np.ndarray, bucket_of: np.ndarray, pack: Callable) -> pa.Table:
    at = _runs(bucket_of)
    ends = np.concatenate((at[1:], [len(values)])) if len(at) else at
    return pa.table({
        "chunk": pa.array([chunk] * len(at), pa.int64()),
        "bucket": pa.array(bucket_of[at].astype(np.int64)),
        "payload": pa.array([pack(values[a:b]) for a, b in zip(at, ends, strict=True)], pa.binary()),
    })


def _pack_keys(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack_keys(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    """Differences of ascending values by byte planes, which the shuffle's compression shortens."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack_sorted(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _answers(table: pa.Table, unpack: Callable, flag: Callable, kind: int) -> pa.Table:
    """One bit for every value of every chunk in this bucket."""
    chunks = table["chunk"].to_numpy()
    order = np.argsort(chunks, kind="stable")
    payloads = table["payload"].to_pylist()
    parts = [unpack(payloads[i]) for i in order]
    values = np.concatenate(parts)
    by = np.argsort(values, kind="stable")
    at = _runs(values[by])
    counts = np.diff(np.concatenate((at, [len(values)])))
    bits = np.zeros(len(values), bool)
    bits[by] = flag(at, counts, len(values))
    ends = np.cumsum([len(p) for p in parts])[:-1]
    return pa.table({
        "chunk": pa.array(chunks[order], pa.int64()),
        "kind": pa.array([kind] * len(parts), pa.int32()),
        "bucket": table["bucket"].combine_chunks().take(pa.array(order)),
        "bits": pa.array([np.packbits(x).tobytes() for x in np.split(bits, ends)], pa.binary()),
    })


def _shared(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(counts > 1, counts)


def _not_first(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(n, bool)
    out[at] = False
    return out


def _bits(marks: pa.Table, kind: int, buckets_of: np.ndarray) -> np.ndarray:
    """The answers of one kind for values whose ascending buckets are ``buckets_of``."""
    out = np.zeros(len(buckets_of), bool)
    kinds, buckets, bits = marks["kind"].to_pylist(), marks["bucket"].to_pylist(), marks["bits"].to_pylist()
    for k, bucket, b in zip(kinds, buckets, bits, strict=True):
        if k == kind:
            i, j = np.searchsorted(buckets_of, [np.uint64(bucket), np.uint64(bucket + 1)])
            out[i:j] = np.unpackbits(np.frombuffer(b, np.uint8), count=j - i).astype(bool)
    return out


def _windows(c: Chunk, spec: Windows, keys: _Keys, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, document, hash, key) of the windows whose key is wanted."""
    run = np.flatnonzero(wanted[keys.which])
    sizes = keys.end[run] - keys.start[run]
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.repeat(keys.start[run], sizes) + inside
    hashes = np.empty(len(starts), np.uint64)
    _, inverse, codes = hash_tables()
    a = i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(starts, a + SLICE))
        part = c.units[a : int(starts[j - 1]) + spec.length]
        sums = prefix_sums(codes[part] if spec.unit == "byte" else part)
        at = starts[i:j] - a
        hashes[i:j] = mix((sums[at + spec.length] - sums[at]) * inverse[at])
        i = j
    return starts, np.repeat(keys.doc[run], sizes), hashes, np.repeat(keys.which[run], sizes)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(64 - BUCKET_BITS)) * np.uint64(buckets)) >> np.uint64(BUCKET_BITS)


def _with_marks(table: pa.Table, marks: pa.Table, spec: Windows, buckets: int, final: bool) -> Chunk | np.ndarray:
    c = _chunk(table, spec)
    keys = _keys(c, spec, buckets)
    shared = _bits(marks, 0, keys.codes >> np.uint64(8 * KEY_BYTES))
    if not final:
        return distinct(_windows(c, spec, keys, shared)[2])
    c.starts, c.owner, c.hashes, which = _windows(c, spec, keys, shared | keys.local)
    # only windows with a shared key were sent; for the others the answer is no
    sent = np.flatnonzero(shared[which])
    values, place = np.unique(c.hashes[sent], return_inverse=True)
    c.earlier = np.zeros(len(c.starts), bool)
    c.earlier[sent] = _bits(marks, 1, _bucket(values, buckets))[place]
    return c


def by_chunk(docs: DataFrame, spec: Windows) -> tuple[DataFrame, int]:
    """``docs`` with its text compressed and a chunk column, and the number of buckets.

    A chunk is a range of doc_id with about ``chunk_bytes`` of text; the cuts are eight bytes a chunk.
    """
    spark = docs.sparkSession
    known = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), known[1])
    chunks = max(1, least, -(-(known[0] or 0) // spec.chunk_bytes))
    cuts = np.zeros(0, np.int64)
    if chunks > 1:
        shares = [i / chunks for i in range(1, chunks)]
        cuts = np.unique(docs.agg(F.percentile_approx("doc_id", shares, 20 * chunks)).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3, write_checksum=False).compress
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            columns = [
                pa.array([squeeze(t) for t in text_bytes(batch.column(name))], pa.binary()) if name == "text"
                else batch.column(name)
                for name in batch.schema.names
            ]
            columns.append(pa.array(np.searchsorted(cuts, ids, "right"), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "chunk"])

    fields = [f if f.name != "text" else T.StructField("text", T.BinaryType()) for f in docs.schema.fields]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("chunk", T.LongType())])), chunks


def repeated(
    docs: DataFrame, spec: Windows, finish: Callable[[Chunk], pa.Table], schema: T.StructType | str
) -> DataFrame:
    """``finish`` of every chunk of ``docs`` (doc_id long, text string, others are carried along)."""
    docs = docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    chunked, buckets = by_chunk(docs, spec)

    def send_keys(table: pa.Table) -> pa.Table:
        codes = _keys(_chunk(table, spec), spec, buckets).codes
        release_memory()
        chunk = table["chunk"][0].as_py()
        return _blobs(chunk, codes, codes >> np.uint64(8 * KEY_BYTES), _pack_keys)

    def send_windows(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()),
                             "payload": pa.array([], pa.binary())})
        sent = _with_marks(table, marks, spec, buckets, False)
        release_memory()
        return _blobs(table["chunk"][0].as_py(), sent, _bucket(sent, buckets), _pack_sorted)

    def last(table: pa.Table, marks: pa.Table) -> pa.Table:
        out = finish(_with_marks(table, marks, spec, buckets, True))
        release_memory()
        return out

    marks = "chunk long, kind int, bucket long, bits binary"
    by = chunked.groupBy("chunk")
    shared = (
        by.applyInArrow(send_keys, BLOBS).groupBy("bucket")
        .applyInArrow(lambda t: _answers(t, _unpack_keys, _shared, 0), marks)
    )
    first = (
        by.cogroup(shared.groupBy("chunk")).applyInArrow(send_windows, BLOBS).groupBy("bucket")
        .applyInArrow(lambda t: _answers(t, _unpack_sorted, _not_first, 1), marks)
    )
    return by.cogroup(shared.unionByName(first).groupBy("chunk")).applyInArrow(last, schema)


def covered(c: Chunk, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which units lie in one of the runs of ``length`` units at ``starts``."""
    n = len(c.units) + 1
    return np.cumsum((np.bincount(starts, minlength=n) - np.bincount(starts + length, minlength=n))[:-1]) > 0
