"""Helpers that several of the operators share; they run inside tasks unless they take a DataFrame."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.session import ROWS_PER_SALT, cut_lineage, small_side

NO_ID = -(2**63)
BASE = 0x9E3779B97F4A7C15
SLICE = 1 << 16


def per_process(key, make: Callable):
    """``make()`` once per worker process; later tasks of that process get the same object."""
    store = sys.modules.setdefault("_scoutframe_llm_store", types.ModuleType("_scoutframe_llm_store")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def release_memory() -> None:
    """Give memory that is free again back to the system: a worker process outlives its tasks, and keeps it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def crc_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so other columns cannot clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def join_counted(many: DataFrame, one: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row per ``key`` and, in ``rows``, how many of ``many`` have that key.

    The rows of a key with over ``ROWS_PER_SALT`` are dealt out to several tasks, and the key's row of ``one`` to
    all of them; heavy keys are at most as many as ``many`` has rows, over that number.
    """
    parts = F.ceil(F.col(rows) / ROWS_PER_SALT).cast("int")
    heavy = small_side(one.where(F.col(rows) > ROWS_PER_SALT).select(key, parts.alias("_parts")))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in many.columns]), F.coalesce("_parts", F.lit(1))).cast("int")
    left = many.join(heavy, key, "left").withColumn("_salt", salt).drop("_parts")
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def with_row(df: DataFrame) -> DataFrame:
    """``df`` with ``_file`` and ``_at`` (longs), which name a row of a stored table whatever its columns hold.

    They are the hash of the file's path and the row's place in it, so each reading gives the same; a frame that
    is no plain Parquet table is stored first.
    """
    names = ["_file", "_at"]
    path, at = F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])
    try:
        out = df.select("*", path, at)
        out.schema  # noqa: B018 (raises where there is no such metadata)
    except AnalysisException:
        out = cut_lineage(df).select("*", path, at)
    return out


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def slabs(docs: list[bytes], most: int = 4 << 20):
    """Consecutive runs of documents with about ``most`` bytes, as (first, last + 1)."""
    start = size = 0
    for i, d in enumerate(docs):
        size += len(d)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(docs):
        yield start, len(docs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, ascending, by sorting."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _tables():
    powers = np.full(SLICE * 2, BASE, np.uint64)
    inverse = np.full(SLICE * 2, pow(BASE, -1, 2**64), np.uint64)
    powers[0] = inverse[0] = 1
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    return np.cumprod(powers), np.cumprod(inverse), codes


def hash_tables():
    """(powers, inverse powers, code of each byte) of the polynomial hash modulo 2**64."""
    return per_process("hash tables", _tables)


def prefix_sums(units: np.ndarray) -> np.ndarray:
    """Sums from which any run's hash follows; at most ``2 * SLICE`` units."""
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * hash_tables()[0][: len(units)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` units from every start."""
    n = len(sums) - length
    return (sums[length:] - sums[:n]) * hash_tables()[1][:n] if n > 0 else np.zeros(0, np.uint64)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def token_spans(buf: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one non-zero kind; ``kinds`` has a kind per byte value."""
    kind = kinds[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate(([0], edge)) if len(buf) else np.zeros(0, np.int64)
    ends = np.concatenate((edge, [len(buf)])) if len(buf) else starts
    keep = kind[starts] != 0 if len(buf) else starts.astype(bool)
    return starts[keep], ends[keep]


def token_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each token, in slices of bounded size; a very long token is hashed by parts."""
    powers, inverse, codes = hash_tables()
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + SLICE, "right"))
        if j <= i:
            h = np.uint64(0)
            for s in range(a, int(ends[i]), SLICE):
                part = codes[buf[s : min(s + SLICE, int(ends[i]))]]
                h = mix(np.array([h], np.uint64))[0] ^ np.sum(part * powers[: len(part)], dtype=np.uint64)
            out[i] = h
            i += 1
            continue
        sums = prefix_sums(codes[buf[a : int(ends[j - 1])]])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a line break after each, and where each one starts (one entry more at the end)."""
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=starts[1:])
    return np.frombuffer(b"\n".join(docs) + b"\n" if docs else b"", np.uint8), starts


def word_units(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every white-space word, and each document's first word (one entry more at the end)."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for a, b in slabs(docs):
        buf, at = joined(docs[a:b])
        starts, ends = token_spans(buf, (~SPACE).astype(np.uint8))
        hashes.append(token_hashes(buf, starts, ends))
        counts.append(np.diff(np.searchsorted(starts, at)))
    bounds = np.zeros(len(docs) + 1, np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=bounds[1:])
    return np.concatenate(hashes), bounds
