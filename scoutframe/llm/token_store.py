"""Token ids in grammar-compressed files: Re-Pair per shard, with random access to every document."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutframe.llm.common import distinct, pick, release_memory
from scoutframe.llm.tokens import word_encoder

MAGIC = b"RPR1"
HEADER = "<4sIQQQQ"  # magic, first nonterminal, documents, rules, symbols, tokens


def _counted(keys: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, their places, index of its pair at each key, -1 for the rest) of the keys that occur ``least`` times.

    The key of ones alone is no pair and counts nothing.  Keys have ``bits`` bits.  Where a key and its index fit in one integer those are sorted, which takes a sixth of
    the time of an argsort.
    """
    index_bits = len(keys).bit_length()
    if bits + index_bits <= 64:
        order = keys << np.uint64(index_bits)
        order |= np.arange(len(keys), dtype=np.uint64)
        order.sort()
        ordered = order >> np.uint64(index_bits)
    else:
        order = np.argsort(keys)
        ordered = keys[order]
    head = np.flatnonzero(ordered[1:] != ordered[:-1])
    head = np.concatenate((np.zeros(min(1, len(keys)), np.int64), head + 1))
    counts = np.diff(head, append=len(ordered))
    often = (counts >= least) & (ordered[head] != np.uint64((1 << bits) - 1))
    order = order[np.repeat(often, counts)]
    if bits + index_bits <= 64:
        order = (order & np.uint64((1 << index_bits) - 1)).view(np.int64)
    pair_of = np.full(len(keys), -1, np.int32)
    pair_of[order] = np.repeat(np.arange(often.sum(), dtype=np.int32), counts[often])
    return ordered[head[often]], counts[often], pair_of


def compress(seq: np.ndarray, ends: np.ndarray, rounds: int | None, most: int | None, least: int):
    """(symbols, rules, first nonterminal): each round replaces frequent pairs by new nonterminals.

    A round takes the pairs with ``least`` places or more.  Where two overlap the more frequent one is replaced; a
    pair that keeps fewer than ``least`` places so is left for the next round.  The most frequent pair keeps all of
    its places, so rounds go on until no pair has ``least`` of them.  ``rounds``, and ``most`` as the number of
    pairs a round, end it earlier if given.  Of overlapping places of one pair every other one counts, from the
    left; no pair spans two documents.

    Symbols are linked to their neighbours, and a round looks only at ``open``: the places beside the replacements
    of the round before, and those of pairs that were frequent then.  All other pairs have lost places, if anything,
    since they were found rare, so counts need not be taken again.
    """
    n = len(seq)
    first = int(seq.max()) + 1 if n else 0
    rules: list[np.ndarray] = []
    size = done = 0
    seq = seq.astype(np.uint32)
    none = n  # no neighbour: the document begins or ends there
    after = np.arange(1, n + 2, dtype=np.int32)
    after[:-1][ends] = none
    before = np.arange(-1, n, dtype=np.int32)
    before[:1] = none
    before[1:-1][ends[:-1]] = none
    live = np.ones(n, bool)
    held = np.full(n + 1, np.iinfo(np.int32).max, np.int32)
    open_ = np.flatnonzero(after[:-1] != none)
    while len(open_) and (rounds is None or done < rounds):
        right = after[open_]
        bits = int(first + size).bit_length()
        keys = seq[open_].astype(np.uint64)
        keys <<= np.uint64(bits)
        keys |= seq[right]
        repeat = np.flatnonzero((keys[1:] == keys[:-1]) & (right[:-1] == open_[1:])) + 1
        odd = open_[:0]
        if len(repeat):
            run = np.concatenate(([True], np.diff(repeat) != 1))
            index = np.arange(len(repeat))
            skip = repeat[(index - index[run][np.cumsum(run) - 1]) % 2 == 0]
            odd, keys[skip] = open_[skip], (1 << 2 * bits) - 1  # no symbol has ones alone in its bits
        pairs, counts, pair_of = _counted(keys, 2 * bits, least)
        if not len(pairs):
            break
        best = np.lexsort((pairs, -counts))[:most]
        rank_of = np.full(len(pairs), -1, np.int32)
        rank_of[best] = np.arange(len(best))
        frequent = pair_of >= 0
        at, rank = open_[frequent], rank_of[pair_of[frequent]]
        rest, chosen = at, rank >= 0
        at, rank, pairs = at[chosen], rank[chosen], pairs[best]
        held[at] = rank
        take = (rank < held[before[at]]) & (rank < held[after[at]])
        held[at] = np.iinfo(np.int32).max
        paid = np.bincount(rank[take], minlength=len(pairs)) >= least
        take &= paid[rank]
        number = np.cumsum(paid) - 1
        at, i, pairs = at[take], number[rank[take]], pairs[paid]
        rules.append(np.stack((pairs >> np.uint64(bits), pairs & np.uint64((1 << bits) - 1)), 1).astype(np.uint32))
        gone = after[at]
        seq[at] = (first + size + i).astype(np.uint32)
        live[gone] = False
        following = after[gone]
        after[at] = following
        before[following] = at
        before[none] = none
        size, done = size + len(pairs), done + 1
        left = before[at]
        todo = np.zeros(n, bool) if len(at) > n >> 6 else None
        parts = (rest, odd, at, left[left != none])
        if todo is None:
            open_ = distinct(np.concatenate(parts))
        else:
            for part in parts:
                todo[part] = True
            open_ = np.flatnonzero(todo)
        open_ = open_[live[open_] & (after[open_] != none)]
    return seq[live], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), first


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Tokens under each rule; a rule only names symbols before it."""
    lengths = np.ones(len(rules), np.int64)
    for _ in range(len(rules) + 1):
        sides = [np.where(s >= first, lengths[np.maximum(s.astype(np.int64) - first, 0)], 1) for s in rules.T]
        new = sides[0] + sides[1] if len(rules) else lengths
        if np.array_equal(new, lengths):
            return lengths
        lengths = new
    raise ValueError("a rule names itself")


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Symbols with every nonterminal replaced level by level; for short stretches."""
    while True:
        inner = seq >= first
        if not inner.any():
            return seq
        out = np.repeat(seq, 1 + inner)
        at = (np.cumsum(1 + inner) - 1 - inner)[inner]
        rule = rules[seq[inner].astype(np.int64) - first]
        out[at], out[at + 1] = rule[:, 0], rule[:, 1]
        seq = out


def expand_all(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The same for a whole block: each rule is expanded once and copied to its places."""
    inner = np.flatnonzero(seq >= first)
    rule = seq[inner].astype(np.int64) - first
    step = np.ones(len(seq), np.int64)
    step[inner] = lengths[rule]
    used = np.zeros(len(rules), bool)
    used[rule] = True
    used = np.flatnonzero(used)
    pool = expand((used + first).astype(np.uint32), rules, first)
    start = np.zeros(len(rules), np.int64)
    start[used] = np.cumsum(lengths[used]) - lengths[used]
    source = np.arange(len(seq))  # where a symbol's tokens begin: itself, or behind all symbols in the pool
    source[inner] = len(seq) + start[rule]
    ends = np.cumsum(step)
    at = np.repeat(source - ends + step, step)
    at += np.arange(len(at))
    return np.concatenate((seq, pool))[at]


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def write_block(docs: list, ids: list[bytes], rounds: int | None, most: int | None, least: int) -> bytes:
    """The file image: header, document ids and sizes, rules, their expansion lengths, symbols."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    tokens = np.frombuffer(b"".join(ids), np.uint32)
    ends = np.zeros(len(tokens), bool)
    ends[np.cumsum(sizes) - 1] = True
    seq, rules, first = compress(tokens, ends, rounds, most, least)
    lengths = expansion_lengths(rules, first)
    head = struct.pack(HEADER, MAGIC, first, len(docs), len(rules), len(seq), len(tokens))
    has = np.array([d is not None for d in docs], np.uint8)
    names = np.array([d or 0 for d in docs], np.int64)
    return b"".join((
        head, has.tobytes(), names.tobytes(), sizes.tobytes(), rules.astype(np.uint32).tobytes(),
        lengths.tobytes(), _planes(seq),
    ))


class Block:
    """Reads a file image; ``tokens`` decodes any range without the rest."""

    def __init__(self, image: bytes) -> None:
        magic, self.first, n, rules, symbols, self.n_tokens = struct.unpack_from(HEADER, image)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize(HEADER)

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(image, kind, count, at)
            at += out.nbytes
            return out

        has, names, self.sizes = take(np.uint8, n), take(np.int64, n), take(np.int64, n)
        self.docs = [d if h else None for d, h in zip(names.tolist(), has.tolist(), strict=True)]
        self.rules, self.lengths = take(np.uint32, 2 * rules).reshape(-1, 2), take(np.int64, rules)
        self.seq = _from_planes(image[at:])
        if len(self.seq) != symbols:
            raise ValueError("a token block is cut short")
        inner = self.seq >= self.first
        step = np.ones(len(self.seq), np.int64)
        step[inner] = self.lengths[self.seq[inner].astype(np.int64) - self.first]
        self.at = np.concatenate(([0], np.cumsum(step)))

    def tokens(self, start: int, count: int) -> np.ndarray:
        i = int(np.searchsorted(self.at, start, "right")) - 1
        j = int(np.searchsorted(self.at, start + count, "left"))
        return expand(self.seq[i:j], self.rules, self.first)[start - self.at[i] :][:count]

    def documents(self) -> Iterator[tuple]:
        """(doc_id, start in the block, ids)."""
        everything, start = expand_all(self.seq, self.rules, self.lengths, self.first), 0
        for d, n in zip(self.docs, self.sizes.tolist(), strict=True):
            yield d, start, everything[start : start + n]
            start += n


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    block_tokens: int = 1 << 21,
    rounds: int | None = None,
    pairs_per_round: int | None = None,
    least: int = 8,
) -> None:
    """Write every document's ids and ``end_id`` in ascending order of doc_id, as blocks in a Parquet folder.

    Documents are dealt to shards by ranges of doc_id and sorted there (NULL first, equal ids by text).  A block
    of a shard closes with the document that brings it to ``block_tokens``; each has its own grammar, in which no pair is
    left with ``least`` places unless ``rounds`` or ``pairs_per_round`` end it earlier.  NULL or
    empty text is ``end_id`` alone; other columns are ignored; an empty table gives an empty folder.
    """
    end = np.array([end_id], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = word_encoder(tokenizer), TaskContext.get().partitionId()
        names, ids, held, before, block = [], [], 0, 0, 0

        def image():
            nonlocal names, ids, held, before, block
            row = [shard, block, before, len(names), held, write_block(names, ids, rounds, pairs_per_round, least)]
            before, block, names, ids, held = before + held, block + 1, [], [], 0
            kinds = [pa.int64()] * 5 + [pa.binary()]
            columns = ["shard", "block", "first_token", "n_docs", "n_tokens", "image"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], columns)

        for batch in batches:
            texts = (value.as_py() or "" for value in batch.column("text"))
            for key, x in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(texts), strict=True):
                names.append(key)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= block_tokens:
                    yield image()
        if names:
            yield image()
        release_memory()

    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    shards = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard long, block long, first_token long, n_docs long, n_tokens long, image binary"
    shards.mapInArrow(run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a folder that ``write_tokens`` made."""
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    starts, before = [], 0
    for r in totals:  # one row for each shard
        starts.append((r["shard"], before))
        before += r["n"]
    schema = "doc_id long, start long, n_tokens long, ids binary"
    offsets = spark.createDataFrame(starts, "shard long, shard_start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column("first").to_pylist(), batch.column("image"), strict=True):
                rows = [(d, first + s, len(x), x.tobytes()) for d, s, x in Block(image.as_py()).documents()]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"]
                )

    rows = blocks.join(F.broadcast(offsets), "shard")
    return rows.select((F.col("shard_start") + F.col("first_token")).alias("first"), "image").mapInArrow(run, schema)
