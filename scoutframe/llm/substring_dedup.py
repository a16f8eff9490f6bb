"""Removal of repeated word passages by matching statistics over suffix automata.

Each chunk of documents is a shard.  Its automaton holds the passages known to stand in earlier shards and,
added document by document, those of its own earlier documents.  Documents are streamed through it; where the
longest match reaches the threshold the matched words go.  An automaton of all earlier text would grow with
the corpus and could not be broadcast, so a shard gets only what its documents may match (see ``repeats``).
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutframe.llm.common import pick
from scoutframe.llm.repeats import Chunk, Windows, covered, repeated


class SuffixAutomaton:
    """All substrings of the passages added so far.

    Nearly every state has one way on, which lies in flat arrays; only states with more have a dict, so a word
    costs some 60 bytes instead of 460 with a dict for each state.
    """

    def __init__(self) -> None:
        self.word, self.to = array("Q", [0]), array("q", [-1])  # the first way on
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.size = array("q", [-1]), array("q", [0])

    def _go(self, state: int, c: int) -> int:
        to = self.to[state]
        if to >= 0 and self.word[state] == c:
            return to
        ways = self.more.get(state)
        return -1 if ways is None else ways.get(c, -1)

    def _set(self, state: int, c: int, to: int) -> None:
        if self.to[state] < 0 or self.word[state] == c:
            self.word[state], self.to[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def _state(self, word: int, to: int, link: int, size: int) -> int:
        self.word.append(word)
        self.to.append(to)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(self.word[q], self.to[q], self.link[q], self.size[p] + 1)
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self._go(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def add(self, passage: list[int]) -> None:
        last = 0
        for c in passage:
            q = self._go(last, c)
            if q >= 0:
                last = q if self.size[q] == self.size[last] + 1 else self._clone(last, q, c)
                continue
            new, p = self._state(0, -1, 0, self.size[last] + 1), last
            while p >= 0 and (q := self._go(p, c)) < 0:
                self._set(p, c, new)
                p = self.link[p]
            if p >= 0:
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, c)
            last = new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """(start, length) of the longest match that ends at a word, where it has ``least`` words or more.

        Only the longest of matches that grow word by word is listed.
        """
        out, state, length = [], 0, 0
        go, link, size = self._go, self.link, self.size
        for i, c in enumerate(words):
            to = go(state, c)
            while state and to < 0:
                state = link[state]
                length = size[state]
                to = go(state, c)
            if to >= 0:
                state = to
                length += 1
            else:
                length = 0
            if length >= least:
                if out and out[-1][0] == i - length + 1:
                    out.pop()
                out.append((i - length + 1, length))
        return out


def _passages(c: Chunk, pick_: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(document, start, end) of maximal runs of the picked candidate windows."""
    starts, owner = c.starts[pick_], c.owner[pick_]
    if not len(starts):
        return []
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(owner) != 0)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut - 1, [len(starts) - 1]))
    return list(zip(owner[first].tolist(), starts[first].tolist(), (starts[last] + length).tolist(), strict=True))


def _repeats(c: Chunk, length: int) -> np.ndarray:
    """Which words of the chunk a smaller doc_id repeats."""
    known = SuffixAutomaton()
    once = np.zeros(len(c.starts), bool)
    once[np.unique(c.hashes, return_index=True)[1]] = True
    for _, a, b in _passages(c, c.earlier & once, length):
        known.add(c.units[a:b].tolist())
    everything = _passages(c, np.ones(len(c.starts), bool), length)
    own = _passages(c, ~c.earlier & once, length)
    found, sizes, i, j = [], [], 0, 0
    while i < len(everything):
        rank, rows = c.ranks[everything[i][0]], i
        while i < len(everything) and c.ranks[everything[i][0]] == rank:
            _, a, b = everything[i]
            for start, size in known.matches(c.units[a:b].tolist(), length):
                found.append(a + start)
                sizes.append(size)
            i += 1
        while j < len(own) and c.ranks[own[j][0]] <= rank:
            known.add(c.units[own[j][1] : own[j][2]].tolist())
            j += 1
        assert i > rows
    return covered(c, np.array(found, np.int64), np.array(sizes, np.int64))


def substring_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 13,
    carry: tuple[str, ...] = (),
    untouched_as_is: bool = False,
    chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, *carry): every word goes that a run of ``length`` words covers which
    also starts in a document with a smaller id.

    Words are runs of characters other than ASCII white space; ``kept`` joins the rest by one space.  NULL and
    empty text have no words and give empty text; a NULL id counts as the smallest.  Rows with equal ids are
    kept apart and never count against each other.  With ``untouched_as_is`` a text that loses nothing keeps its
    white space.  Columns named in ``carry`` come along unchanged, others are ignored; an empty table gives an
    empty table.
    """
    spec = Windows("word", length, max(1, length // 2 + 1), chunk_bytes)
    carried = {f"carry{i}": name for i, name in enumerate(carry)}
    rows = pick(docs, doc_id=doc_id, text=text, **carried)

    def finish(c: Chunk) -> pa.Table:
        gone = _repeats(c, length)
        kept, removed = [], []
        for i, d in enumerate(c.docs):
            words, mask = d.split(), gone[c.bounds[i] : c.bounds[i + 1]]
            if mask.any():
                words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
            kept.append((d if untouched_as_is and not mask.any() else b" ".join(words)).decode())
            removed.append(int(mask.sum()))
        return pa.table({
            "doc_id": c.table["doc_id"],
            "n_words": pa.array(np.diff(c.bounds), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.string()),
            **{k: c.table[k] for k in carried},
        })

    types = dict(rows.dtypes)
    extra = "".join(f", {k} {types[k]}" for k in carried)
    out = repeated(rows, spec, finish, "doc_id long, n_words long, n_removed long, kept string" + extra)
    return out.select(
        F.nullif("doc_id", F.lit(-(2**63))).alias("doc_id"), "n_words", "n_removed", "kept",
        *[F.col(k).alias(name) for k, name in carried.items()],
    )
