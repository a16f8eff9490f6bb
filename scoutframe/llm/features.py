"""Hashed token features of a batch of texts, for the two classifiers."""

from __future__ import annotations

import numpy as np

from scoutframe.llm.common import joined, mix, slabs, token_hashes, token_spans

KINDS = np.full(256, 2, np.uint8)  # symbols
KINDS[[i for i in range(256) if i >= 128 or chr(i).isalnum()]] = 1
KINDS[[9, 10, 11, 12, 13, 32]] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STOPS = np.zeros(256, bool)
STOPS[[10, 33, 46, 63]] = True


def tokens(docs: list[bytes], lower: bool):
    """(hash, document, start in the joined text, that text) of runs of letters and digits and of runs of symbols."""
    buf, at = joined(docs)
    if lower:
        buf = LOWER[buf]
    starts, ends = token_spans(buf, KINDS)
    return token_hashes(buf, starts, ends), np.searchsorted(at, starts, "right") - 1, starts, buf


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def word_ngrams(docs: list[bytes], bits: int, order: int):
    """(bucket, document) of every run of one to ``order`` tokens inside a document; case is kept.

    A token that repeats the one before, or the one before that, also counts as a run of its own kind, whatever
    the token is.
    """
    h, doc, _, _ = tokens(docs, False)
    out_b, out_d, run = [buckets(h, bits)], [doc], h
    for n in range(2, order + 1):
        m = len(h) - n + 1
        if m <= 0:
            break
        run = mix(run[:m] * np.uint64(31) + h[n - 1 :])
        same = doc[:m] == doc[n - 1 :]
        out_b.append(buckets(run[same], bits))
        out_d.append(doc[:m][same])
    for gap in (1, 2):
        again = doc[:-gap][(h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])]
        out_b.append(np.full(len(again), gap))
        out_d.append(again)
    return np.concatenate(out_b), np.concatenate(out_d)


def sentence_words(docs: list[bytes], bits: int):
    """(bucket, sentence, document of each sentence, start of each sentence in its document's bytes).

    A sentence ends at ``. ! ?`` or a line break; only those with a word count.
    """
    h, doc, starts, buf = tokens(docs, True)
    word = KINDS[buf[starts]] == 1
    h, doc, starts = h[word], doc[word], starts[word]
    part = np.cumsum(STOPS[buf])[starts] if len(starts) else starts
    new = np.ones(len(h), bool)
    new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    first = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=first[1:])
    return buckets(h, bits), np.cumsum(new) - 1, doc[at], starts[at] - first[doc[at]]


def in_slabs(docs: list[bytes]):
    yield from slabs(docs, 2 << 20)
