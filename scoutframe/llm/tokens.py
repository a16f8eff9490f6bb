"""Token ids by the tokenizers library, inside tasks; the vocabulary files' paths are parameters."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

from scoutframe.llm.common import per_process

LONG_TEXT = 1 << 20
SLAB = 4 << 20
LONG_PIECE = 64
LETTER, DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"


def byte_letters() -> dict[int, str]:
    """What byte-level files write for each Latin-1 character: a letter for each of its UTF-8 bytes, which is the
    byte's own character where that can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    letter = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


class Remembered(dict):
    """Ids by text, made when first asked for; the first ``most`` short texts are kept."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        out = self.make(text)
        self.keep(text, out)
        return out

    def keep(self, text: str, ids: bytes) -> None:
        if len(self) < self.most and len(text) <= LONG_PIECE:
            self[text] = ids


class PieceEncoder:
    """The ids that the tokenizers library gives, found by encoding each distinct part of a text once.

    A text of Latin-1 characters is cut in parts where the vocabulary's own rule ends a word or a run of signs, and
    such a part goes straight to the library's model, in the letters that byte-level files write for bytes.  Other
    texts are first cut in pieces where white space follows another character: no token crosses such a place, and
    pieces of Latin-1 characters have parts as above.  So the ids of the parts, joined, are those of the whole text
    (tested).  Up to ``most`` short pieces and as many parts stay in memory; the others go to the library again.  Texts with an added token or a character that the library and Python class differently are
    encoded whole.  Long texts are cut in slices first, so a call's memory does not grow with the text.
    """

    SLICE_END = re.compile(r"\S(?=\s)")
    UNCOMMON = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "<|")
    BEYOND_LATIN_1 = re.compile(r"[^\x00-\xff]")
    symbols = byte_letters()

    def __init__(self, path: str, most: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.pieces, self.parts = Remembered(self._piece, most), Remembered(self._part, most)

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part.translate(self.symbols))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii() and self.BEYOND_LATIN_1.search(piece):
            return self._whole(piece)
        return b"".join(map(self.parts.__getitem__, self.split(piece)))

    def _slices(self, text: str):
        at = 0
        while at < len(text):
            end = self.SLICE_END.search(text, at + LONG_TEXT) if len(text) - at > LONG_TEXT else None
            end = end.end() if end else len(text)
            yield text[at:end]
            at = end

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(x in text for x in self.UNCOMMON):
            return self._whole(text)
        return b"".join([self._slice(x) for x in self._slices(text)])

    def _slice(self, text: str) -> bytes:
        if text.isascii() or not self.BEYOND_LATIN_1.search(text):
            # no part crosses the end of a piece, so the text as a whole splits into the parts of its pieces
            return b"".join(map(self.parts.__getitem__, self.split(text)))
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))


class ByteEncoder(PieceEncoder):
    """For a byte-level BPE file: white space belongs to the piece after it."""

    cut = staticmethod(re.compile(r"\s*\S+|\s+").findall)
    split = staticmethod(re.compile(
        rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+"
    ).findall)


def character_kinds() -> np.ndarray:
    """0 for white space, 1 for letters, 2 for digits, 3 for signs, for each Latin-1 character."""
    rules = (r"\s", f"[{LETTER}]", f"[{DIGIT}]", "")
    return np.array([next(k for k, r in enumerate(rules) if re.match(r, chr(c))) for c in range(256)], np.uint8)


class WordEncoder(PieceEncoder):
    """For a lower-casing BPE file that drops white space: a piece is a word."""

    PARTS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTER}]+|[{DIGIT}]|[^\s{LETTER}{DIGIT}]+")
    cut = staticmethod(str.split)
    kinds = character_kinds()
    lower = "".join(map(chr, range(256))).lower().encode("latin-1")
    TOGETHER = 20_000

    def __init__(self, path: str, most: int) -> None:
        super().__init__(path, most)
        from tokenizers import Tokenizer, pre_tokenizers

        self.words = Tokenizer(self.model)  # words between blanks go to the same model as they are
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary, mark = self.words.get_vocab(), self.model.end_of_word_suffix
        self.is_last = np.zeros(max(vocabulary.values()) + 1, bool)  # the tokens that end a word
        self.is_last[[i for x, i in vocabulary.items() if x.endswith(mark)]] = True

    @classmethod
    def split(cls, piece: str) -> list[str]:
        return cls.PARTS.findall(piece.lower())

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """``encode`` of each text; Latin-1 texts of ``SLAB`` characters together are split at once."""
        held, latin, size = [], [], 0  # held: ids, or None for the next of ``latin``
        for text in texts:
            plain = None
            if len(text) <= LONG_TEXT and not any(x in text for x in self.UNCOMMON):
                try:
                    plain = text.encode("latin-1")
                except UnicodeEncodeError:
                    pass
            if plain is None:
                held.append(self.encode(text))
            else:
                held.append(None)
                latin.append(plain)
            size += len(text)
            if size >= SLAB:
                yield from self._filled(held, latin)
                held, latin, size = [], [], 0
        yield from self._filled(held, latin)

    def _filled(self, held: list, latin: list[bytes]) -> Iterator[bytes]:
        found = iter(self._latin(latin))
        return (next(found) if x is None else x for x in held)

    def _slice(self, text: str) -> bytes:
        if len(text) >= LONG_TEXT and not self.BEYOND_LATIN_1.search(text):
            return self._latin([text.encode("latin-1")])[0]
        return super()._slice(text)

    def _parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; the library's model gets those not in memory ``TOGETHER`` at a time."""
        ids = list(map(self.parts.get, parts))
        new = [i for i, x in enumerate(ids) if x is None]
        for k in range(0, len(new), self.TOGETHER):
            some = new[k : k + self.TOGETHER]
            text = " ".join([parts[i] for i in some]).translate(self.symbols | {ord(" "): " "})
            found = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(4 * np.flatnonzero(self.is_last[found]) + 4).tolist()]
            if len(cuts) != len(some) + 1:  # a vocabulary without a mark at some part's end
                ids = [self.parts[x] for x in parts]
                break
            found = found.tobytes()
            for i, (a, b) in zip(some, pairwise(cuts), strict=True):
                ids[i] = found[a:b]
            for i in some[: max(0, self.parts.most - len(self.parts))]:
                self.parts.keep(parts[i], ids[i])
        return ids

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts.  The parts are those of ``PARTS``, as runs of characters of one kind; each distinct
        one is looked up once."""
        text = b"\n".join([*texts, b""]).translate(self.lower)
        buf = np.frombuffer(text, np.uint8)
        kind = self.kinds[buf]
        starts = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1
        starts = np.concatenate((np.zeros(min(1, len(buf)), np.int64), starts))
        self._contract(text, buf, kind, starts)
        sizes = np.diff(starts, append=len(buf))
        word = (kind[starts] != 0) & (sizes > 0)
        starts, sizes = starts[word], sizes[word]
        ends = np.cumsum(sizes)
        offsets, seen = pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(buf[kind != 0])
        parts = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, seen]).dictionary_encode()
        _, offsets, seen = parts.dictionary.buffers()
        at, seen = np.frombuffer(offsets, np.int64).tolist(), str(seen or b"", "latin-1")
        ids = self._parts([seen[a:b] for a, b in pairwise(at[: len(parts.dictionary) + 1])])
        ids = pa.array(ids, pa.large_binary()).take(parts.indices)
        _, offsets, ids = ids.buffers()
        offsets = np.frombuffer(offsets, np.int64)[: len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
        first = np.cumsum([0, *[len(x) + 1 for x in texts]])
        cuts = offsets[np.searchsorted(starts, first)].tolist()
        ids = ids.to_pybytes() if ids else b""
        return [ids[a:b] for a, b in pairwise(cuts)]

    @staticmethod
    def _contract(text: bytes, buf: np.ndarray, kind: np.ndarray, starts: np.ndarray) -> None:
        """Move the starts of letters after a lone apostrophe behind the letters that belong to it ('s, 're ...)."""
        if b"'" not in text:
            return
        lone = np.flatnonzero((buf[starts[:-1]] == ord("'")) & (np.diff(starts) == 1) & (kind[starts[1:]] == 1))
        for i in lone.tolist():
            a = int(starts[i + 1])
            pair = text[a : a + 2]
            starts[i + 1] += 1 if pair[:1] in b"stmd" else 2 if pair in (b"re", b"ve", b"ll") else 0


def byte_encoder(path: str, most: int = 400_000) -> ByteEncoder:
    return per_process(("byte_encoder", path, most), lambda: ByteEncoder(path, most))


def word_encoder(path: str, most: int = 400_000) -> WordEncoder:
    return per_process(("word_encoder", path, most), lambda: WordEncoder(path, most))


def byte_ids(path: str, text: str) -> np.ndarray:
    return np.frombuffer(byte_encoder(path).encode(text), "<u4")
