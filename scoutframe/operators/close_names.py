"""The closest names between two blocks of names, compared as arrays.

``closest`` finds for each left text the right texts with the largest of edit
ratio and weighted token-sort ratio (see ``fuzzy.py``), if it reaches the left
text's own bound. It is exact; what cannot be near enough is left out in steps
that each cost less than the one after it:

1. Letters. An edit takes away one letter at most and brings one at most, so of
   the letters of either text (counted with repetition) no more may be missing
   in the other than edits are allowed. Counts are kept as bits: one says that a
   text has a letter at least so often.
2. Right texts lie in order of such bits, in leaves. What all texts of a leaf
   have, and what none has, decides about the leaf first.
3. Pairs of letters. An edit destroys two of them at most.
4. The edit distance, bit-parallel (Myers 1999, Hyyro 2003) for many pairs at once.

Texts are at most ``MOST_LETTERS`` long, one machine word.
"""

from __future__ import annotations

import numpy as np

from ..session import ships_with_tasks

ships_with_tasks(__name__)

MOST_LETTERS = 64
LEAF_ROWS = 32
FAN = 16  # nodes below a node
SPLIT_ROWS = 128  # rows that choose the bit by which a part is halved
FEATURES = 128  # bits about letters
CLASSES = 96  # letters of larger alphabets share counts
CELLS = 1 << 18  # numbers in a temporary array
TABLE_CELLS = 1 << 21  # letter masks of the left texts held at once
_EPS = 1e-9
_TIE = 1e-5  # scores are rounded to six places later, so what lies that near the best is kept
_ONE = np.uint64(1)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of the letters from 1 on, one row per text with zeros after its end; lengths; number of codes."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.zeros(int(points.max(initial=0)) + 1, np.int32)
    known[points] = 1
    known = np.cumsum(known, dtype=np.int32)
    table = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.int32)
    table[np.arange(table.shape[1]) < lengths[:, None]] = known[points]
    return table, lengths, int(known[-1]) + 1


def _packed(bits: np.ndarray) -> np.ndarray:
    """Boolean columns as words of 64 bits."""
    wide = np.zeros((len(bits), max(1, -(-bits.shape[1] // 64)) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _counts(codes: np.ndarray, n_codes: int) -> np.ndarray:
    """How often each code from 1 on stands in each row."""
    at = codes + (np.arange(len(codes)) * n_codes)[:, None]
    return np.bincount(at.ravel(), minlength=len(codes) * n_codes).reshape(len(codes), n_codes)[:, 1:].astype(np.uint8)


def _letter_bits(left: np.ndarray, right: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the left and right rows, and the number of a left row's letters that no right row has.

    Of all bits those stay that tell right rows apart best; leaving some out only lets more pairs pass.
    """
    if n_codes > CLASSES:
        left, right = [np.where(x > 0, 1 + x % (CLASSES - 1), 0) for x in (left, right)]
        n_codes = CLASSES
    mine, theirs = _counts(left, n_codes), _counts(right, n_codes)
    most = theirs.max(axis=0)
    never = np.maximum(mine.astype(np.int64) - most, 0).sum(axis=1)
    theirs_by_code = np.ascontiguousarray(theirs.T)
    share = [
        (abs(2 * np.count_nonzero(theirs_by_code[x] >= v) - len(theirs)), x, v)
        for x in range(n_codes - 1) for v in range(1, int(most[x]) + 1)
    ]
    kept = sorted(share)[:FEATURES]  # the first word holds those that tell most
    which, least = np.array([x[1] for x in kept], int), np.array([x[2] for x in kept], int)
    return mine[:, which] >= least, theirs[:, which] >= least, never


def _leaf_order(bits: np.ndarray) -> np.ndarray:
    """Rows so that neighbours share bits: every part is halved by its most even bit until it is a leaf's size."""
    order, parts = np.arange(len(bits)), [(0, len(bits))] if bits.shape[1] else []
    while parts:
        low, high = parts.pop()
        if high - low <= LEAF_ROWS:
            continue
        rows = order[low:high]
        some = bits[rows[:: -(-len(rows) // SPLIT_ROWS)]]
        seen = some.sum(axis=0, dtype=np.int32)
        bit = int(np.abs(2 * seen - len(some)).argmin())
        if seen[bit] in (0, len(some)):
            continue
        on = bits[rows, bit]
        order[low:high] = np.concatenate([rows[on], rows[~on]])
        middle = low + int(on.sum())
        parts += [(low, middle), (middle, high)]
    return order


def _letter_pairs(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One word per row with a bit for the hash of each pair of neighbouring letters."""
    out = np.zeros(len(codes), np.uint64)
    for x in range(codes.shape[1] - 1):
        a, b = codes[:, x].astype(np.uint64), codes[:, x + 1].astype(np.uint64)
        bit = (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(58)
        out |= np.where(x + 1 < lengths, _ONE << bit, np.uint64(0))
    return out


def _masks(codes: np.ndarray, n_codes: int) -> np.ndarray:
    """For each row and code the places where the row has it, as bits."""
    out = np.zeros((len(codes), n_codes), np.uint64)
    rows = np.arange(len(codes))
    for x in range(codes.shape[1]):
        out[rows, codes[:, x]] |= _ONE << np.uint64(x)
    out[:, 0] = 0  # past the end
    return out


def distances(masks: np.ndarray, i: np.ndarray, m: np.ndarray, letter: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Edit distances of left rows ``i``, ``m`` long, and right rows ``j``, ``n`` long; ``letter[x]`` holds letter x of each."""
    out = np.empty(len(i), np.int64)
    order = np.argsort(-n, kind="stable")
    step, flat, n_codes = CELLS >> 4, masks.ravel(), masks.shape[1]
    for at in range(0, len(order), step):
        rows = order[at : at + step]
        base, right, size, last = i[rows] * n_codes, j[rows], n[rows], (m[rows] - 1).astype(np.uint64)
        pv, mv, score = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), np.uint64), m[rows].copy()
        going = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts with more than x letters come first
        for x, k in enumerate(going):
            p, v = pv[:k], mv[:k]
            eq = flat[base[:k] + letter[x][right[:k]]]
            xv = eq | v
            xh = (((eq & p) + p) ^ p) | eq
            ph = v | ~(xh | p)
            mh = p & xh
            score[:k] += ((ph >> last[:k]) & _ONE).astype(np.int64)
            score[:k] -= ((mh >> last[:k]) & _ONE).astype(np.int64)
            ph = (ph << _ONE) | _ONE
            pv[:k] = (mh << _ONE) | ~(xv | ph)
            mv[:k] = ph & xv
        out[rows] = score
    return out


class _Nodes:
    """Nodes with the bits that all and that some texts below have and the lengths of these; ``fan`` of them share a parent."""

    def __init__(self, every: np.ndarray, some: np.ndarray, shortest: np.ndarray, longest: np.ndarray, fan: int):
        full = -len(every) % fan  # filled up with nodes that nothing reaches
        words = range(every.shape[1])
        self.fan, self.real = fan, np.pad(np.ones(len(every), bool), (0, full)).reshape(-1, fan)
        self.every = [np.pad(every[:, x], (0, full)).reshape(-1, fan) for x in words]
        self.some = [np.pad(some[:, x], (0, full)).reshape(-1, fan) for x in words]
        self.shortest = np.pad(shortest, (0, full), constant_values=127).reshape(-1, fan)
        self.longest = np.pad(longest, (0, full), constant_values=-1).reshape(-1, fan)

    def above(self, fan: int) -> _Nodes:
        every = [np.bitwise_and.reduce(np.where(self.real, x, ~np.uint64(0)), axis=1) for x in self.every]
        some = [np.bitwise_or.reduce(x, axis=1) for x in self.some]
        return _Nodes(np.stack(every, 1), np.stack(some, 1), self.shortest.min(axis=1), self.longest.max(axis=1), fan)

    def near(self, node: np.ndarray, words: np.ndarray, lack: np.ndarray, extra: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple:
        """Pairs (place in the other arrays, node below ``node``) that may be near enough."""
        lacking, more = 0, 0
        for x, (every, some) in enumerate(zip(self.every, self.some, strict=True)):
            mine = words[:, x, None]
            lacking = lacking + np.bitwise_count(~some[node] & mine)
            more = more + np.bitwise_count(every[node] & ~mine)
        ok = (lacking <= lack[:, None]) & (more <= extra[:, None])
        ok &= (self.longest[node] >= least[:, None]) & (self.shortest[node] <= most[:, None])
        at = np.flatnonzero(ok)
        place = at // self.fan
        return place, node[place] * self.fan + at % self.fan


class _Rows:
    """The texts themselves: bits and lengths."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        full = -len(words) % LEAF_ROWS
        self.words = np.pad(words, ((0, full), (0, 0)))
        self.first = np.ascontiguousarray(self.words[:, 0]).reshape(-1, LEAF_ROWS)
        self.has = np.bitwise_count(self.first)
        self.has.ravel()[len(words) :] = 255  # nothing reaches these
        self.lengths, self.fan = lengths, LEAF_ROWS

    def near(self, leaf: np.ndarray, words: np.ndarray, lack: np.ndarray, extra: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple:
        """Pairs (place in the other arrays, row of ``leaf``) that may be near enough."""
        # what both have tells what either lacks; the first word holds the bits that tell most
        common = np.bitwise_count(self.first[leaf] & words[:, 0, None])
        has = np.bitwise_count(words[:, 0])
        ok = common >= (has - np.minimum(has, lack))[:, None]
        common += extra[:, None]
        ok &= common >= self.has[leaf]
        at = np.flatnonzero(ok)
        place = at // LEAF_ROWS
        row = leaf[place] * LEAF_ROWS + at % LEAF_ROWS
        size = self.lengths[row]
        ok = (size >= least[place]) & (size <= most[place])
        if words.shape[1] > 1:
            mine, theirs = words[place], self.words[row]
            ok &= np.bitwise_count(mine & ~theirs).sum(axis=1) <= lack[place]
            ok &= np.bitwise_count(theirs & ~mine).sum(axis=1) <= extra[place]
        return place[ok], row[ok]


def closest(
    left: tuple[list[str], list[str]], bound: np.ndarray, right: tuple[list[str], list[str]], weight: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places of left and right texts that are a left text's best (to ``_TIE``) and reach its ``bound``, up to 100.

    Each side is its texts and their token-sorted forms, whose ratio counts ``weight`` times.
    """
    n, none = len(left[0]), np.empty(0, np.int64)
    if not n or not right[0]:
        return none, none
    (plain, lengths, n_codes), (by_token, _, _) = letters(left[0] + right[0]), letters(left[1] + right[1])
    mine, theirs = [plain[:n], by_token[:n]], [plain[n:], by_token[n:]]
    m, sizes = lengths[:n], lengths[n:]

    bits_l, bits_r, never = _letter_bits(mine[0], theirs[0], n_codes)
    order = _leaf_order(bits_r)
    sizes, words_l, words_r = sizes[order], _packed(bits_l), _packed(bits_r[order])
    pairs_l, pairs_r = [_letter_pairs(x, m) for x in mine], [_letter_pairs(x[order], sizes) for x in theirs]
    theirs = [np.ascontiguousarray(x[order].T) for x in theirs]
    short = sizes.astype(np.int8)
    levels = [_Rows(words_r, short), _Nodes(words_r, words_r, short, short, LEAF_ROWS).above(FAN)]
    while len(levels[-1].real) > FAN:
        levels.append(levels[-1].above(FAN))

    t = (bound - _TIE) / 100  # a bound may be a rounded score
    least, most = np.ceil(m * t - _EPS), np.floor(m / t + _EPS)  # lengths a partner may have
    edits = np.floor((1 - t) * most + _EPS).astype(np.int64)
    need, best, found = (t, t / weight), bound - _TIE, []
    rows = np.flatnonzero((never <= edits) & (m > 0))
    narrow = [np.clip(x, 0, 127).astype(kind) for x, kind in ((edits - never, np.uint8), (edits, np.uint8), (least, np.int8), (most, np.int8))]
    slab = max(1, TABLE_CELLS // n_codes)

    def compared(masks: list[np.ndarray], own: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        longer, score = np.maximum(m[i], sizes[j]), np.zeros(len(i))
        for form, w in ((0, 1.0), (1, weight)):
            wanted = np.maximum(need[form][i], np.maximum(best[i], score) / (100 * w))  # or it is no better find
            allowed = np.floor((1 - wanted) * longer + _EPS + _TIE)
            p, q = pairs_l[form][i], pairs_r[form][j]
            go = np.flatnonzero(
                (allowed >= 0) & (np.bitwise_count(p & ~q) <= 2 * allowed) & (np.bitwise_count(q & ~p) <= 2 * allowed)
            )
            if len(go):
                d = distances(masks[form], own[go], m[i[go]], theirs[form], j[go], sizes[j[go]])
                score[go] = np.maximum(score[go], (1 - d / longer[go]) * 100 * w)
        keep = score >= best[i]
        i, j, score = i[keep], j[keep], score[keep]
        np.maximum.at(best, i, score - _TIE)
        found.append((i, order[j], score))

    for lo in range(0, len(rows), slab):
        held = rows[lo : lo + slab]
        masks = [_masks(x[held], n_codes) for x in mine]
        top = len(levels[-1].real)
        own = np.repeat(np.arange(len(held)), top)
        ways = [(len(levels) - 1, own, np.tile(np.arange(top), len(held)))]
        while ways:
            depth, own, node = ways.pop()
            level, step = levels[depth], CELLS // levels[depth].fan
            if len(own) > step:
                ways.append((depth, own[step:], node[step:]))
                own, node = own[:step], node[:step]
            i = held[own]
            place, below = level.near(node, words_l[i], *(x[i] for x in narrow))
            if not len(place):
                continue
            if depth:
                ways.append((depth - 1, own[place], below))
            else:
                compared(masks, own[place], i[place], below)
    if not found:
        return none, none
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = score >= best[i]
    return i[keep], j[keep]
