"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoutframe.llm.common import per_process, pick

UNDETERMINED = "und"
GAP = 0x1FFFFF  # no character has this code


def _letters() -> np.ndarray:
    """Lower-case code of every letter, 0 of every other character."""
    out = np.zeros(sys.maxunicode + 1, np.uint64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def codes_of(text: str) -> np.ndarray:
    """Letters of a text in lower case, with one gap before, after and between words; empty without letters."""
    table = per_process("letters", _letters)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = table[np.minimum(points, sys.maxunicode)]
    codes = np.concatenate((np.zeros(1, np.uint64), codes, np.zeros(1, np.uint64)))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    return np.where(codes == 0, np.uint64(GAP), codes) if len(codes) > 1 else codes[:0]


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of one to three characters and their counts; a gram of fewer is padded by zero codes.

    The trigrams are counted; bigrams and letters are sums over the trigrams that begin with them.
    """
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    a = np.concatenate((codes, np.zeros(2, np.uint64)))
    three = np.sort((a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:])
    at = np.flatnonzero(np.concatenate(([True], three[1:] != three[:-1])))
    grams, counts = three[at], np.diff(np.concatenate((at, [len(three)])))
    out_g, out_c = [], []
    for shift in (0, 21, 42):
        short = (grams >> np.uint64(shift)) << np.uint64(shift)
        first = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        g, c = short[first], np.add.reduceat(counts, first)
        if shift < 42:  # a gram that the text's end cut short counts with the shorter ones only
            full = ((g >> np.uint64(shift)) & np.uint64(GAP)) != 0
            g, c = g[full], c[full]
        else:
            keep = g != np.uint64(GAP << 42)
            g, c = g[keep], c[keep]
        out_g.append(g)
        out_c.append(c)
    return np.concatenate(out_g), np.concatenate(out_c)


def top_grams(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams in order; equal counts by code."""
    if len(counts) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:size]]


def fit_profiles(
    docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", size: int = 400
) -> dict[str, list[int]]:
    """For every non-NULL language its ``size`` most frequent n-grams over all rows where ``train`` holds.

    The counts are summed by Spark; only languages times ``size`` grams reach the driver.  Each task sends a gram
    of a language once.
    """
    rows = docs.where(train).select(docs[f"`{text}`"].alias("text"), docs[f"`{lang}`"].alias("lang"))
    rows = rows.where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        pending: dict[str, list] = {}

        def merge(name):
            parts = pending.pop(name) + ([held[name]] if name in held else [])
            g, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            held[name] = (g, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64))

        for batch in batches:
            for text, name in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                pending.setdefault(name, []).append(gram_counts(codes_of(text.as_py())))
                if len(pending[name]) >= 256:
                    merge(name)
        for name in list(pending):
            merge(name)
        for name, (g, n) in held.items():
            cols = [pa.array([name] * len(g)), pa.array(g.astype(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    profiles: dict[str, list] = {}
    for r in best:
        profiles.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(profiles.items())}


def has_letter(text: Column) -> Column:
    """Whether a text has a letter, by the same table of letters as ``codes_of``; NULL has none."""

    @F.pandas_udf("boolean")
    def found(texts):
        import pandas as pd

        return pd.Series([bool(t) and len(codes_of(t)) > 0 for t in texts], dtype=bool)

    return found(text)


class Profiles:
    """Ranks of every profile gram in every language."""

    def __init__(self, profiles: dict[str, list[int]], size: int) -> None:
        self.names, self.size = list(profiles), size
        grams = [np.array(g, np.int64).astype(np.uint64) for g in profiles.values()]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for i, g in enumerate(grams):
            self.ranks[np.searchsorted(self.grams, g), i] = np.arange(len(g))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 - distance / largest possible distance; ties to the first name."""
        codes = codes_of(text) if text else np.zeros(0, np.uint64)
        if not len(codes) or not self.names:
            return UNDETERMINED, 0.0
        mine = top_grams(*gram_counts(codes), self.size)
        at = np.searchsorted(self.grams, mine)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != mine] = len(self.grams)
        ranks = self.ranks[at]
        places = np.abs(ranks - np.arange(len(mine))[:, None])
        places[ranks < 0] = self.size
        distance = places.sum(0)
        best = int(distance.argmin())
        return self.names[best], float(1 - distance[best] / (self.size * len(mine)))


def identify(
    docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = 400,
    lang_pred: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1.

    The out-of-place distance adds, over the text's ``size`` most frequent n-grams, how far each stands from its
    place in the language's profile, or ``size`` if it is not there; the nearest language wins, ties go to the
    first name.  Text that is NULL or has no letter, and any text without profiles, is "und" with score 0.  Only
    the text is looked at; all columns and rows come along; predictions replace columns of the same name.
    """
    held = Profiles(profiles, size)

    @F.pandas_udf(f"{lang_pred} string, {score} double")
    def predicted(texts):
        import pandas as pd

        return pd.DataFrame([held.predict(t) for t in texts], columns=[lang_pred, score])

    rest = [c for c in docs.columns if c not in (lang_pred, score)]
    out = docs.select(*[docs[f"`{c}`"] for c in rest], predicted(docs[f"`{text}`"]).alias("_prediction"))
    return out.select(*[f"`{c}`" for c in rest], f"_prediction.{lang_pred}", f"_prediction.{score}")
