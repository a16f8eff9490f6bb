"""Quality classifier: hashed word n-gram logistic regression fitted by follow-the-regularised-leader."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.llm.common import pick
from scoutframe.llm.features import in_slabs, word_ngrams


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int
    order: int


def _sparse(docs: list[bytes], bits: int, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each document and their values, count / sqrt(number of n-grams)."""
    b, d = word_ngrams(docs, bits, order)
    key, count = np.unique((d << bits) | b, return_counts=True)
    doc, bucket = key >> bits, key & ((1 << bits) - 1)
    edges = np.searchsorted(doc, np.arange(len(docs) + 1))
    total = np.maximum(np.bincount(d, minlength=len(docs)), 1)
    return [
        (bucket[i:j], (count[i:j] / np.sqrt(total[k])).astype(np.float32))
        for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    ]


def sampled(labels: DataFrame, doc_id: str, label: str, train: Column, most: int) -> DataFrame:
    """At most ``most`` labelled ids, those whose id hashes smallest; NULL ids and labels are left out.

    An id with two labels takes the larger.
    """
    rows = labels.where(train).select(labels[f"`{doc_id}`"].alias("doc_id"), labels[f"`{label}`"].alias("label"))
    rows = rows.where("doc_id is not null and label is not null")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_quality(
    docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", bits: int = 20, order: int = 2, most: int = 6000, epochs: int = 3,
    alpha: float = 0.1, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1,
) -> QualityModel:
    """Fit on at most ``most`` labelled rows where ``train`` (a condition on ``labels``) holds.

    The rows are taken by the hash of their id; executors turn their whole texts into sparse vectors, the
    updates run over these on the driver, whose size ``most`` bounds.  Without rows the model says 0.5.
    """
    chosen = F.broadcast(sampled(labels, doc_id, label, train, most))
    rows = pick(docs, doc_id=doc_id, text=text).join(chosen, "doc_id")

    def vectors(batches):
        import pandas as pd

        for t in batches:
            texts = [(x or "").encode() for x in t["text"]]
            for a, b in in_slabs(texts):
                pairs = _sparse(texts[a:b], bits, order)
                yield pd.DataFrame({
                    "doc_id": t["doc_id"].to_numpy()[a:b], "label": t["label"].to_numpy()[a:b],
                    "at": [p[0].astype(np.int32).tobytes() for p in pairs], "x": [p[1].tobytes() for p in pairs],
                })

    schema = "doc_id long, label int, at binary, x binary"
    examples = [
        (r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32).astype(np.float64))
        for r in rows.mapInPandas(vectors, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "at").toLocalIterator()
    ]
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) > l1, w, 0.0)

    for _ in range(epochs):
        for y, at, x in examples:
            i, v = np.append(at, 1 << bits), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / alpha * w
            n[i] = grown
    w = weights(np.arange((1 << bits) + 1))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]), bits, order)


def score_quality(
    docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3,
    score: str = "score", predicted: str = "predicted",
) -> DataFrame:
    """``docs`` with a score from 0 to 1 and whether it reaches the threshold.

    Only the whole text is looked at.  NULL and empty text score as the model's bias says; all rows and columns
    come along; predictions replace columns of the same name.
    """
    at = np.flatnonzero(model.weights)
    held = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), model.weights[at]))
    bias, bits, order = model.bias, model.bits, model.order

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        weights = np.zeros(1 << bits, np.float32)
        weights[held.value[0]] = held.value[1]
        docs_, out = [(x or "").encode() for x in texts], []
        for a, b in in_slabs(docs_):
            bucket, doc = word_ngrams(docs_[a:b], bits, order)
            total = np.maximum(np.bincount(doc, minlength=b - a), 1)
            dot = np.bincount(doc, weights[bucket], minlength=b - a) / np.sqrt(total)
            out.append(1 / (1 + np.exp(-np.clip(dot + bias, -35, 35))))
        return pd.Series(np.concatenate(out) if out else [])

    rest = [c for c in docs.columns if c not in (score, predicted)]
    out = docs.select(*[docs[f"`{c}`"] for c in rest], scored(docs[f"`{text}`"]).alias(score))
    return out.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
