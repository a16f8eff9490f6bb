"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, fitted from document labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutframe.llm.common import distinct, pick
from scoutframe.llm.features import in_slabs, sentence_words
from scoutframe.llm.quality import sampled


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray
    bias: float
    bits: int


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def noisy_or(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over each document's sentences; 0 without sentences."""
    return 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
    label: str = "toxic", bits: int = 18, most: int = 12_000, epochs: int = 250, rate: float = 1.0,
    l1: float = 4e-5, start: float = -6.0, least_docs: int = 4, toxic_weight: float = 8.0,
) -> ToxicModel:
    """Fit on at most ``most`` labelled rows where ``train`` (a condition on ``labels``) holds.

    A sentence's score is the logistic of the summed weights of its words; noisy-or makes the document's score,
    and the gradient of the document's log loss is passed down to the sentences.  Executors turn the whole
    texts into word buckets; the updates (adaptive gradient steps, then shrinking by ``l1``) run on the driver
    over these, whose number ``most`` bounds.  Words of fewer than ``least_docs`` of these rows get no weight.
    A toxic row counts ``toxic_weight`` times, as they are few and a missed one costs more than a clean one too
    many.  Without rows every score is close to 0.
    """
    chosen = F.broadcast(sampled(labels, doc_id, label, train, most))
    rows = pick(docs, doc_id=doc_id, text=text).join(chosen, "doc_id")

    def bags(batches):
        import pandas as pd

        for t in batches:
            texts = [(x or "").encode() for x in t["text"]]
            for a, b in in_slabs(texts):
                bucket, sentence, doc, _ = sentence_words(texts[a:b], bits)
                keys = distinct((sentence << bits) | bucket)
                s, w = keys >> bits, (keys & ((1 << bits) - 1)).astype(np.int32)
                edges = np.searchsorted(doc[s] if len(s) else s, np.arange(b - a + 1))
                yield pd.DataFrame({
                    "doc_id": t["doc_id"].to_numpy()[a:b], "label": t["label"].to_numpy()[a:b],
                    "sentence": [s[i:j].astype(np.int32).tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)],
                    "word": [w[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)],
                })

    schema = "doc_id long, label int, sentence binary, word binary"
    sentences, words, owner, y, made = [], [], [], [], 0
    for r in rows.mapInPandas(bags, schema).orderBy(F.xxhash64("doc_id"), "doc_id", "word").toLocalIterator():
        s = np.unique(np.frombuffer(r["sentence"], np.int32), return_inverse=True)[1]
        sentences.append(s + made)
        words.append(np.frombuffer(r["word"], np.int32))
        count = int(s.max()) + 1 if len(s) else 0
        owner.append(np.full(count, len(y)))
        made += count
        y.append(r["label"])
    weights, bias = np.zeros(1 << bits), start
    if made:
        sentence, word = np.concatenate(sentences).astype(np.int32), np.concatenate(words)
        owner, y = np.concatenate(owner), np.array(y, np.float64)
        seen_in = distinct((owner[sentence] << bits) | word) & ((1 << bits) - 1)
        common = (np.bincount(seen_in, minlength=1 << bits) >= least_docs)[word]
        sentence = sentence[common]
        used, word = np.unique(word[common], return_inverse=True)
        w, seen, seen_bias = np.zeros(len(used)), np.full(len(used), 1e-6), 1e-6
        for _ in range(epochs):
            p = _sigmoid(np.bincount(sentence, w[word], minlength=made) + bias)
            whole = np.clip(noisy_or(p, owner, len(y)), 1e-9, 1 - 1e-9)
            # d loss / d logit of a sentence: p for a clean document, -p (1 - whole) / whole for a toxic one
            pull = np.where(y == 1, -toxic_weight * (1 - whole) / whole, 1.0)[owner] * p / len(y)
            g = np.bincount(word, pull[sentence], minlength=len(used))
            seen += g * g
            w -= rate * g / np.sqrt(seen)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / np.sqrt(seen), 0)
            total = pull.sum()
            seen_bias += total * total
            bias -= rate * 0.3 * total / np.sqrt(seen_bias)
        weights[used] = w
    return ToxicModel(weights.astype(np.float32), float(bias), bits)


def score_toxicity(
    docs: DataFrame, model: ToxicModel, text: str = "text", threshold: float = 0.7, sentence_threshold: float = 0.5,
    score: str = "score", predicted: str = "predicted", sentences: str = "toxic_sentences",
) -> DataFrame:
    """``docs`` with a score from 0 to 1, whether it reaches the threshold, and the offending sentences.

    ``sentences`` lists (start, score) of the sentences that score ``sentence_threshold`` or more; start counts
    UTF-8 bytes.  Only the whole text is looked at.  NULL text and text without words score 0; all rows and
    columns come along; predictions replace columns of the same name.
    """
    at = np.flatnonzero(model.weights)
    held = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), model.weights[at]))
    bias, bits = model.bias, model.bits

    @F.pandas_udf(f"{score} double, {sentences} array<struct<start:long,score:double>>")
    def scored(texts):
        import pandas as pd

        weights = np.zeros(1 << bits)
        weights[held.value[0]] = held.value[1]
        docs_, out, listed = [(x or "").encode() for x in texts], [], []
        for a, b in in_slabs(docs_):
            bucket, sentence, doc, start = sentence_words(docs_[a:b], bits)
            # a word counts once in a sentence
            keys = distinct((sentence << bits) | bucket)
            total = np.bincount(keys >> bits, weights[keys & ((1 << bits) - 1)], minlength=len(doc))
            p = _sigmoid(total + bias)
            out.append(noisy_or(p, doc, b - a))
            found = [[] for _ in range(b - a)]
            for i in np.flatnonzero(p >= sentence_threshold).tolist():
                found[doc[i]].append({"start": int(start[i]), "score": float(p[i])})
            listed += found
        return pd.DataFrame({score: np.concatenate(out) if out else [], sentences: listed})

    rest = [c for c in docs.columns if c not in (score, predicted, sentences)]
    out = docs.select(*[docs[f"`{c}`"] for c in rest], scored(docs[f"`{text}`"]).alias("_prediction"))
    out = out.select(*[f"`{c}`" for c in rest], f"_prediction.{score}", f"_prediction.{sentences}")
    return out.withColumn(predicted, (F.col(score) >= threshold).cast("int"))
