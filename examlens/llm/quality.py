"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's features are its words and word pairs, and the pairs and triples of the words'
shapes (letters, capitals, digits and marks, runs as one), all hashed into one weight table.
A score is a sparse dot product: the mean weight of the features of the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sampled


@dataclass(frozen=True)
class QualitySpec:
    bits: int = 18  # the table has 2**bits weights
    scale: float = 30.0  # a feature's value is its share of the features, times this
    sample: int = 5000  # labelled rows to learn from, the lowest hashes of doc_id
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    folds: int = 5
    threshold: float = 0.3


SHAPE = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a" if not m[0][0].isupper() else "Aa"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1+"))


def shape(word: str) -> str:
    for pattern, to in SHAPE:
        word = pattern.sub(to, word)
    return word


class WordHashes:
    """Hashes of a word and of its shape, remembered for a bounded number of words."""

    def __init__(self, bound: int = 200_000) -> None:
        self.bound, self.seen = bound, {}

    def __call__(self, word: str) -> tuple[int, int]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= self.bound:
                self.seen.clear()
            got = self.seen[word] = (zlib.crc32(word.lower().encode()), zlib.crc32(shape(word).encode(), 1))
        return got


def features(text: str | None, bits: int, hashes: WordHashes) -> np.ndarray:
    """The hashed features of the whole text, repeats included."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    both = np.array([hashes(w) for w in words], np.uint64)
    word, form = both[:, 0], both[:, 1]
    one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    again = (word[1:] == word[:-1]).astype(np.uint64)  # a word said twice is a shape of its own
    keys = [
        word * one,
        (word[:-1] * two + word[1:]) * one + np.uint64(1),
        form * two + np.uint64(2),
        (form[:-1] * two + form[1:] + again) * three + np.uint64(3),
        ((form[:-2] * two + form[1:-1]) * three + form[2:]) * one + np.uint64(4),
    ]
    return (np.concatenate(keys) * one >> np.uint64(64 - bits)).astype(np.int64)


class QualityModel:
    def __init__(self, spec: QualitySpec) -> None:
        self.spec = spec
        self.weights = np.zeros(1 << spec.bits)
        self.shift = 0.0

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> QualityModel:
        """FTRL-Proximal over (features, shares, label); each coordinate has its own rate."""
        s, size = self.spec, 1 << self.spec.bits
        z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the shift

        def weight(i: np.ndarray) -> np.ndarray:
            l1 = np.where(i == size, 0.0, s.l1)
            return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

        turn = np.random.default_rng(1)
        for _ in range(s.epochs):
            for k in turn.permutation(len(examples)):
                i, x, y = examples[k]
                i, x = np.append(i, size), np.append(x * s.scale, 1.0)
                w = weight(i)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
                n[i] += g * g
        every = weight(np.arange(size + 1))
        self.weights, self.shift = every[:size], float(every[size])
        return self

    def score(self, text: str | None, hashes: WordHashes) -> float:
        i = features(text, self.spec.bits, hashes)
        total = self.shift + (self.spec.scale * self.weights[i].sum() / len(i) if len(i) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def learn(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec()) -> QualityModel:
    """Learns from a bounded sample of labelled rows outside the held-out fold; rows without a label or text teach nothing."""
    known = labels.select("doc_id", F.col("quality").alias("label")).where("label in (0, 1) and doc_id is not null").where(crc_mod(F.col("doc_id"), spec.folds) != 0).distinct()
    picked = sampled(known, F.col("doc_id"), known.count(), spec.sample)
    # The sample's ids are bounded by spec.sample, whatever the size of the tables.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    # An id on many rows teaches by one of its texts, so what comes to the driver is bounded by the sample.
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    bits = spec.bits

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            found = [np.unique(features(t, bits, hashes), return_counts=True) for t in b["text"]]
            shares = [(c / max(c.sum(), 1)).astype(np.float32).tobytes() for _, c in found]
            yield pd.DataFrame({"order": b["order"], "label": b["label"], "at": [i.astype(np.int32).tobytes() for i, _ in found], "share": shares})

    wanted = rows.select("text", "label", F.xxhash64("doc_id", "text").alias("order"))
    got = wanted.mapInPandas(counted, "order long, label int, at binary, share binary").toPandas().sort_values(["order", "label"], kind="stable")
    examples = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(np.float64), int(y)) for a, x, y in zip(got["at"], got["share"], got["label"], strict=True)]
    return QualityModel(spec).fit(examples)


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted of every row of `docs`.

    - a null or empty text scores by the shift alone; without labelled rows every score is 0.5;
    - a null doc_id counts as the empty text in the fold; repeated rows score alike;
    - an empty table gives an empty result; other columns are ignored.
    """
    spec = model.spec
    return docs.select("doc_id", (crc_mod(F.col("doc_id"), spec.folds) == 0).alias("held_out"), score_of(model)(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= spec.threshold).cast("int"))


def score_of(model: QualityModel):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([model.score(t, hashes) for t in texts], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of `docs` that score at the threshold or above."""
    return docs.where(score_of(model)(F.col("text")) >= model.spec.threshold).select(*docs.columns)
