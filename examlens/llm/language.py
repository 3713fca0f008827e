"""Language identification in two steps.

A text's hashed byte n-grams are first scored against language families; inside the chosen
family, linear support vector machines separate each two languages, and the language that
wins most of them is predicted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, stage

# Families of common languages by ISO 639-1 code. Any other value is a family of its own.
FAMILIES = {
    "germanic": "da de en is nb nl nn no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk tr uz",
    "finnic": "et fi",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and a few signs and fractions that are none
# Bytes that aren't letters count as one space.
PLAIN = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class LanguageSpec:
    dims: int = 4096
    sample: int = 8000  # labelled rows to learn from, shared evenly by the languages
    per_language: int = 1000
    rounds: int = 300
    folds: int = 4
    held_out: int = 2


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in map(lambda m: m[0], WORDLIKE.finditer(text)))


def grams(text: str, dims: int) -> np.ndarray:
    """Unit vector of the square roots of the counts of hashed byte 1- to 3-grams of the whole text."""
    b = PLAIN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[(b != 32) | (np.roll(b, 1) != 32)].astype(np.uint32)
    keys = [b, b[:-1] * np.uint32(257) + b[1:] + np.uint32(1 << 16), (b[:-2] * np.uint32(257) + b[1:-1]) * np.uint32(257) + b[2:] + np.uint32(1 << 25)]
    count = np.zeros(dims)
    for k in keys:
        count += np.bincount((k * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1), minlength=dims)[:dims]
    x = np.sqrt(count)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, rounds: int, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighed alike, by accelerated full gradients; y is -1 or 1."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b, vw, vb, rate = np.zeros(x.shape[1]), 0.0, 0.0, 0.0, 0.25
    for _ in range(rounds):
        slack = np.maximum(0.0, 1 - y * (x @ (w + 0.9 * vw) + b + 0.9 * vb))
        g = -2 * share * y * slack
        vw = 0.9 * vw - rate * (x.T @ g + ridge * w)
        vb = 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    return w, float(b)


class LanguageModel:
    """One machine for each two families and for each two languages of a family."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, spec: LanguageSpec) -> None:
        self.dims = spec.dims
        self.langs = sorted(set(lang.tolist()))
        family = np.array([FAMILY_OF.get(v, v) for v in lang])
        self.families = {f: [v for v in self.langs if FAMILY_OF.get(v, v) == f] for f in sorted(set(family.tolist()))}
        duels = [(family, a, b) for a, b in combinations(self.families, 2)]
        duels += [(lang, a, b) for group in self.families.values() for a, b in combinations(group, 2)]
        self.duels, weights, shifts = [], [], []
        for of, a, b in duels:
            of_two = (of == a) | (of == b)
            w, shift = svm(x[of_two].astype(np.float64), np.where(of[of_two] == a, 1.0, -1.0), spec.rounds)
            self.duels.append((a, b))
            weights.append(w)
            shifts.append(shift)
        self.weights = np.array(weights, np.float32).reshape(-1, spec.dims).T.copy()
        self.shifts = np.array(shifts)

    def best(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name that wins most of its duels, by the sum of margins in a tie, and its smallest margin."""
        of = {n: [m if n == a else -m for (a, b), m in margin.items() if n in (a, b) and a in names and b in names] for n in names}
        winner = max(names, key=lambda n: (sum(m > 0 for m in of[n]), sum(of[n])))
        return winner, min(of[winner], default=np.inf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0
        margins = grams(text, self.dims) @ self.weights + self.shifts
        margin = dict(zip(self.duels, margins.tolist(), strict=True))
        family, first = self.best(list(self.families), margin)
        lang, second = self.best(self.families[family], margin)
        return lang, float(1 / (1 + np.exp(-4 * np.clip(min(first, second), -50, 50))))


def learn(docs: DataFrame, spec: LanguageSpec = LanguageSpec()) -> LanguageModel:
    """Learns from a bounded sample of labelled rows outside the held-out fold: lowest hashes of id and text, per language."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(crc_mod(F.col("doc_id"), spec.folds) != spec.held_out)
    counts = stage(known.groupBy("lang").agg(F.count("*").alias("n")), "langs")  # a row for each language
    bound = min(spec.per_language, spec.sample // max(counts.count(), 1))
    # One scan: a row is picked if its hash is among the lowest `bound` of n, about; equal rows are one.
    order = F.xxhash64("doc_id", "text")
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.join(counts, "lang").where(share * F.col("n") < bound).select("lang", "text", order.alias("order")).dropDuplicates(["lang", "order"])
    dims = spec.dims

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[has_letter(t) for t in b["text"]]]
            yield pd.DataFrame({"lang": b["lang"], "order": b["order"], "x": [grams(t, dims).astype(np.float16).tobytes() for t in b["text"]]})

    rows = picked.mapInPandas(vectors, "lang string, order long, x binary").toPandas()
    rows = rows.sort_values(["lang", "order"], kind="stable")
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), np.float16).reshape(-1, dims).astype(np.float32)
    return LanguageModel(x, rows["lang"].to_numpy(dtype=object), spec)


def identify(docs: DataFrame, model: LanguageModel, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of `docs`.

    - a null text and one without a letter are `und` with score 0, as is every text if nothing could be learned;
    - with one language to choose from its score is 1; a null doc_id counts as the empty text in the fold;
    - repeated rows are predicted alike; an empty table gives an empty result; other columns are ignored.
    """

    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    p = F.pandas_udf(predict, "lang_pred string, score double")(F.col("text"))
    return docs.select("doc_id", (crc_mod(F.col("doc_id"), spec.folds) == spec.held_out).alias("held_out"), p.alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
