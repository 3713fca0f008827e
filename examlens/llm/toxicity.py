"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits and signs that stand for letters), and an
Aho-Corasick automaton finds the lexicon's entries and the exception phrases in one pass; a
hit inside an exception phrase does not count. The sum of the hits' weights and its share of
the text's words make the score.

The lexicon is learned from labelled texts: words and word beginnings that toxic texts have
far more often than clean ones, weighted by their log odds. So are the exception phrases: an
entry's word with a neighbour next to which it stands in clean texts far more often than in toxic ones.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sampled, stage

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
# Signs stand for letters as a run between two letters, or alone before two letters with no sign or letter in front.
RUN, MORE = r"[013457@$]++(?=[^\W\d_])", r"(?=[^\W\d_](?:[^\W\d_]|[013457@$]++[^\W\d_]))"
SIGN = re.compile(rf"(?<=[^\W\d_]){RUN}|(?<!\w)[013457]{MORE}|(?<![013457@$])(?<![^\W\d_])[@$]{MORE}")
LETTERS = str.maketrans(SIGNS)


class _Fold(dict):
    """Each character's folded form, found once: a small letter, or a blank for anything but letters."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        base = "".join(x for x in unicodedata.normalize("NFKD", HOMOGLYPHS.get(c, c)) if not unicodedata.combining(x))
        base = "".join(HOMOGLYPHS.get(x, x) for x in base)
        if unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf":
            out = ""  # accents on their own and invisible characters
        else:
            out = base if base.isalpha() else " "
        if len(self) < 1 << 16:
            self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words with a blank before and after each; one pass over the text."""
    plain = SIGN.sub(lambda m: m[0].translate(LETTERS), text or "")
    return f" {' '.join(plain.translate(_FOLD).split())} "


@dataclass(frozen=True)
class ToxicitySpec:
    sample: int = 6000  # labelled rows of each label to learn from, the lowest hashes of doc_id
    beginnings: tuple[int, ...] = (4, 5, 6, 8)  # lengths of word beginnings that may become entries
    least_texts: int = 3  # toxic texts that an entry needs
    evidence: float = 18.0  # log-likelihood ratio that it needs
    odds: float = 1.5  # log odds that it needs
    least_clean: int = 3  # clean texts that an exception phrase needs
    exceptions: tuple[str, ...] = ()  # phrases that count as exceptions besides the learned ones
    folds: int = 5
    threshold: float = 0.5


@dataclass
class ToxicityModel:
    spec: ToxicitySpec
    lexicon: dict[str, float]  # folded entries, each with its leading blank; one that ends in a blank is a whole word
    shift: float = -3.0
    slopes: tuple[float, float] = (1.0, 0.0)
    learned: tuple[str, ...] = ()  # exception phrases found in clean texts
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for entry, weight in self.lexicon.items():
                a.add_word(entry, (len(entry), weight))
            for phrase in (*self.spec.exceptions, *self.learned):
                a.add_word(f"{fold(phrase)}", (len(fold(phrase)), -1.0))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def measures(self, text: str | None) -> tuple[float, float]:
        """Weight of all hits outside exceptions, damped; and weight for each word of the text."""
        folded = fold(text)
        if not len(self.automaton):
            return 0.0, 0.0
        hits: dict[int, float] = {}  # by the word's start, the heaviest entry
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight < 0:
                spared.append((start, end))
            else:
                hits[start] = max(weight, hits.get(start, 0.0))
        for a, z in spared:
            for start in range(a, z):
                hits.pop(start, None)
        total = sum(hits.values())
        return math.log1p(total), total / max(folded.count(" ") - 1, 1)

    def score(self, text: str | None) -> float:
        a, b = self.measures(text)
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.shift + self.slopes[0] * a + self.slopes[1] * b))))


def terms(text: str | None, beginnings: tuple[int, ...]) -> set[str]:
    """The words of a folded text and their beginnings, as entries."""
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in beginnings if len(w) >= n}


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, spec: ToxicitySpec) -> dict[str, float]:
    """Entries and weights from (entry, toxic texts, clean texts); an entry that a shorter one covers as surely is left out."""

    def ratio(k: float, n: int) -> float:
        return k * math.log(k / n) if k else 0.0

    kept: dict[str, float] = {}
    for entry, bad, good in sorted(counts, key=lambda r: (len(r[0]), r[0])):
        p = (bad + good) / max(toxic + clean, 1)
        odds = math.log((bad + 0.5) / (toxic + 1)) - math.log((good + 0.5) / (clean + 1))
        mixed = ratio(bad, toxic) + ratio(toxic - bad, toxic) + ratio(good, clean) + ratio(clean - good, clean)
        llr = 2 * (mixed - (bad + good) * math.log(p) - ((toxic + clean - bad - good) * math.log1p(-p) if p < 1 else 0))
        covered = any(entry.startswith(k) and kept[k] >= 0.7 * odds for k in (entry[:n] for n in range(2, len(entry))) if k in kept)
        if bad >= spec.least_texts and odds >= spec.odds and llr >= spec.evidence and not covered:
            kept[entry] = odds
    return kept


def phrases(text: str | None, lexicon: dict[str, float], beginnings: tuple[int, ...]) -> set[str]:
    """Every word of a folded text that an entry hits, with the word before and the word behind it."""
    words = fold(text).split()
    hit = [f" {w} " in lexicon or any(f" {w[:n]}" in lexicon for n in beginnings) for w in words]
    return {f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a small logistic regression, by Newton steps; the first column is the shift."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        if np.abs(g).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec()) -> ToxicityModel:
    """Learns lexicon and score from a bounded sample of labelled rows outside the held-out fold.

    Equal texts count once. Without both labels the lexicon is empty.
    """
    known = labels.select("doc_id", F.col("toxic").alias("label")).where("label in (0, 1) and doc_id is not null").where(crc_mod(F.col("doc_id"), spec.folds) != 0).distinct()
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    if len(counts) < 2:
        return ToxicityModel(spec, {})
    picked = sampled(known.where("label = 0"), F.col("doc_id"), counts[0], spec.sample).union(sampled(known.where("label = 1"), F.col("doc_id"), counts[1], spec.sample))
    # The sample's ids are bounded by spec.sample for each label, whatever the size of the tables.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    # An id on many rows teaches by one of its texts.
    one = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = stage(one.select("text", "label").distinct(), "toxic")
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    lengths = spec.beginnings

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(t, y) for text, y in zip(b["text"], b["label"], strict=True) for t in terms(text, lengths)]
            yield pd.DataFrame(found, columns=["term", "label"])

    seen = sample.mapInPandas(listed, "term string, label int").groupBy("term").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    worth = seen.where((F.col("bad") >= spec.least_texts) & (F.col("bad") * n.get(0, 0) > F.col("good") * n.get(1, 0) * math.exp(spec.odds) / 2)).collect()  # entries, bounded by the sample
    model = ToxicityModel(spec, choose([(r.term, r.bad, r.good) for r in worth], n.get(1, 0), n.get(0, 0), spec))

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(t, y) for text, y in zip(b["text"], b["label"], strict=True) for t in phrases(text, model.lexicon, lengths)]
            yield pd.DataFrame(found, columns=["phrase", "label"])

    pairs = sample.mapInPandas(beside, "phrase string, label int").groupBy("phrase").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    # As clean as an entry has to be toxic; phrases, bounded by the sample.
    odds = F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1)) - F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1))
    clean = pairs.where((F.col("good") >= spec.least_clean) & (odds >= spec.odds)).select("phrase").collect()
    model.learned = tuple(sorted(r.phrase for r in clean))
    model._automaton = None

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = [model.measures(t) for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "a": [x for x, _ in m], "b": [x for _, x in m]})

    got = sample.mapInPandas(measured, "label int, a double, b double").toPandas().sort_values(["label", "a", "b"])
    if got["label"].nunique() == 2:
        w = logistic(np.column_stack([np.ones(len(got)), got["a"], got["b"]]), got["label"].to_numpy(float))
        # The sample is balanced otherwise than the labelled rows: the shift moves by the log of the rates.
        rate = math.log(counts[1] / counts[0]) - math.log(n[1] / n[0])
        model.shift, model.slopes = float(w[0] + rate), (float(max(w[1], 0.0)), float(max(w[2], 0.0)))
    return model


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more toxic) and predicted of every row of `docs`.

    - a null or empty text has no hit and the lowest score; nothing learned gives every text the same low score;
    - a null doc_id counts as the empty text in the fold; repeated rows score alike;
    - an empty table gives an empty result; other columns are ignored.
    """
    spec = model.spec
    score = F.pandas_udf(lambda texts: pd.Series([model.score(t) for t in texts], dtype="float64"), "double")
    return docs.select("doc_id", (crc_mod(F.col("doc_id"), spec.folds) == 0).alias("held_out"), score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= spec.threshold).cast("int"))
