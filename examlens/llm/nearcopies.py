"""Near copies by the similarity of their five-word shingles, for what SimHash fingerprints leave.

A text whose copy differs in a fifth of its shingles is some ten bits of 64 away, and at that
radius a pigeonhole search names a fixed share of all pairs. So documents that keep different
fingerprints meet by bands of MinHash values instead; a pair at the similarity asked for shares a
band with a probability of 0.9999, and each pair that meets is verified on the whole shingle sets.

A document goes if any lower one that it meets is alike, whether that one stays or goes: a rule
on pairs alone, so no third document, and no way of finding the pairs, changes the outcome.

A band value that over `bucket` documents share is searched in rounds: its members that are still
there meet its lowest `pivots` documents, then the next `growth` times as many, and so on through
all of them. Only the members met are fewer from round to round; whatever is gone is met on. Members
that copy a low one are gone after the first round, so a group of m copies costs m pairs for a pivot;
members that are not alike are compared signature by signature, in blocks of numpy, in rounds
that grow with the logarithm of the members.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS_BYTES, stage


@dataclass(frozen=True)
class NearSpec:
    shingle: int = 5
    share: float = 0.8
    bands: int = 24
    width: int = 5  # MinHash values in a band
    bucket: int = 128
    pivots: int = 8  # lowest documents of a larger band value that its members meet first
    growth: int = 8  # and how many times as many are next
    slack: float = 0.16  # a pair is verified if its MinHash values agree in share - slack

    @property
    def least(self) -> float:
        return (self.share - self.slack) * self.bands * self.width


SOURCES, TARGETS = 256, 1024  # rows of the two sides of a block


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The different XXH64 of the text's word shingles, A-Z lower-cased; fewer words: the whole sequence; none: empty."""
    words = WORDS_BYTES.findall(text.encode().lower()) if text else []
    n = min(shingle, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1 if n else 0)), np.uint64))


def minhash(hashes: np.ndarray, values: int) -> np.ndarray | None:
    """The least of `values` multiply-and-shift hashes of the set, 32 bits each; None for an empty set."""
    if not len(hashes):
        return None
    odd = np.random.default_rng(17).integers(0, 2**63, values, np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = hashes ^ (hashes >> np.uint64(29))
    return np.array([((mixed * a) >> np.uint64(32)).min() for a in odd], np.uint64).astype(np.uint32).view(np.int32)


def signature(text: Column, spec: NearSpec) -> Column:
    return F.pandas_udf(lambda texts: pd.Series([minhash(shingle_hashes(t, spec.shingle), spec.bands * spec.width) for t in texts], dtype=object), "array<int>")(text)


def shingle_set(text: Column, spec: NearSpec) -> Column:
    return F.pandas_udf(lambda texts: pd.Series([shingle_hashes(t, spec.shingle).view(np.int64) for t in texts], dtype=object), "array<long>")(text)


def _side(df: DataFrame, c: str, side: str) -> DataFrame:
    return df.select(F.col("doc_id").alias(side), F.col(c).alias(f"{c}_{side}"))


def _likely(pairs: DataFrame, marks: DataFrame, spec: NearSpec) -> DataFrame:
    """The pairs (a, b) whose MinHash values agree often enough."""
    both = pairs.distinct().join(_side(marks, "sig", "a"), "a").join(_side(marks, "sig", "b"), "b")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.where(agree >= spec.least).select("a", "b")


def _likely_in_blocks(ranked: DataFrame, alive: DataFrame, low: int, high: int, marks: DataFrame, spec: NearSpec) -> DataFrame:
    """The same for the places low .. high - 1 of each band value against those of `alive` that come after them."""
    at, least = ["band", "value", "s", "t"], spec.least
    block = lambda n: F.floor(F.col("rank") / n).cast("int")
    upto = lambda first, rows, n: F.explode(F.sequence(F.lit(first), F.floor((rows - 1) / n).cast("int")))
    out = ["band", "value", "doc_id", "rank", "sig", "source", "s", "t"]
    source = ranked.where((F.col("rank") >= low) & (F.col("rank") < high)).join(marks, "doc_id")
    source = source.withColumn("source", F.lit(True)).withColumn("s", block(SOURCES)).withColumn("t", upto(0, F.col("members"), TARGETS)).select(out)
    target = alive.where(F.col("rank") > low).join(marks, "doc_id")
    target = target.withColumn("source", F.lit(False)).withColumn("t", block(TARGETS)).withColumn("s", upto(low // SOURCES, F.least("members", F.lit(high)), SOURCES)).select(out)
    rows = source.union(target).where((F.col("t") + 1) * TARGETS > F.col("s") * SOURCES)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["source"]], rows[~rows["source"]]
        if not len(a) or not len(b):
            return rows.iloc[:0][["doc_id", "doc_id"]].set_axis(["a", "b"], axis=1)
        x, y = np.stack(a["sig"].to_list()).T, np.stack(b["sig"].to_list()).T
        agree = np.zeros((len(a), len(b)), np.int16)
        for p, q in zip(x, y, strict=True):
            agree += p[:, None] == q
        i, j = np.nonzero((agree >= least) & (a["rank"].to_numpy()[:, None] < b["rank"].to_numpy()))
        return pd.DataFrame({"a": a["doc_id"].to_numpy()[i], "b": b["doc_id"].to_numpy()[j]})

    kind = ranked.schema["doc_id"].dataType.simpleString()
    return rows.groupBy(*at).applyInPandas(compare, f"a {kind}, b {kind}").distinct()


def _copies(likely: DataFrame, texts: DataFrame, spec: NearSpec) -> DataFrame:
    """doc_id of each b of the pairs whose shingle sets have the similarity; only documents of likely pairs have theirs built."""
    likely = stage(likely, "likely")
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    sets = stage(texts.join(ids, "doc_id", "left_semi").select("doc_id", shingle_set(F.col("text"), spec).alias("set")), "sets")
    met = likely.join(_side(sets, "set", "a"), "a").join(_side(sets, "set", "b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    alike = met.withColumn("common", common).where(F.col("common") >= spec.share * (F.size("set_a") + F.size("set_b") - F.col("common")))
    return stage(alike.select(F.col("b").alias("doc_id")).distinct(), "copies")


def without_near_copies(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """The rows of `docs` without those that copy, to `share` or more, a document of a lower doc_id.

    - a row goes if and only if it has the similarity to a row of a lower doc_id that it met; so no two
      rows that stay and met have it, and the lowest of each chain of copies stays;
    - texts that are null or have no words, and rows without an id, all stay; doc_id must otherwise
      be different in every row;
    - an empty table gives an empty result; the columns are those of `docs`.
    """
    at = ["band", "value"]
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    marks = stage(texts.select("doc_id", signature(F.col("text"), spec).alias("sig")).where("sig is not null"), "minhash")
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.slice("sig", k * spec.width + 1, spec.width)).alias("value")) for k in range(spec.bands)])
    spread = marks.select("doc_id", F.explode(bands).alias("x")).select("doc_id", "x.band", "x.value")
    shared = spread.groupBy(*at).agg(F.count("*").alias("members")).where("members > 1")
    members = stage(spread.join(shared, at).select("doc_id", *at, "members"), "members")
    gone = None
    left = lambda df: df if gone is None else df.join(gone, "doc_id", "left_anti")
    most = members.agg(F.max("members")).first()[0] or 0
    if most > spec.bucket:
        place = F.row_number().over(Window.partitionBy(*at).orderBy("doc_id")) - 1
        ranked = stage(members.where(F.col("members") > spec.bucket).withColumn("rank", place), "ranked")
        low, high = 0, spec.pivots
        while low < most - 1:
            copies = _copies(_likely_in_blocks(ranked, left(ranked), low, high, marks, spec), texts, spec)
            gone = copies if gone is None else gone.union(copies)
            low, high = high, high * spec.growth
    small = members.where(F.col("members") <= spec.bucket).select("doc_id", *at)
    met = small.withColumnRenamed("doc_id", "a").join(left(small).withColumnRenamed("doc_id", "b"), at).where("a < b").select("a", "b")
    copies = _copies(_likely(met, marks, spec), texts, spec)
    return docs.join(copies if gone is None else gone.union(copies), "doc_id", "left_anti").select(*docs.columns)
