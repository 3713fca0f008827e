"""Target-distribution importance resampling: hashed word n-grams of the corpus and of target texts give every bucket a gain.

A 256-byte table lower-cases A-Z and blanks separators in UTF-8, `bytes.split` yields the
words, and an n-gram's hash is that of its beginning continued over one more word: chained
`zlib.crc32` seeds. Counters are reduced in each task and then by bucket. A document's weight is the sum of the
gains of its n-grams, a seeded Gumbel draw makes it a score, and the highest scores are drawn.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running, stage


@dataclass(frozen=True)
class ResampleSpec:
    buckets: int = 10_000
    order: int = 3  # words of the longest n-gram
    seed: int = 42
    min_words: int = 20  # shorter documents are never drawn
    percent: int = 5
    block: int = 1 << 20  # bytes of a text that are split at a time


# 0-9, a-z and all bytes from 128 on are word bytes.
TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def blocks(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a translated text, some `size` bytes at a time; no word is cut."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        if words:
            yield words
        at = end


def hashes(text: str | None, spec: ResampleSpec) -> Iterator[tuple[np.ndarray, int]]:
    """CRC-32 of the n-grams of the whole text, and how many words were read, block by block."""
    if not text:
        return
    last: list[bytes] = []  # words before the block that its n-grams may begin with
    for words in blocks(text.encode().translate(TABLE), spec.block):
        both = last + words
        more = b"\n ".join(both).split(b"\n")  # every word but the first with a blank before it
        grams = list(map(zlib.crc32, both))
        found = grams[len(last):]
        for n in range(1, spec.order):
            grams = list(map(zlib.crc32, more[n:], grams))
            found += grams[max(0, len(last) - n):]
        yield np.array(found, np.uint32), len(words)
        last = both[len(both) - min(len(both), spec.order - 1):]


def bucket_counts(texts: DataFrame, spec: ResampleSpec = ResampleSpec()) -> DataFrame:
    """(bucket, n): occurrences of n-grams by bucket over the column `text`; a task puts out one Counter."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for found, _ in hashes(text, spec):
                    total.update((found % spec.buckets).tolist())
        yield pd.DataFrame({"bucket": list(total.keys()), "n": list(total.values())}, dtype="int64")

    per_task = texts.select("text").where("text is not null").mapInPandas(counted, "bucket long, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, spec: ResampleSpec = ResampleSpec()) -> np.ndarray:
    """The gain of every bucket: floor(1000 ln of its smoothed share in `target` over that in `source`)."""

    def dense(texts: DataFrame) -> np.ndarray:
        n = np.zeros(spec.buckets, np.int64)
        for bucket, count in bucket_counts(texts, spec).collect():  # spec.buckets rows at most
            n[bucket] = count
        return n

    s, t = dense(source), dense(target)
    more = lambda n: (n + 1).astype(np.float64)
    shares = more(t) * float(s.sum() + spec.buckets) / (more(s) * float(t.sum() + spec.buckets))
    return np.floor(1000.0 * np.log(shares)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, spec: ResampleSpec = ResampleSpec()) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    table = docs.sparkSession.sparkContext.broadcast(gain)  # spec.buckets numbers

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_bucket = table.value
        for texts in batches:
            rows = []
            for text in texts:
                words = features = weight = 0
                for found, n in hashes(text, spec):
                    words, features, weight = words + n, features + len(found), weight + int(by_bucket[found % spec.buckets].sum())
                rows.append((words, features, weight))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")

    weigh.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    got = F.pandas_udf(weigh, "n_words long, n_features long, weight long")(F.col("text"))
    return docs.select("doc_id", "text").select("doc_id", got.alias("w")).select("doc_id", "w.*")


def noise(doc_id, seed: int):
    """A draw from the Gumbel distribution in thousandths, by the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, spec: ResampleSpec = ResampleSpec(), width: int = 256) -> DataFrame:
    """`rank` for the highest scores among documents of enough words; null for all others.

    Scores are counted in ranges of `width` first, which tells the range that holds the last
    drawn one; only rows from there up are sorted, dealt by ranges of the whole sort key. Rows
    that agree in everything are one row with a number while they are sorted.
    """
    spark = scored.sparkSession
    able = scored.where(F.col("n_words") >= spec.min_words)
    n = able.count()
    want = spec.percent * n // 100
    place = F.expr(f"score div {width}")
    counts = able.groupBy(place.alias("range")).agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lowest = counts.withColumn("above", above).where(F.col("above") < want).agg(F.min("range")).first()[0] if want else None
    out = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    near = (F.col("n_words") >= spec.min_words) & (place >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    same = scored.where(near).groupBy(*out).agg(F.count("*").alias("copies"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(same.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    before = running(ranged.withColumn("all", F.lit(0)), ["all"], "part", order, F.col("copies"), "before")
    ranked = before.select(*out, F.explode(F.expr("sequence(before + 1, before + copies)")).alias("rank"))
    rest = scored.where(~near).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked.withColumn("rank", F.when(F.col("rank") <= want, F.col("rank"))))


def resampled(docs: DataFrame, target: DataFrame, spec: ResampleSpec = ResampleSpec()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of `docs`, for the texts of `target`.

    - a null or empty text, or one without a word, has no features and weight 0, and is never drawn;
    - a null doc_id draws by the empty text and comes last among equal scores;
    - repeated rows are rows: each counts and each can be drawn, with ranks of their own; rows of
      one id and score go by weight, then by number of features;
    - an empty target gives gains by the corpus alone; an empty corpus gives an empty result;
    - other columns are ignored.

    Texts are read block by block; the table of gains is the only broadcast.
    """
    gain = gains(docs, target, spec)
    scored = weighed(docs, gain, spec).withColumn("score", F.col("weight") + noise(F.col("doc_id"), spec.seed))
    return drawn(stage(scored, "scored"), spec)
