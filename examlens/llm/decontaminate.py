"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some token positions of a short span and ignores the others, so a replaced
word at an ignored place does not change the hash. The seeds of the benchmark meet the seeds
of every document in a hash join; around each hit the document is laid against the item, and
the best window of `window` words has to agree in `share` of them. The two masks find every
window of 13 words with two replaced words (tested over all of them).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lower_ascii, stage


@dataclass(frozen=True)
class SeedSpec:
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
    window: int = 13  # words of an overlap; an item with fewer words has to agree as a whole
    share: float = 0.8
    chunk_words: int = 200_000  # benchmark words joined in one pass over the documents

    @property
    def span(self) -> int:
        return max(max(m) for m in self.masks) + 1


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, spec: SeedSpec, keep: list[str], gap: int) -> DataFrame:
    """One row per place and mask: the columns to keep, at, seed and the words `around` the place.

    `around` holds the words of every window that covers the seed, with `gap` where the text has none;
    the text itself stays behind, however long it is.
    """
    more = spec.window - spec.span
    blank = F.array_repeat(F.lit(gap).cast("long"), more)
    padded = rows.withColumn("words", F.concat(blank, "words", blank))
    last = F.size("words") - 2 * more - spec.span
    placed = padded.select(*keep, "words", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))  # a filter would split the text twice
    seed = lambda i, m: F.xxhash64(F.lit(i), *[F.get("words", F.col("at") + more + j) for j in m])
    around = F.slice("words", F.col("at") + 1, F.lit(spec.window + more))
    return placed.select(*keep, "at", around.alias("around"), F.explode(F.array(*[seed(i, m) for i, m in enumerate(spec.masks)])).alias("seed"))


def best_window(doc: Column, item: Column, first: Column, last: Column, n: Column) -> Column:
    """Most words that agree in a window of n words that starts at first .. last, of two equally long arrays."""
    agree = F.zip_with(doc, item, lambda a, b: (a == b).cast("int"))
    sums = lambda agree: F.transform(F.sequence(first, last), lambda s: F.aggregate(F.slice(agree, s + 1, n), F.lit(0), lambda a, x: a + x))
    return F.array_max(F.transform(F.array(agree), sums)[0])


def leaks(docs: DataFrame, benchmark: DataFrame, spec: SeedSpec = SeedSpec()) -> DataFrame:
    """(doc_id, text_hash, item_id, words, matches): the documents that hold a passage of an item, one row for each pair.

    Words are runs of non-white characters with A-Z lower-cased. `words` is the window's length,
    `matches` the most words that agree in one. Everything happens in the task that reads the
    document: the benchmark's seeds are broadcast, `chunk_words` words of it at a time, and a
    larger benchmark takes one pass over the documents for each chunk. Only verified pairs are shuffled.

    - a null or empty text holds nothing; an item with fewer words than a seed's span, or null, is never found;
    - repeated items are found each under its item_id; repeated documents give one row if their ids are equal too;
    - a null doc_id or item_id is kept as null; other columns are ignored; empty tables give no rows.
    """
    items = stage(benchmark.select("item_id", token_hashes(F.col("text")).alias("words")).where(F.size("words") >= spec.span), "items")
    items = items.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(1 << 20)))
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    more = spec.window - spec.span
    chunks = max(1, -(-total // spec.chunk_words))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), token_hashes(F.col("text")).alias("words"))
    found = None
    for c in range(chunks):
        part = items.where(F.pmod("part", F.lit(chunks)) == c).select("item_id", "words")
        keyed = _seeds(part.withColumn("n", F.size("words")), spec, ["item_id", "n"], -1).select("item_id", "n", F.col("at").alias("item_at"), F.col("around").alias("item"), "seed")
        # A chunk has about chunk_words seeds for each mask, whatever the size of the benchmark.
        hits = _seeds(rows, spec, ["doc_id", "text_hash"], 0).join(F.broadcast(keyed), "seed")
        n = F.least("n", F.lit(spec.window))
        first = F.greatest(F.lit(0), F.lit(more) - F.col("item_at"))
        last = F.least(F.lit(more), F.col("n") - n + more - F.col("item_at"))
        matches = best_window(F.col("around"), F.col("item"), first, last, n)
        hits = hits.select("doc_id", "text_hash", "item_id", n.alias("words"), matches.alias("matches"))
        found = hits if found is None else found.union(hits)
    # The filter stands behind the aggregate: in the join's condition it would keep the join out of generated code.
    best = found.groupBy("doc_id", "text_hash", "item_id", "words").agg(F.max("matches").alias("matches"))
    return best.where(F.col("matches") >= F.ceil(F.col("words") * spec.share))


def without_leaks(docs: DataFrame, benchmark: DataFrame, spec: SeedSpec = SeedSpec()) -> DataFrame:
    """The rows of `docs` that hold no passage of the benchmark."""
    bad = leaks(docs, benchmark, spec).select(F.struct("doc_id", "text_hash").alias("__doc")).distinct()
    return docs.withColumn("__doc", F.struct("doc_id", F.xxhash64("text").alias("text_hash"))).join(bad, "__doc", "left_anti").select(*docs.columns)
