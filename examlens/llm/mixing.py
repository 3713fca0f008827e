"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a hashed order, which makes one stream of words that
repeats, and the stream is cut into blocks of equal words. Slot s of the mix has the point
frac((s + 1) * golden ratio), in 32-bit integers; the points are mapped through the cumulative
targets to sources, and the k-th slot of a source takes the k-th block of its stream. Words
that the slots leave open up to the target follow in closing slots, so each source gives its
rounded target exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hex52, running, stage, word_count

GOLDEN = 2654435769  # 2**32 divided by the golden ratio
CELLS = 1024
BUCKETS = 1024


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[int, ...] = (1, 2, 3)  # of the sources by code point, null last, repeating
    repeats: int = 3  # a source or document is taken that often at most
    blocks: int = 1 << 17  # blocks of the whole mix at least, unless they would be below a word
    block_words: int = 1 << 16  # words of a block at most


def source_targets(sources: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Adds rank, weight, target and quota (its rounding) to (source, words), one row per source.

    The words of all sources are shared by weight; a target stops at `repeats` times the
    source's words, and the excess is shared again: sources are capped in the order of
    cap / weight, as long as the share of the next one would pass its cap. One row per
    source meets in one task, no document does.
    """
    n = len(spec.weights)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.array(*map(F.lit, spec.weights))[F.col("rank") % n].cast("long")).withColumn("cap", F.col("words") * spec.repeats)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    return (
        ranked.withColumn("all_words", F.sum("words").over(every)).withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("heavy", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * (F.col("all_weight") - F.col("heavy")) <= (F.col("all_words") - F.col("caps")) * F.col("weight"))
        .withColumn("over", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(every), F.lit(0)))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
            F.col("weight") * (F.col("all_words") - F.col("over")).cast("double") / F.nullif(F.col("all_weight") - F.col("gone"), F.lit(0)).cast("double")))
        .withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
        .select("source", "words", "rank", "weight", "target", "quota")
    )


def schedule(plan: DataFrame, step: int, slots: int) -> DataFrame:
    """(rank, block, slot): which block of which source each slot takes.

    `plan` has rank, lo and hi: the source's part of the cumulative quotas. Points meet
    sources by cells of the line, an equality besides the range.
    """
    total = plan.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0]
    if not total:
        slots = 0
    cells = max(CELLS, plan.count())
    spark = plan.sparkSession
    point = ((F.col("id") + 1) * GOLDEN % (1 << 32)).cast("double") / float(1 << 32)
    points = spark.range(slots).select(F.col("id").alias("slot"), F.floor(point * float(total)).cast("long").alias("at"), F.expr(f"cast(id div {BUCKETS} as int)").alias("part"))
    cell = lambda c: F.floor(c.cast("double") / float(max(total, 1)) * cells).cast("long")
    spans = plan.where("hi > lo").select("rank", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    hit = points.withColumn("cell", cell(F.col("at"))).join(spans, "cell").where("at >= lo and at < hi").select("rank", "slot", "part")
    return running(hit, ["rank"], "part", ["slot"], F.lit(1), "block").select("rank", "block", "slot")


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The pieces of the mix: one row per document, pass and block, and one row without a slot for a document that isn't taken.

    Columns: row (its bucket and place, unique), doc_id, source, text_hash, size, source_size, target, pass
    (0 for the first time), slot, words (of the document in this slot). `slot` gives the order of the mix.

    - a null text has no words, an empty one neither; such documents have one row without a slot;
    - a null source is a source, the last one; a null doc_id is shuffled as the empty text;
    - equal rows are separate documents; ties of the shuffle are broken by id, size and text;
    - an empty table gives no rows; other columns of `docs` are ignored.
    """
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    order = hex52(F.concat(F.lit("mix/"), ident))
    rows = stage(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), order.alias("order"))
        .withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
        .withColumn("bucket", (F.col("order") % BUCKETS).cast("int")),
        "mix",
    )
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    plan = stage(source_targets(sources, spec).withColumn("hi", F.sum("quota").over(Window.orderBy("rank"))).withColumn("lo", F.col("hi") - F.col("quota")), "plan")
    total = plan.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    step = max(1, min(spec.block_words, total // spec.blocks))
    slots = schedule(plan, step, total // step)

    ties = ["order", "doc_id", "size", "text_hash"]
    inside = Window.partitionBy("key", "bucket").orderBy(*ties)
    per = rows.groupBy("key", "bucket").agg(F.first("source").alias("s"), F.sum("size").alias("in"))
    per = per.withColumn("before", F.coalesce(F.sum("in").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.join(plan, per.s.eqNullSafe(plan.source)).select("key", "bucket", "before", "rank", F.col("words").alias("source_size"), "target", "quota")
    placed = (
        rows.withColumn("place", F.row_number().over(inside))
        .withColumn("start", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(per, ["key", "bucket"]).withColumn("start", F.col("start") + F.col("before"))
    )
    passes = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(spec.repeats - 1))))
    lo = F.col("start") + F.col("pass") * F.col("source_size")
    pieces = (
        passes.withColumn("lo", lo).withColumn("hi", F.least(lo + F.col("size"), F.col("quota")))
        .where("pass = 0 or hi > lo")
        .withColumn("block", F.explode_outer(F.when(F.col("hi") > F.col("lo"), F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi - 1) div {step}")))))
    )
    words = F.when(F.col("block").isNull(), 0).otherwise(F.least("hi", (F.col("block") + 1) * step) - F.greatest("lo", F.col("block") * step))
    end = F.when(F.col("block").isNotNull(), F.coalesce("slot", F.lit(total // step) + F.col("block")))
    return pieces.join(slots, ["rank", "block"], "left").select(
        F.struct("rank", "bucket", "place").alias("row"), "doc_id", "source", "text_hash", "size", "source_size", "target", "pass", end.alias("slot"), words.cast("long").alias("words"))


def taken_words(pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of all its pieces), one row per document."""
    same = ["row", "doc_id", "size", "source_size", "target"]
    return pieces.groupBy(*same).agg(F.sum("words").alias("taken")).drop("row")


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The rows of `docs` as often as the mix passes over them, by at least half of their words.

    A document without words takes no part in the shares and stays once. Rows that are equal
    in id, source and text share their passes evenly, rounded.
    """
    pieces = mix(docs, spec)
    same = ["doc_id", "source", "text_hash"]
    passes = pieces.groupBy("row", "pass", "size", *same).agg(F.sum("words").alias("words"))
    per = passes.groupBy("row", *same).agg(F.sum((F.col("words") * 2 >= F.col("size")).cast("int")).alias("times"))
    identity = lambda text: F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), text)
    times = per.groupBy(identity(F.col("text_hash")).alias("__same")).agg(F.round(F.avg("times")).cast("int").alias("__times")).where("__times > 0")
    return (
        docs.withColumn("__same", identity(F.xxhash64("text"))).join(times, "__same")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
    )
