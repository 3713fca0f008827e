"""What several operators share: staged frames, running sums that split hot keys, hashes, bounded samples."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlens.sources.sinks import ensure_checkpoint_dir

# One word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WORDS_BYTES = re.compile(rb"[^\x20\x09-\x0d]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEX52 = 2.0**52


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends, a lost executor costs a re-read.

    The files go when the session's file system is closed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex52(c: Column) -> Column:
    """52 bits of a string's MD5 as a long: the same number in any engine that has MD5."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 13), 16, 10).cast("long")


def running(df: DataFrame, keys: list[str], block: str, order: list, value: Column, out: str, total: str | None = None) -> DataFrame:
    """Adds the sum of `value` over the rows of the same keys that come before, by block and then by order.

    Only the rows of one (keys, block) meet in a task; blocks are joined by a sum for each,
    so a key may hold any share of all rows. `df` is read twice. Keys must not be null.
    """
    at = [*keys, block]
    per = df.groupBy(*at).agg(F.sum(value).alias("__in"))
    over = Window.partitionBy(*keys).orderBy(block)
    per = per.withColumn("__before", F.coalesce(F.sum("__in").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        per = per.withColumn(total, F.sum("__in").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(per.drop("__in"), at)
        .withColumn(out, (F.col(out) + F.col("__before")).cast("long")).drop("__before")
    )


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; an absent id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, key: Column, rows: int, bound: int) -> DataFrame:
    """About `bound` of `rows` rows, the ones whose key hashes lowest; all of them if they are fewer."""
    if rows <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * bound / rows))
