"""Replacing the rows of the exams that were worked on."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def replace_for_exams(target: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """All rows of the touched exams go, the new ones come; no new rows leaves an exam empty."""
    kept = target.join(touched.select("exam_id").distinct(), "exam_id", "left_anti")
    return kept.unionByName(new.select(*target.columns))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="examlens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def _open_writers(spark: SparkSession, most: int = 64):
    """While it holds, a task keeps the files of several buckets open, instead of sorting its rows by bucket."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, by: list[str] | None = None, times: int = 1) -> DataFrame:
    """Write a frame that is used more than once to the shared folder and read it back.

    Unlike a cache it survives lost executors, and each use reads only the columns it needs.
    The files go when the session's file system is closed. They are compressed by zstd, which writes less than the default.

    With ``by`` the rows are stored in hash buckets of these columns, ``times`` as many as a shuffle has partitions, so that
    what works by them needs no shuffle. The buckets belong to the frame; no name stays in the catalog.
    """
    spark = df.sparkSession
    made = f"{name}-{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/examlens/{made}"
    writer = df.write.option("compression", "zstd")
    if by:
        table = f"examlens_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * times
        with _open_writers(spark):
            writer.format("parquet").option("path", path).bucketBy(buckets, *by).saveAsTable(table)
        read = spark.table(table)
        spark.sql(f"drop table {table}")  # the files stay
    else:
        writer.parquet(path)
        read = spark.read.schema(df.schema).parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return read


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("exam_id"), F.lit(buckets)).cast("int")


def write_exam_table(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Question tables are stored by hash bucket of the exam."""
    df.withColumn("exam_bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("exam_bucket").parquet(path)


def read_exam_table(spark: SparkSession, path: str, schema: StructType, keep_bucket: bool = False) -> DataFrame:
    """The table with its declared columns; it may still be empty."""
    stored = StructType([*schema.fields, StructField("exam_bucket", IntegerType())])
    df = spark.read.schema(stored).parquet(path)
    return df if keep_bucket else df.drop("exam_bucket")


def replace_in_table(spark: SparkSession, path: str, new: DataFrame, touched: DataFrame, buckets: int = 64) -> None:
    """A6 on files: only the hash buckets of the touched exams are read and written again.

    The new contents are checkpointed first, so that a failed write can be
    repeated and no file is overwritten while it is read.
    """
    ensure_checkpoint_dir(spark)
    # At most ``buckets`` small integers reach the driver.
    hit = [r[0] for r in touched.select(bucket_of(buckets).alias("b")).distinct().collect()]
    if not hit:
        return
    old = read_exam_table(spark, path, new.schema, keep_bucket=True).filter(F.col("exam_bucket").isin(hit))
    columns = [c for c in old.columns if c != "exam_bucket"]
    merged = replace_for_exams(old.select(*columns), new, touched).withColumn("exam_bucket", bucket_of(buckets)).checkpoint()
    # A bucket that lost all its rows is not part of the output and is emptied on its own.
    left = {r[0] for r in merged.select("exam_bucket").distinct().collect()}
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("exam_bucket").parquet(path)
    empty = spark.createDataFrame([], merged.schema)
    for b in set(hit) - left:
        empty.drop("exam_bucket").write.mode("overwrite").parquet(f"{path}/exam_bucket={b}")
