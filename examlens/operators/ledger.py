"""Calls to the user's functions, kept in a written ledger so that none is made twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlens.functions.ordered import running_sum

# Rows are placed in so many hash ranges before the running size is taken.
PLACES = 4096


def call_id(*parts: Column) -> Column:
    """Key of a call: what it is for and a hash of all that is asked. A null part counts as a text of its own."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def dealt(df: DataFrame, key: str, size: Column, target: int) -> DataFrame:
    """Rows dealt to tasks by their running size, in the order of a hash of ``key``.

    A task holds the rows that begin within one stretch of ``target``, so at
    most ``target`` and one row more. A null size counts as nothing.
    """
    place = F.pmod(F.xxhash64(key), F.lit(PLACES))
    sized = running_sum(df, [], place, [F.col(key)], F.coalesce(size, F.lit(0)).cast("bigint"), "_before")
    # One number reaches the driver.
    total = df.agg(F.sum(F.coalesce(size, F.lit(0)).cast("bigint"))).first()[0] or 0
    stretch = F.floor(F.col("_before") / target).cast("int")
    return sized.repartitionById(int(total // target) + 1, stretch).drop("_before")


def read_ledger(spark: SparkSession, path: str, answer: str) -> DataFrame:
    """One row per call: its answer, or its error where no attempt was answered."""
    schema = f"call_id string, {answer}, error string"
    rows = spark.read.schema(schema).parquet(path)
    rest = [c for c in rows.columns if c != "call_id"]
    return rows.groupBy("call_id").agg(
        F.min_by(F.struct(*rest), F.struct(F.col("error").isNotNull(), F.coalesce("error", F.lit(""))))
        .alias("r")).select("call_id", "r.*")


def call_once(
    requests: DataFrame, fn: Callable, arguments: list[str], answer: str, path: str,
    size: Column | None = None, target: int = 64, ask_again: bool = False,
) -> DataFrame:
    """The requests with the answers of ``fn``, asked only where the ledger at ``path`` has none.

    ``fn`` takes the named columns of a row and returns a tuple of the columns
    of ``answer`` (DDL); an exception it raises is the call's ``error``. Rows
    with equal ``call_id`` are one call. Calls are dealt to tasks of ``target``
    (rows, or units of ``size``), and the answers of a task are in the ledger
    from the moment it ends, even if the job fails afterwards: a rerun asks what
    is left, and a lost task repeats its own calls at most. With ``ask_again``
    calls that ended in an error are asked anew.
    """
    spark = requests.sparkSession
    schema = f"call_id string, {answer}, error string"
    columns = [c.strip().split(" ")[0] for c in answer.split(",")]
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, *args in f.itertuples(index=False):
                try:
                    rows.append((key, *fn(*args), None))
                except Exception as e:  # noqa: BLE001 - whatever the user's function raises concerns this call alone
                    rows.append((key, *[None] * len(columns), f"{type(e).__name__}:{e}"))
            yield pd.DataFrame(rows, columns=["call_id", *columns, "error"])

    settled = read_ledger(spark, path, answer)
    known = settled.filter("error is null") if ask_again else settled
    left = requests.dropDuplicates(["call_id"]).join(known.select("call_id"), "call_id", "left_anti")
    tasks = dealt(left, "call_id", F.lit(1) if size is None else size, target)
    # Version 2 of the committer moves a task's file into place when the task ends, not when the job does.
    tasks.select("call_id", *arguments).mapInPandas(run, schema).write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    keys = [c for c in requests.columns if c not in arguments]
    return requests.select(*keys).join(read_ledger(spark, path, answer), "call_id", "left")
