"""The day on which each batch of a queue runs, when what a day's limit leaves over is first in the next day's queue.

Batches run in the order of days and arrival, so with C the cost of all batches before one, and S of a day what was spent
before that day, a batch runs on the first day, from its own on, with C < S + limit. A day begins where the one before stopped:
at the first C that is not below S + limit, or at the end of what had arrived. That step keeps order, so the starts of all
days are the least of the steps taken from the ends of all days before, which a scan over days finds in as many rounds as
the longest backlog has doublings. Costs are whole numbers (1e-12 USD), so nothing depends on the cuts. A window holds the
batches that one limit pays for, or one row for each day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlens.functions.ordered import running_sum
from examlens.sources.sinks import materialize

UNIT = 10**12
_EXACT = "decimal(38,0)"


def _exact(c: Column) -> Column:
    return F.coalesce(F.round(c.cast("double") * float(UNIT)), F.lit(0)).cast(_EXACT)


def _in_usd(c: Column) -> Column:
    return (c.cast("decimal(24,0)") * F.lit("0.000000000001").cast("decimal(12,12)")).cast("decimal(38,12)")


def _next_starts(points: DataFrame, limit: Column, total: Column) -> DataFrame:
    """(c, n) for every point c: the first point that is not below c + limit, or the total."""
    asked = points.select((F.col("c") + limit).alias("v"), "c", F.lit(None).cast(_EXACT).alias("n"))
    both = asked.unionByName(points.select(F.col("c").alias("v"), F.lit(None).cast(_EXACT).alias("c"), F.col("c").alias("n")))
    both = both.withColumn("limit", limit).withColumn("_bin", F.expr("v div limit"))
    here = Window.partitionBy("_bin").orderBy("v").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    later = Window.orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    after = both.groupBy("_bin").agg(F.min("n").alias("n")).select("_bin", F.min("n").over(later).alias("_after"))
    found = both.withColumn("n", F.min("n").over(here)).where("c is not null").join(after, "_bin")
    return found.select("c", F.coalesce("n", "_after", total).cast(_EXACT).alias("n"))


def _first_days(points: DataFrame, starts: DataFrame, limit: Column) -> DataFrame:
    """(c, k): how many days have their limit used up before c, which is the number of the first one that has not."""
    both = points.select(F.col("c").alias("v"), "c", F.lit(0).alias("is_day")).unionByName(
        starts.select((F.col("s") + limit).alias("v"), F.lit(None).cast(_EXACT).alias("c"), F.lit(1).alias("is_day")))
    both = both.withColumn("limit", limit).withColumn("_bin", F.expr("v div limit"))
    here = Window.partitionBy("_bin").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = both.groupBy("_bin").agg(F.sum("is_day").alias("n")).select("_bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    found = both.withColumn("n", F.sum("is_day").over(here)).where("c is not null").join(before, "_bin")
    return found.select("c", (F.col("n") + F.col("_before")).cast("int").alias("_k"))


def run_days(usage: DataFrame, daily_usd: float, block: int) -> DataFrame:
    """``usage`` (day, seq, cost_usd, more) with ``cost_before``, what is spent on the day it runs before a batch, ``runs``,
    whether that is its own day, and ``due_day``, the day on which it runs. A null cost is 0; rows without a day or ``seq`` are left out;
    of equal ``seq`` any order is taken. Without a limit (0 or less) every batch runs on its own day."""
    known = usage.where("day is not null and seq is not null").withColumn("_cost", _exact(F.col("cost_usd")))
    queued = running_sum(known, ["day"], F.floor(F.col("seq") / block), [F.col("seq")], F.col("_cost"), "_in_day")
    per_day = known.groupBy("day").agg(F.sum("_cost").alias("_sum"))
    to_here = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    ends = per_day.select("day", "_sum", F.coalesce(F.sum("_sum").over(to_here), F.lit(0)).cast(_EXACT).alias("_start"))
    if daily_usd <= 0:
        return queued.select(*usage.columns, _in_usd(F.col("_in_day")).alias("cost_before"), F.lit(True).alias("runs"), F.col("day").alias("due_day"))
    limit = _exact(F.lit(daily_usd))
    placed = queued.join(ends.select("day", "_start"), "day").withColumn("c", (F.col("_start") + F.col("_in_day")).cast(_EXACT))
    placed = materialize(placed, "queue")
    ends = materialize(ends, "ends")
    # One row: the first and last day and the whole cost.
    first, last, whole = ends.agg(F.min("day"), F.max("day"), F.sum("_sum")).first()
    if first is None:
        return placed.select(*usage.columns, F.lit(None).cast("decimal(38,12)").alias("cost_before"), F.lit(True).alias("runs"), F.col("day").alias("due_day"))
    days = (last - first).days + int(whole) // max(1, round(daily_usd * UNIT)) + 2
    total = F.lit(str(int(whole))).cast(_EXACT)
    spark = usage.sparkSession
    k = spark.range(days).select(F.col("id").cast("int").alias("k"))
    arrived = ends.select(F.datediff("day", F.lit(first)).alias("k"), F.col("_sum"))
    until = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(k.join(arrived, "k", "left").select("k", F.coalesce(F.sum("_sum").over(until), F.lit(0)).cast(_EXACT).alias("s")), "starts")
    points = placed.select("c").union(starts.select("s")).distinct()
    points = materialize(points, "points")
    jumps, step = materialize(_next_starts(points, limit, total), "jumps"), 1
    while step < days and not jumps.where(F.col("n") < total).isEmpty():
        from_before = starts.join(jumps, F.col("s") == F.col("c")).select((F.col("k") + step).alias("k"), F.col("n").alias("_n"))
        starts = materialize(starts.join(from_before, "k", "left").select("k", F.least("s", "_n").alias("s")), "starts")
        twice = jumps.select("c", F.col("n").alias("_m")).join(jumps.select(F.col("c").alias("_m"), "n"), "_m").select("c", "n")
        jumps, step = materialize(twice, "jumps"), 2 * step
    dated = placed.join(_first_days(points, starts, limit), "c").withColumn("k", F.greatest("_k", F.datediff("day", F.lit(first))))
    return dated.join(starts, "k").select(
        *usage.columns, _in_usd(F.col("c") - F.col("s")).alias("cost_before"), (F.col("k") == F.datediff("day", F.lit(first))).alias("runs"),
        F.date_add(F.lit(first), F.col("k")).alias("due_day"))
