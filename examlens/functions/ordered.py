"""Ordered computations that do not put one whole key into one task.

A running value over a key is computed in two levels: inside fixed ranges
("blocks") of the order column, and over one summary row per block. The wide
rows are only ever shuffled by (key, block); the per-key window sees summaries.
The windows need that partitioning anyway, so the summaries are joined by merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)


def _key_block(keys: list[str]) -> list[str]:
    return [*keys, "_block"]


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: dict[str, Column],
    block: int,
    firsts: dict[str, Column] | None = None,
) -> DataFrame:
    """For each name, the last non-null value at or before the row.

    ``firsts`` adds the first non-null value of the whole key.
    """
    firsts = firsts or {}
    at = F.col(order).alias("at")
    wrap = lambda v: F.when(v.isNotNull(), F.struct(at, v.alias("v")))
    d = df.select(
        "*", F.floor(F.col(order) / block).alias("_block"),
        *[wrap(v).alias(f"_v_{n}") for n, v in values.items()],
    )
    per_block = d.groupBy(*_key_block(keys)).agg(
        *[F.max(f"_v_{n}").alias(f"_s_{n}") for n in values],
        *[F.min(wrap(v)).alias(f"_f_{n}") for n, v in firsts.items()],
    )
    over_key = Window.partitionBy(*keys)
    before = over_key.orderBy("_block").rowsBetween(*_BEFORE)
    carry = per_block.select(
        *_key_block(keys),
        *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values],
        *[F.min(f"_f_{n}").over(over_key)["v"].alias(n) for n in firsts],
    )
    in_block = Window.partitionBy(*_key_block(keys)).orderBy(order).rowsBetween(*_UP_TO_HERE)
    return d.join(carry.hint("merge"), _key_block(keys)).select(*df.columns, *firsts, *[
        F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(in_block), F.col(f"_c_{n}"))["v"].alias(n)
        for n in values
    ])


def running_sum(
    df: DataFrame, keys: list[str], block: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key (the row itself excluded).

    ``block`` must not decrease along ``order``. Exact numbers (integers,
    decimals) make the result independent of the block size.
    """
    d = df.select("*", block.alias("_block"), value.alias("_value"))
    per_block = d.groupBy(*_key_block(keys)).agg(F.sum("_value").alias("_total"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*_BEFORE)
    base = per_block.select(*_key_block(keys), F.sum("_total").over(over_blocks).alias("_base"))
    in_block = Window.partitionBy(*_key_block(keys)).orderBy(*order).rowsBetween(*_BEFORE)
    zero = F.lit(0)
    return d.join(base.hint("merge"), _key_block(keys)).select(
        *df.columns,
        (F.coalesce("_base", zero) + F.coalesce(F.sum("_value").over(in_block), zero)).alias(name),
    )


def position(
    df: DataFrame, keys: list[str], block: Column, order: list[Column], name: str
) -> DataFrame:
    """1-based row number in the key, by way of per-block counts."""
    counted = running_sum(df, keys, block, order, F.lit(1), "_before")
    return counted.select(*df.columns, (F.col("_before") + 1).cast("int").alias(name))
