"""Connected components by joins and minima, without a row ever meeting all of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of `edges` (a, b: long); root is the smallest node reachable.

    Each round a node takes the lowest root among its neighbours, its old root takes the
    lowest that any of its nodes saw, and then every node jumps to its root's root. Labels
    only fall and stay inside the component, so a round without a change is the end; jumps
    double the reach, so long chains take a logarithm of rounds. Sums and minima are combined
    before the shuffle, and the joins are of a kind that Spark can split at a hot key.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = stage(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")), "roots")
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        step = label.join(seen, "node").select("node", "root", F.least("root", "seen").alias("low"))
        hook = step.groupBy("root").agg(F.min("low").alias("hook"))
        step = stage(step.join(hook, "root").select("node", "root", F.least("low", "hook").alias("next")), "hooked")
        over = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = stage(step.join(over, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")), "roots")
        label = new.select("node", "root")
        if new.where("moved").isEmpty():
            return label
