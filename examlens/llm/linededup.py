"""Line dedup by the spread of a line over distinct sites.

Lines that more than one site has get a HyperLogLog sketch of their sites, merged by
aggregation. Where the estimate lies near the threshold, the sites are counted exactly;
elsewhere the estimate decides. Lines on `min_sites` sites or more leave every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


@dataclass(frozen=True)
class SpreadSpec:
    min_sites: int = 5
    log_k: int = 12  # sketches of 2**log_k registers at most
    sigmas: float = 6.0  # estimates within so many standard errors of the threshold are counted exactly

    @property
    def error(self) -> float:
        return self.sigmas * 1.04 / 2 ** (self.log_k / 2)


SALTS = 16
AROUND = " \t\n\v\f\r"  # a line is compared without these at its ends


def boilerplate(lines: DataFrame, spec: SpreadSpec = SpreadSpec()) -> DataFrame:
    """(line, sites): the lines on min_sites sites or more, of rows (doc, line, site). A null site counts as no site.

    A line's sketches are made for each of 16 hashes of its documents and merged, so a very
    common line is not one task.
    """
    spread = stage(lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("line"), "several")
    salted = lines.join(spread, "line").groupBy("line", F.pmod("doc", F.lit(SALTS)).alias("salt")).agg(F.hll_sketch_agg("site", F.lit(spec.log_k)).alias("sketch"))
    sketches = salted.groupBy("line").agg(F.hll_union_agg("sketch").alias("sketch"))
    guess = stage(sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    low, high = spec.min_sites * (1 - spec.error), spec.min_sites * (1 + spec.error)
    near = guess.where(F.col("sites").between(low, high)).select("line")
    exact = lines.join(near, "line").select("line", "site").distinct().groupBy("line").agg(F.count("site").alias("sites"))
    return guess.where(F.col("sites") > high).union(exact.where(F.col("sites") >= spec.min_sites))


def drop_boilerplate(docs: DataFrame, site: str = "source", spec: SpreadSpec = SpreadSpec()) -> DataFrame:
    """doc_id, n_lines, n_removed and the text without boilerplate lines, one row for each row of `docs`.

    Lines end at a line feed and are compared without ASCII white space around them,
    so with or without a carriage return or tab at their ends.

    - a null text stays null with 0 lines; an empty line is never boilerplate;
    - rows without a site keep their other lines like any other, but add no site;
    - rows with equal id and text are cleaned alike; a null doc_id is an id like any other;
    - a document whose lines all go keeps an empty text; empty tables give no rows; other columns are ignored.
    """
    text = docs.select("doc_id", F.col(site).alias("site"), "text").withColumn("doc", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    lines = stage(
        text.select("doc", "site", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("line", F.btrim(F.col("line"), F.lit(AROUND)))
        .where("line <> ''").select("doc", "site", "at", F.xxhash64("line").alias("line")), "lines",
    )
    bad = boilerplate(lines, spec).select("line")
    gone = lines.join(bad, "line").groupBy("doc").agg(F.collect_set("at").alias("gone"))  # a document's own places
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda line, i: ~F.array_contains("gone", i))
    return text.join(gone, "doc", "left").select(
        "doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
