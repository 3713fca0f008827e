"""A corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from examlens.llm import quality
from examlens.llm.common import read, stage
from examlens.llm.decontaminate import without_leaks
from examlens.llm.mixing import mixed_documents
from examlens.llm.nearcopies import without_near_copies
from examlens.llm.sharding import Tree, assign_shards
from examlens.llm.simhash import one_of_each


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: by fingerprints, then by five-word shingles of what is left."""
    return without_near_copies(stage(one_of_each(docs), "single"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources passes over it."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it."""
    return assign_shards(docs, Tree.of(40), Tree.of(41))


STAGES = [("quality", keep_good), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", shard)]

# Trained and hashed stages are not expressible in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
