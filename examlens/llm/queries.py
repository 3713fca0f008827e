"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, quality, sql, toxicity
from .common import read
from .decontaminate import leaks
from .embeddings import near_vectors
from .linededup import drop_boilerplate
from .mixing import mix, taken_words
from .phrases import collocations
from .resample import resampled
from .sharding import Tree, assign_shards
from .simhash import fingerprint_hex, near_duplicates
from .tokens import token_counts
from .urls import judge_urls


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read(spark, sf_dir, "documents"), Tree.of(40), Tree.of(41))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(read(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(mix(read(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(read(spark, sf_dir, "documents"))
    return near.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_quality, op3_decontamination, op4_line_dedup, op5_language,
    op6_embedding_dedup, op7_toxicity, op8_mixing, op9_simhash, op10_url_filter, op11_token_counts,
    op12_resampling, op13_collocations,
)}
ORACLES = {
    "op1_sharding": sql.shard_sql(),
    "op3_decontamination": sql.leaks_sql(),
    "op4_line_dedup": sql.lines_sql(),
    "op8_mixing": sql.mix_sql(),
    "op10_url_filter": sql.urls_sql(),
    "op12_resampling": sql.resample_sql(),
    "op13_collocations": sql.phrases_sql(),
}
