"""Scans: exam files, upload forms, results of an external extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlens.config import MAX_UPLOAD_BYTES
from examlens.functions.text import trimmed
from examlens.templates import templates

# Accepted content types.
CONTENT_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/jpg", "image/webp")

QUESTION = "struct<order:int,questionText:string,options:array<string>,correctAnswer:string,sourcePage:int,contextText:string>"
RESULT = (
    "status string, usedPath string, fallbackTriggered boolean, fallbackReason string, totalQuestions int, "
    f"questions array<{QUESTION}>, extractionChars int, errorCode string, message string, _bad string"
)


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A1: files as path, size, bytes and time; the bytes are read only if used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def missing_documents(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """A1: registered paths without a file, with the error an exam gets for it."""
    return wanted.join(found.select("path"), "path", "left_anti").withColumn(
        "error_code", F.concat(F.lit("FILE_NOT_FOUND:"), "path"))


def validate_uploads(uploads: DataFrame) -> DataFrame:
    """A2: first failing check of every upload form, and the normalised fields.

    The template table has four rows, so it is broadcast.
    """
    known = templates(uploads.sparkSession).select(F.col("template_id").alias("_known"))
    wanted = F.nullif(trimmed(F.col("template_id")), F.lit(""))
    typed = lambda c: F.nullif(trimmed(F.col(c).cast("string")), F.lit(""))
    bad = lambda c: ~F.regexp_like(c, F.lit(r"^[0-9]+\z")) | F.regexp_like(c, F.lit(r"^0+\z"))
    start, end = typed("page_start"), typed("page_end")
    number = lambda c: c.try_cast("bigint")
    pdf = F.col("content_type") == "application/pdf"
    field = (
        F.when(bad(start), "page_start")
        .when(bad(end), "page_end")
        .when(number(end) < number(start), "page_range")
        .when(F.col("_wanted").isNotNull() & F.col("_known").isNull(), "template_id")
        .when(F.col("content_type").isNull() | ~F.col("content_type").isin(*CONTENT_TYPES), "content_type")
        .when((F.col("size_bytes") <= 0) | (F.col("size_bytes") > MAX_UPLOAD_BYTES), "size_bytes")
    )
    code = F.when(F.col("reject_field") == "content_type", "INVALID_FILE_TYPE").when(
        F.col("reject_field") == "size_bytes", "INVALID_FILE_SIZE").when(F.col("reject_field").isNotNull(), "INVALID_INPUT")
    base = F.regexp_extract("filename", "([^/]*)$", 1)
    ext = F.nullif(F.regexp_extract(base, r"^.+(\.[^.]*)$", 1), F.lit(""))
    stem = F.when(ext.isNull(), base).otherwise(F.substring(base, F.lit(1), F.length(base) - F.length(ext)))
    safe = F.concat(
        F.regexp_replace(stem, "[^a-zA-Z0-9._-]", "_"),
        F.coalesce(ext, F.when(pdf, ".pdf").otherwise(".bin")),
    )
    title = F.nullif(trimmed(F.col("title")), F.lit("")) if "title" in uploads.columns else F.lit(None).cast("string")
    checked = uploads.withColumn("_wanted", wanted).join(F.broadcast(known), F.col("_wanted") == F.col("_known"), "left")
    return checked.withColumn("reject_field", field).select(
        "upload_id", "filename", "reject_field", code.alias("reject_code"),
        F.when(pdf, "pdf").otherwise("image").alias("file_type"),
        safe.alias("safe_name"), F.coalesce(title, "filename").alias("title"),
        F.nullif(F.upper(trimmed(F.col("prova_type"))), F.lit("")).alias("booklet"),
        F.col("_wanted").alias("template_id"),
        number(start).cast("int").alias("page_start"), number(end).cast("int").alias("page_end"),
    )


def read_extraction_results(results: DataFrame, column: str = "result") -> DataFrame:
    """A5: JSON text of an external extractor to ok or error, one row per exam.

    A success needs at least one question, numbers from 1 and non-empty texts.
    """
    r = F.from_json(column, RESULT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    q = F.col("_r")["questions"]
    unusable = F.coalesce(F.size(q), F.lit(0)) < 1
    unusable = unusable | F.exists(
        q, lambda x: (F.coalesce(x["order"], F.lit(0)) < 1) | (F.coalesce(x["questionText"], F.lit("")) == ""))
    error = (
        F.when(F.col("_r").isNull() | F.col("_r")["_bad"].isNotNull(), "PIPELINE_INVALID_OUTPUT")
        .when(F.col("_r")["status"] == "error", F.col("_r")["errorCode"])
        .when((F.coalesce(F.col("_r")["status"], F.lit("")) != "ok") | unusable, "PIPELINE_VALIDATION_ERROR")
    )
    return results.withColumn("_r", r).withColumn("error_code", error).select(
        *[c for c in results.columns if c != column],
        F.when(F.col("error_code").isNull(), "ok").otherwise("error").alias("status"),
        "error_code",
        F.when(F.col("error_code").isNotNull(), F.col("_r")["message"]).alias("message"),
        F.when(F.col("error_code").isNull(), F.col("_r")["usedPath"]).alias("used_path"),
        F.when(F.col("error_code").isNull(), F.col("_r")["extractionChars"]).alias("extraction_chars"),
        F.when(F.col("error_code").isNull(), q).alias("questions"),
    )


def extracted_items(read: DataFrame) -> DataFrame:
    """A5: questions of the successful results, with their 1-based position."""
    return read.filter("status = 'ok'").select("exam_id", F.posexplode("questions").alias("_i", "q")).select(
        "exam_id", (F.col("_i") + 1).alias("position"), F.col("q")["order"].alias("q_order"),
        F.col("q")["questionText"].alias("question_text"), F.col("q")["options"].alias("options"),
        F.col("q")["correctAnswer"].alias("explicit_answer"), F.col("q")["sourcePage"].alias("source_page"),
        F.col("q")["contextText"].alias("context_text"),
    )
