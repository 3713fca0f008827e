"""Text tier: what an external reader returned, joined, judged, chunked and merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.config import CHUNK_CHARS, MIN_EXTRACT_CHARS, PAGE_SEPARATOR
from examlens.functions.text import collapsed, trimmed
from examlens.operators.ledger import dealt

CHARS_PER_PAGE = 500
MIN_DIRECT_CHARS = 100
TASK_BYTES = 128 * 1024 * 1024


def join_pages(text_pages: DataFrame, ocr: bool = False) -> DataFrame:
    """the pages of a document as one text; blank pages of an OCR reader are skipped."""
    page = F.when(trimmed(F.col("text")) != "", F.struct("page", "text")) if ocr else F.struct("page", "text")
    separator = PAGE_SEPARATOR if ocr else "\n\n"
    listed = F.transform(F.array_sort(F.collect_list(page)), lambda p: p["text"])
    return text_pages.groupBy("doc_id").agg(F.array_join(listed, separator).alias("text"), F.count("*").alias("pages"))


def direct_confidence(text: Column) -> Column:
    """text found in the file itself is certain, or else not usable (null)."""
    return F.when(F.length(trimmed(collapsed(text))) > MIN_DIRECT_CHARS, F.lit(1.0))


def ocr_confidence(text: Column, pages: Column) -> Column:
    """share of the expected characters per page."""
    return F.least(F.length(text) / F.greatest(pages * CHARS_PER_PAGE, F.lit(1)), F.lit(1.0))


def document_confidence(text: Column) -> Column:
    """the same for a reader without pages; 0 for no text."""
    return F.when(F.length(text) > 0, F.least(F.length(text) / CHARS_PER_PAGE, F.lit(1.0))).otherwise(0.0)


def choose_text(read: DataFrame, min_chars: int = MIN_EXTRACT_CHARS) -> DataFrame:
    """the longer of two readings if the first is too short, and what to do with it.

    ``read(doc_id, filename, primary, secondary, fallback_reason)``.
    """
    first, second = F.coalesce("primary", F.lit("")), F.coalesce("secondary", F.lit(""))
    swap = (F.length(first) < min_chars) & (F.length(second) > F.length(first))
    text = F.when(swap, second).otherwise(first)
    n = F.length("text")
    usable = n >= min_chars
    # Fixed value: stand-in for a document without any text.
    stand_in = F.concat(F.lit("Arquivo: "), "filename", F.lit(". OCR não extraiu conteúdo suficiente."))
    return read.withColumn("text", text).select(
        "doc_id", usable.alias("usable"), n.alias("extraction_chars"),
        F.when(n > 0, F.col("text")).otherwise(stand_in).alias("source_text"),
        F.when(usable, F.col("fallback_reason")).otherwise(
            F.concat("fallback_reason", F.lit("|LOW_EXTRACTION_CHARS:"), n)).alias("fallback_reason"),
    )


def chunk_text(docs: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """greedy packing of pages (or lines) into chunks, no part split.

    One fold over the parts of a text finds where chunks begin; the separator
    after the first part of a later chunk is not counted. One row per chunk.
    """
    separator = F.when(F.contains("text", F.lit(PAGE_SEPARATOR)), PAGE_SEPARATOR).otherwise("\n")
    quoted = F.concat(F.lit("\\Q"), separator, F.lit("\\E"))
    parts = docs.select("doc_id", separator.alias("_sep"), F.split("text", quoted).alias("_parts"))
    state = "struct<n: int, size: int, starts: array<int>>"

    def step(acc: Column, p: Column) -> Column:
        over = (acc["n"] > 0) & (acc["size"] + F.length(p) > max_chars)
        return F.struct(
            (acc["n"] + 1).alias("n"),
            F.when(over, F.length(p)).otherwise(acc["size"] + F.length(p) + F.length("_sep")).cast("int").alias("size"),
            F.when(over, F.concat(acc["starts"], F.array(acc["n"]))).otherwise(acc["starts"]).alias("starts"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.array(F.lit(0)).alias("starts")).cast(state)
    packed = parts.withColumn("_starts", F.aggregate("_parts", start, lambda a, p: step(a, p).cast(state))["starts"])
    chunks = packed.select("doc_id", "_sep", "_parts", "_starts", F.posexplode("_starts").alias("chunk", "_from"))
    to = F.coalesce(F.get("_starts", F.col("chunk") + 1), F.size("_parts"))
    return chunks.select("doc_id", "chunk", F.call_function("array_join", F.slice("_parts", F.col("_from") + 1, to - F.col("_from")), F.col("_sep")).alias("text"))


def merge_chunk_questions(found: DataFrame) -> DataFrame:
    """over the chunks of a document, the first question of each number.

    ``found(exam_id, chunk, position, q_order, question_text, options)``.
    """
    rest = [c for c in found.columns if c not in ("exam_id", "q_order", "chunk", "position")]
    first = F.min_by(F.struct("chunk", "position", *rest), F.struct("chunk", "position")).alias("f")
    return found.groupBy("exam_id", "q_order").agg(first).select("exam_id", "q_order", "f.*")


def extract_with(
    files: DataFrame, fn: Callable[[str, bytes], tuple[str, float]], task_bytes: int = TASK_BYTES
) -> DataFrame:
    """The user's reader called per file, in tasks of ``task_bytes`` and at most one file more.

    An exception of the reader becomes that file's error, not the job's. The
    sizes are added up before, from ``length`` where the files have it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    text, confidence = fn(path, content)
                    rows.append((path, text, float(confidence), None))
                except Exception as exc:  # noqa: BLE001 - any reader failure is a row
                    rows.append((path, "", 0.0, f"{type(exc).__name__}:{exc}"))
            yield pd.DataFrame(rows, columns=["path", "text", "confidence", "error"])

    size = F.col("length") if "length" in files.columns else F.length("content")
    return dealt(files, "path", size, task_bytes).select("path", "content").mapInPandas(run, "path string, text string, confidence double, error string")
