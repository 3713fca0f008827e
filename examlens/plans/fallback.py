"""The fallback tier: exams the fast tier is not good enough for, read and structured by the user's functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.config import CHUNK_CHARS, MIN_EXTRACT_CHARS
from examlens.functions.text import error_category
from examlens.operators import enrich, quality, texttier
from examlens.operators.ledger import call_id, call_once
from examlens.plans.extract import NO_QUESTIONS, finish_rows
from examlens.sources.readers import QUESTION
from examlens.sources.sinks import materialize, replace_for_exams

# Instruction before the text, path of a text that was too short, error codes.
PROMPT = (
    "Extraia as questões objetivas do texto fornecido. Mantenha a numeração original e extraia as alternativas.\n\nTexto:\n"
)
SHORT_PATH = "gemini-structuring-fallback"
NO_FILE = "PIPELINE_FILE_NOT_FOUND"
FAILED = "PIPELINE_RUNTIME_ERROR"
INVALID = "PIPELINE_VALIDATION_ERROR"

_READ = "text string, confidence double"
_ANSWER = "response string"
_ITEMS = f"questions array<{QUESTION}>, _bad string"


@dataclass(frozen=True)
class Tier:
    """The user's functions: two readers of a file and one that structures a text.

    ``primary`` and ``secondary`` take the name and the bytes of a file and
    return text and confidence; ``structure`` takes a prompt and returns JSON
    text with ``questions``.
    """

    primary: Callable[[str, bytes], tuple[str, float]]
    secondary: Callable[[str, bytes], tuple[str, float]]
    structure: Callable[[str], str]
    path: str = "direct"
    min_chars: int = MIN_EXTRACT_CHARS
    max_chars: int = CHUNK_CHARS
    task_bytes: int = 128 * 1024 * 1024
    task_calls: int = 64


def read_texts(routed: DataFrame, files: DataFrame, tier: Tier, ledger: str, ask_again: bool = False) -> DataFrame:
    """One text per exam of the fallback tier; the second reader sees only the files the first read too little of.

    ``routed(exam_id, tier, fallback_reason)``, ``files(exam_id, filename, content)`` with one row per exam.
    An exam without a file, or whose reader failed, has an ``error``.
    """
    wanted = routed.filter("tier = 'fallback'").select("exam_id", "fallback_reason")
    there = files.join(wanted.select("exam_id"), "exam_id", "left_semi").filter(F.col("content").isNotNull())
    # What is asked is read several times: to size it, to deal it to tasks, and with the answers.
    there = materialize(there, "there")

    def read(source: DataFrame, name: str, fn: Callable) -> DataFrame:
        asked = source.select(
            "exam_id", call_id(F.lit(name), F.col("exam_id"), F.sha2("content", 256)).alias("call_id"), "filename", "content")
        return call_once(asked, fn, ["filename", "content"], _READ, f"{ledger}/{name}",
                         F.length("content"), tier.task_bytes, ask_again).drop("call_id")

    first = materialize(read(there, "primary", tier.primary), "primary")
    short = first.filter(F.col("error").isNull() & (F.length(F.coalesce("text", F.lit(""))) < tier.min_chars))
    second = read(there.join(short.select("exam_id"), "exam_id", "left_semi"), "secondary", tier.secondary)
    both = (
        wanted.join(files.filter(F.col("content").isNotNull()).select("exam_id", "filename"), "exam_id", "left")
        .join(first.select("exam_id", F.col("text").alias("primary"), F.col("confidence").alias("_c1"), F.col("error").alias("_e1")), "exam_id", "left")
        .join(second.select("exam_id", F.col("text").alias("secondary"), F.col("confidence").alias("_c2"), F.col("error").alias("_e2")), "exam_id", "left")
        .withColumn("error", F.when(F.col("filename").isNull(), F.lit(NO_FILE)).otherwise(
            F.concat(F.lit(f"{FAILED}:"), F.coalesce("_e1", "_e2"))))
    )
    both = materialize(both, "read")
    chosen = texttier.choose_text(both.select(F.col("exam_id").alias("doc_id"), "filename", "primary", "secondary", "fallback_reason"), tier.min_chars)
    # The second text was taken where it is longer than a first one that is too short.
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    swapped = (n("primary") < tier.min_chars) & (n("secondary") > n("primary"))
    confidence = both.select("exam_id", "error", F.when(swapped, F.col("_c2")).otherwise(F.col("_c1")).alias("read_confidence"))
    return confidence.join(chosen.withColumnRenamed("doc_id", "exam_id"), "exam_id").withColumn(
        "used_path", F.when(F.col("usable"), tier.path).otherwise(SHORT_PATH))


def structure_texts(texts: DataFrame, tier: Tier, ledger: str, ask_again: bool = False) -> DataFrame:
    """Every chunk of the texts with the questions found in it, or the error of its call."""
    chunks = texttier.chunk_text(texts.filter("error is null").select(
        F.col("exam_id").alias("doc_id"), F.col("source_text").alias("text")), tier.max_chars)
    asked = chunks.select(
        F.col("doc_id").alias("exam_id"), "chunk",
        call_id(F.lit("structure"), F.col("doc_id"), F.col("chunk"), F.sha2("text", 256)).alias("call_id"),
        F.concat(F.lit(PROMPT), "text").alias("prompt"))
    asked = materialize(asked, "asked")  # read several times, cut into chunks once
    structure = tier.structure
    answered = call_once(asked, lambda prompt: (structure(prompt),), ["prompt"], _ANSWER, f"{ledger}/structure",
                         target=tier.task_calls, ask_again=ask_again)
    r = F.from_json("response", _ITEMS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    unread = F.col("_r").isNull() | F.col("_r")["_bad"].isNotNull() | F.col("_r")["questions"].isNull()
    error = F.coalesce("error", F.when(unread, F.lit("ValueError:not a list of questions")))
    return answered.withColumn("_r", r).withColumn("error", error).select(
        "exam_id", "chunk", "error", F.when(F.col("error").isNull(), F.col("_r")["questions"]).alias("questions"))


def fallback_exams(
    routed: DataFrame, files: DataFrame, answer_keys: DataFrame, exams: DataFrame, tier: Tier, ledger: str,
    ask_again: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Stored rows of the fallback tier, and one outcome per exam sent there.

    Over the chunks of an exam the first question of each number counts. One
    chunk that failed, a question with a number below 1 or without text, or no
    question at all fails the whole exam; its rows are not stored.
    ``routed(exam_id, tier, acceptable, fallback_reason)`` comes from E4.
    """
    # Both come out of whole plans and are joined at several steps.
    routed = materialize(routed.select("exam_id", "tier", "acceptable", "fallback_reason"), "routed")
    answer_keys = materialize(answer_keys, "answers")
    texts = materialize(read_texts(routed, files, tier, ledger, ask_again), "texts")
    parts = materialize(structure_texts(texts, tier, ledger, ask_again), "parts")
    listed = parts.select("exam_id", "chunk", F.posexplode("questions").alias("position", "q"))
    found = texttier.merge_chunk_questions(listed.select(
        "exam_id", "chunk", "position", F.col("q")["order"].alias("q_order"),
        F.col("q")["questionText"].alias("question_text"), F.coalesce(F.col("q")["options"], F.array()).alias("options"),
        F.col("q")["correctAnswer"].alias("explicit_answer"), F.col("q")["sourcePage"].alias("source_page"),
        F.col("q")["contextText"].alias("context_text")))
    found = materialize(found, "found")
    bad = (F.coalesce("q_order", F.lit(0)) < 1) | (F.coalesce("question_text", F.lit("")) == "")
    failed = parts.groupBy("exam_id").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("chunk", "error"))).alias("_f"))
    broken = F.concat(F.lit(f"{FAILED}:GEMINI_EXTRACTION_FAILED on chunk "), F.col("_f")["chunk"] + 1, F.lit(": "), F.col("_f")["error"])
    checked = found.groupBy("exam_id").agg(F.bool_or(bad).alias("_bad"))
    verdict = (
        texts.join(failed, "exam_id", "left").join(checked, "exam_id", "left")
        .withColumn("error", F.coalesce("error", broken, F.when(F.coalesce("_bad", F.lit(True)), F.lit(INVALID))))
        .select("exam_id", "error", "used_path", "extraction_chars", "read_confidence", F.col("fallback_reason").alias("_reason"))
    )
    verdict = materialize(verdict, "verdict")
    sound = found.join(verdict.filter("error is null").select("exam_id"), "exam_id", "left_semi")
    rows = finish_rows(sound.drop("chunk", "position").withColumn("subject", F.lit(None).cast("string")), answer_keys, exams)
    rows = materialize(rows, "fallback_rows")
    kept = rows.groupBy("exam_id").agg(
        F.count("*").alias("inserted"), F.min_by("source_page", "q_order").alias("page_offset"))
    d = (
        routed.filter("tier = 'fallback'").join(verdict, "exam_id").join(kept, "exam_id", "left")
        .join(quality.questions_expected(exams, answer_keys), "exam_id", "left")
        .withColumns({
            "inserted": F.coalesce("inserted", F.lit(0)), "duration_ms": F.lit(None).cast("bigint"), "cost_usd": F.lit(0.0),
            "error": F.coalesce("error", F.when(F.col("inserted").isNull(), F.lit(NO_QUESTIONS))),
        })
    )
    failed = F.col("error").isNotNull()
    outcome = quality.parsing_health(d).select(
        "exam_id", "tier", "fallback_reason", F.when(failed, "failed").otherwise("reviewing").alias("status"),
        "inserted", "page_offset", "questions_expected", F.when(~failed, F.col("health")).alias("health"),
        "used_path", "extraction_chars", "read_confidence", F.col("_reason").alias("read_reason"),
        "error", error_category(F.col("error")).alias("error_message"))
    return rows, outcome


def stored_rows(target: DataFrame, rows: DataFrame, outcome: DataFrame) -> DataFrame:
    """The question table after the tier; exams it failed on before storing keep their old rows."""
    done = outcome.filter(F.col("error").isNull() | (F.col("error") == NO_QUESTIONS))
    return replace_for_exams(target, rows, done)


def outcome_events(outcome: DataFrame, at: Column) -> DataFrame:
    """What happened to the exams, as status events: each was started, then extracted or failed."""
    ended = F.when(F.col("error").isNull() | (F.col("error") == NO_QUESTIONS), "extracted").otherwise("fail")
    steps = F.array(
        F.struct(F.lit(0).cast("bigint").alias("event_id"), F.lit("start").alias("event")),
        F.struct(F.lit(1).cast("bigint").alias("event_id"), ended.alias("event")))
    return outcome.withColumn("e", F.explode(steps)).select(
        "exam_id", "e.event_id", "e.event", F.col("inserted").cast("int").alias("question_count"),
        F.col("error").alias("message"), at.alias("at"))
