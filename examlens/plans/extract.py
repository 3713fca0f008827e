"""The whole extraction: fragments and key lines in, keyed and scored questions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examlens.config import LAYOUT, PARSER, QUALITY, Layout, Parser, Quality
from examlens.functions.text import trimmed
from examlens.operators import enrich, keys, layout, quality, questions
from examlens.sources.sinks import materialize

# Fixed value: error of an exam that yields no usable question.
NO_QUESTIONS = "ZERO_VALID_QUESTIONS"


def parsed_rows(
    fragments: DataFrame, pages: DataFrame, exams: DataFrame,
    layout_cfg: Layout = LAYOUT, parser_cfg: Parser = PARSER,
) -> DataFrame:
    """Fragments of the wanted pages to question rows with their score."""
    # The page table is joined at several steps. The lines are read once, by the parser, which stores them with their kind.
    seen = materialize(layout.clip_page_range(pages, pages, exams), "pages")
    wanted = fragments.join(seen.select("exam_id", "page").hint("shuffle_hash"), ["exam_id", "page"], "left_semi")
    lines = layout.reconstruct_layout(wanted, seen, cfg=layout_cfg).select("exam_id", "page", "line_no", "text")
    parsed = questions.parse_questions(lines, seen, cfg=parser_cfg)
    return enrich.to_question_rows(parsed.withColumn("explicit_answer", F.lit(None).cast("string")).withColumn(
        "subject", F.lit(None).cast("string")))


def finish_rows(rows: DataFrame, answer_keys: DataFrame, exams: DataFrame) -> DataFrame:
    """The row builder shared by both tiers."""
    keyed = enrich.apply_answer_key(enrich.clean_questions(rows), answer_keys)
    placed = enrich.infer_subject(keyed, exams)
    return placed.withColumn("content_hash", enrich.content_hash(F.col("question_text"), F.col("options")))


def gate_rows(rows: DataFrame, force_fallback: bool = False, cfg: Quality = QUALITY) -> DataFrame:
    """Question rows with the verdict on their exam.

    The window holds the accepted questions of an exam, which have two-digit
    numbers; it spares a second evaluation of the parse.
    """
    w = Window.partitionBy("exam_id")
    short = F.length(trimmed(F.col("question_text"))) < cfg.min_chars
    d = rows.withColumns({
        "questions": F.count("*").over(w),
        "confidence": F.avg("score").over(w),
        "has_short_text": F.max(short).over(w),
    })
    return quality.route_exams(quality.quality_gate(d, cfg), force_fallback)


def extract_exams(
    fragments: DataFrame, pages: DataFrame, key_lines: DataFrame, exams: DataFrame,
    force_fallback: bool = False, cfg: Quality = QUALITY,
    layout_cfg: Layout = LAYOUT, parser_cfg: Parser = PARSER,
) -> DataFrame:
    """Stored question rows of the exams the fast tier is good enough for.

    ``exams(exam_id, booklet, template_id, has_key, page_start, page_end)``.
    """
    rows = parsed_rows(fragments, pages, exams, layout_cfg, parser_cfg)
    fast = gate_rows(rows, force_fallback, cfg).filter("tier = 'fastpath'").drop(
        "questions", "has_short_text", "reason", "acceptable", "tier", "fallback_reason")
    with_key = exams.filter("has_key")
    answers = keys.parse_answer_keys(key_lines.join(with_key.select("exam_id"), "exam_id", "left_semi"), with_key)
    return finish_rows(fast, answers, exams)


def exam_outcomes(
    rows: DataFrame, stored: DataFrame, answers: DataFrame, exams: DataFrame,
    force_fallback: bool = False, cfg: Quality = QUALITY,
) -> DataFrame:
    """One row per exam with tier, status, health and counts.

    ``rows`` are the parsed rows, ``stored`` the question rows that were kept.
    Exams sent to the fallback tier stay in processing until it answers.
    """
    routed = quality.route_exams(quality.quality_gate(quality.exam_confidence(rows, exams, cfg), cfg), force_fallback)
    kept = stored.groupBy("exam_id").agg(
        F.count("*").alias("inserted"), F.min_by("source_page", "q_order").alias("page_offset"))
    fast = F.col("tier") == "fastpath"
    d = (
        routed.join(kept, "exam_id", "left")
        .join(quality.questions_expected(exams, answers), "exam_id")
        .withColumns({
            "inserted": F.coalesce("inserted", F.lit(0)),
            "used_path": F.col("tier"),
            "duration_ms": F.lit(None).cast("bigint"),
            "cost_usd": F.lit(0.0),
        })
    )
    d = quality.parsing_health(d)
    status = F.when(fast & (F.col("inserted") > 0), "reviewing").when(fast, "failed").otherwise("processing")
    return d.select(
        "exam_id", "tier", "fallback_reason", status.alias("status"), "confidence", "inserted", "page_offset",
        "questions_expected", F.when(fast, F.col("health")).alias("health"),
        F.when(fast & (F.col("inserted") == 0), F.lit(NO_QUESTIONS)).alias("error"),
    )
