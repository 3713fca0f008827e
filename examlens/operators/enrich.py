"""Parsed questions to stored question rows: options, answers, subjects, hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from examlens.functions.text import LETTERS, collapsed, normalize_answer, trimmed
from examlens.templates import subject_ranges, templates


def to_question_rows(parsed: DataFrame) -> DataFrame:
    """Option columns to an array of "A) text", empty ones left out."""
    options = F.array_compact(F.array(*[
        F.when(F.col(x.lower()) != "", F.concat(F.lit(f"{x}) "), F.col(x.lower()))) for x in LETTERS
    ]))
    extra = [c for c in ("score", "position", "explicit_answer", "subject") if c in parsed.columns]
    return parsed.select(
        "exam_id", F.col("num").alias("q_order"), F.col("text").alias("question_text"),
        options.alias("options"), F.col("page").alias("source_page"), "context_text", *extra,
    )


def clean_questions(items: DataFrame) -> DataFrame:
    """E5: trimmed text and options; rows without text or with fewer than two options go.

    A question without a usable number takes its 1-based ``position`` in the exam.
    """
    options = F.array_distinct(F.filter(F.transform("options", lambda o: trimmed(o)), lambda o: o != ""))
    order = F.col("q_order")
    if "position" in items.columns:
        order = F.when(order > 0, order).otherwise(F.col("position"))
    return items.withColumns({
        "question_text": trimmed(F.col("question_text")), "options": options, "q_order": order,
    }).filter((F.col("question_text") != "") & (F.size("options") >= 2))


def apply_answer_key(questions: DataFrame, keys: DataFrame) -> DataFrame:
    """The key's letter wins over the one printed in the exam."""
    key = keys.select("exam_id", "q_order", F.col("answer").alias("_key"))
    explicit = normalize_answer(F.col("explicit_answer"))
    return questions.join(key, ["exam_id", "q_order"], "left").select(
        *questions.columns,
        F.coalesce("_key", explicit).alias("correct_answer"),
        F.col("_key").isNotNull().alias("key_matched"),
        F.coalesce(F.col("_key") != explicit, F.lit(False)).alias("answer_mismatch"),
    )


def answer_mismatches(keyed: DataFrame) -> DataFrame:
    """Questions whose printed answer contradicts the key."""
    return keyed.filter("answer_mismatch").select("exam_id", "q_order", "explicit_answer", "correct_answer")


def _ranges(df: DataFrame) -> DataFrame:
    """Four rows, one per template, with its ranges in order; fixed size, so broadcast."""
    r = subject_ranges(df.sparkSession).groupBy("template_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "subject", "first", "last"))).alias("_ranges")
    )
    return F.broadcast(r)


def _subject_at(order: Column) -> Column:
    hit = F.filter("_ranges", lambda r: order.between(r["first"], r["last"]))
    return F.get(hit, F.lit(0))["subject"]


def infer_subject(questions: DataFrame, exams: DataFrame) -> DataFrame:
    """Explicit subject, else the template subject whose range holds the number."""
    wanted = exams.select("exam_id", "template_id").join(_ranges(questions), "template_id", "left")
    explicit = F.nullif(trimmed(F.col("subject")), F.lit(""))
    return questions.join(wanted, "exam_id", "left").select(
        *[c for c in questions.columns if c != "subject"],
        F.coalesce(explicit, _subject_at(F.col("q_order"))).alias("subject"),
    )


def subject_roster(questions: DataFrame, exams: DataFrame, overrides: DataFrame) -> DataFrame:
    """Question numbers per template subject of every exam.

    ``overrides(exam_id, q_order, subject)`` moves a question to a subject by
    name; a name the template does not have puts it nowhere.
    """
    per_exam = exams.select("exam_id", "template_id")
    placed = (
        questions.select("exam_id", "q_order")
        .join(overrides.select("exam_id", "q_order", F.col("subject").alias("_moved")), ["exam_id", "q_order"], "left")
        .join(per_exam.join(_ranges(questions), "template_id"), "exam_id")
        .select("exam_id", "q_order", F.coalesce("_moved", _subject_at(F.col("q_order"))).alias("subject"))
        .filter("subject is not null")
        .groupBy("exam_id", "subject")
        .agg(F.array_sort(F.collect_list("q_order")).alias("questions"))
    )
    subjects = per_exam.join(
        F.broadcast(subject_ranges(questions.sparkSession).select("template_id", "seq", "subject", "area", "points_each", "has_shared_text")),
        "template_id",
    )
    none = F.array().cast("array<int>")
    return subjects.join(placed, ["exam_id", "subject"], "left").select(
        "exam_id", "template_id", "seq", "subject", "area", "points_each", "has_shared_text",
        F.coalesce("questions", none).alias("questions"),
    )


def template_catalog(uploads: DataFrame) -> DataFrame:
    """The templates, with how many of the given uploads name them."""
    used = with_known_template(uploads).groupBy("template_id").agg(F.count("*").alias("uploads"))  # four rows at most
    return templates(uploads.sparkSession).join(F.broadcast(used), "template_id", "left").select(
        "template_id", "label", "board", "total_questions", F.coalesce("uploads", F.lit(0)).alias("uploads")
    )


def with_known_template(uploads: DataFrame) -> DataFrame:
    """Uploads whose template id exists."""
    return uploads.join(F.broadcast(templates(uploads.sparkSession).select("template_id")), "template_id", "left_semi")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def content_hash(question_text: Column, options: Column) -> Column:
    """Hash of normalised text and options, whatever the order of the options.

    Only the Unicode normalisation leaves the JVM, once per row for all texts.
    A leading letter a-e is dropped from an option even without a separator.
    """
    parts = F.split(_nfkc(F.array_join(F.concat(F.array(question_text), options), "\x00")), "\x00")
    norm = F.transform(parts, lambda t: F.lower(trimmed(collapsed(t))))
    stripped = F.transform(
        F.slice(norm, F.lit(2), F.size(norm)), lambda o: F.regexp_replace(o, r"^[a-e]\s*[).:\-]?\s*", "")
    )
    return F.sha2(F.concat_ws("||", F.get(norm, F.lit(0)), F.array_join(F.array_sort(stripped), "||")), 256)
