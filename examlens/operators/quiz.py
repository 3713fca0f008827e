"""Quiz sessions in batch: readiness, answers, grading, results, review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.text import MSG_NO_EXPLANATION, normalize_answer, trimmed

GOOD_PERCENT = 70
PREVIEW_CHARS = 160
REVIEW_BELOW = 80


def _round(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def score_percent(correct: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(correct / total * 100, 2)).otherwise(0.0)


def quiz_ready(requests: DataFrame, exams: DataFrame, questions: DataFrame) -> DataFrame:
    """H1: why each requested exam cannot be played, or its question count."""
    n = questions.groupBy("exam_id").agg(F.count("*").alias("n"))
    s = F.col("status")
    code = (
        F.when(s.isNull(), "EXAM_NOT_FOUND")
        .when(s.isin("queued", "processing"), "EXAM_NOT_READY")
        .when(s == "failed", "EXAM_FAILED")
        .when(F.coalesce("n", F.lit(0)) < 1, "QUESTIONS_NOT_FOUND")
    )
    d = requests.join(exams.select("exam_id", "status"), "exam_id", "left").join(n, "exam_id", "left")
    d = d.withColumn("reject_code", code)
    return d.select(*requests.columns, "reject_code", F.when(F.col("reject_code").isNull(), F.col("n")).alias("total_questions"))


def start_sessions(ready: DataFrame) -> DataFrame:
    """H2: sessions of the playable exams, with the question count at the start."""
    return ready.filter("reject_code is null").select(
        "session_id", "exam_id", F.col("total_questions").cast("int").alias("total_questions"), "started_at")


def accept_answers(attempts: DataFrame, sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """H3: verdict on every attempt; the first valid one per session and question counts.

    The first attempt is found by an aggregate, which combines before the
    shuffle, and joined back, so that a session with very many attempts is never
    sorted in one task.
    """
    s = sessions.select("session_id", F.col("exam_id").alias("_exam"), F.col("finished_at").alias("_done"))
    q = questions.select(F.col("exam_id").alias("_exam"), "q_order", F.lit(True).alias("_known"))
    d = (
        attempts.withColumn("answer", normalize_answer(F.col("raw_answer")))
        .join(s, "session_id", "left")
        .join(q.hint("merge"), ["_exam", "q_order"], "left")
    )
    code = (
        F.when(F.col("answer").isNull(), "INVALID_INPUT")
        .when(F.col("_exam").isNull(), "SESSION_NOT_FOUND")
        .when(F.col("_done").isNotNull(), "SESSION_FINISHED")
        .when(F.col("_known").isNull(), "QUESTION_NOT_FOUND")
    )
    d = d.withColumn("_code", code)
    first = d.filter("_code is null").groupBy("session_id", "q_order").agg(
        F.min(F.struct("answered_at", "event_id"))["event_id"].alias("_first"))
    again = F.when(F.col("_code").isNull() & (F.col("_first") != F.col("event_id")), "QUESTION_ALREADY_ANSWERED")
    return d.join(first, ["session_id", "q_order"], "left").select(
        "event_id", "session_id", F.col("_exam").alias("exam_id"), "q_order", "answer", "answered_at",
        F.coalesce("_code", again).alias("reject_code"),
    )


def first_answers(attempts: DataFrame, sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """H3: the accepted answers only, by aggregation before any join with questions."""
    open_sessions = sessions.filter("finished_at is null").select("session_id", F.col("exam_id").alias("_exam"))
    first = (
        attempts.withColumn("answer", normalize_answer(F.col("raw_answer")))
        .filter("answer is not null")
        .groupBy("session_id", "q_order")
        .agg(F.min(F.struct("answered_at", "event_id", "answer")).alias("f"))
    )
    return (
        first.join(open_sessions, "session_id")
        .select("session_id", F.col("_exam").alias("exam_id"), "q_order", "f.*")
        .join(questions.select("exam_id", "q_order").hint("merge"), ["exam_id", "q_order"], "left_semi")
    )


def upsert_answers(attempts: DataFrame) -> DataFrame:
    """H5: the last write per session and question."""
    last = F.max(F.struct("answered_at", "event_id", "raw_answer")).alias("l")
    return attempts.groupBy("session_id", "q_order").agg(last).select("session_id", "q_order", "l.*")


def grade_answers(accepted: DataFrame, questions: DataFrame) -> DataFrame:
    """H4: an answer is right if it equals the key; without a key it is wrong."""
    key = questions.select("exam_id", "q_order", normalize_answer(F.col("correct_answer")).alias("correct_answer"))
    return accepted.join(key.hint("merge"), ["exam_id", "q_order"], "left").withColumn(
        "is_correct", F.coalesce(F.col("answer") == F.col("correct_answer"), F.lit(False)))


def _counts(graded: DataFrame) -> DataFrame:
    return graded.groupBy("session_id").agg(F.count("*").alias("_answered"), F.count_if("is_correct").alias("_correct"))


def finish_sessions(sessions: DataFrame, graded: DataFrame, now: Column, only_complete: bool = False) -> DataFrame:
    """H6: counts and score at the end; finished sessions stay as they are.

    With ``only_complete`` (H7) only sessions with every question answered end.
    """
    zero = F.lit(0).cast("bigint")
    has = lambda c, kind: F.col(c) if c in sessions.columns else F.lit(None).cast(kind)
    d = sessions.withColumns({
        "_old_correct": has("correct_answers", "bigint"), "_old_score": has("score", "double"),
    }).join(_counts(graded), "session_id", "left")
    answered, correct = F.coalesce("_answered", zero), F.coalesce("_correct", zero)
    ending = F.col("finished_at").isNull()
    if only_complete:
        ending = ending & (answered >= F.col("total_questions"))
    return d.select(
        "session_id", "exam_id", "total_questions", answered.alias("answered"),
        F.when(ending, correct).otherwise(F.coalesce("_old_correct", zero)).alias("correct"),
        F.when(ending, score_percent(correct, F.col("total_questions"))).otherwise(F.col("_old_score")).alias("score"),
        F.when(ending, now).otherwise(F.col("finished_at")).alias("finished_at"),
    )


def auto_finalize(sessions: DataFrame, graded: DataFrame, now: Column) -> DataFrame:
    """H7: a fully answered session ends by itself."""
    return finish_sessions(sessions, graded, now, only_complete=True)


def session_results(finished: DataFrame, graded: DataFrame, questions: DataFrame) -> DataFrame:
    """H8: the answers of each session with the right one, in answer order per session.

    ``position`` of an answer is not computed: rows are sorted within partitions.
    """
    text = questions.select("exam_id", "q_order", "question_text")
    head = finished.select(
        "session_id", F.coalesce("score", score_percent(F.col("correct"), F.col("total_questions"))).alias("score"),
        "correct", F.col("total_questions").alias("total"))
    return (
        graded.join(text, ["exam_id", "q_order"])
        .join(head, "session_id")
        .select("session_id", "score", "correct", "total", "q_order", "question_text", "answer", "is_correct",
                "correct_answer", "answered_at")
        .sortWithinPartitions("session_id", "answered_at")
    )


def answer_states(graded: DataFrame, options: DataFrame) -> DataFrame:
    """H9: how each option of an answered question is shown; ``options(exam_id, q_order, options)``."""
    rows = graded.join(options, ["exam_id", "q_order"]).select(
        "session_id", "q_order", "answer", "is_correct", "correct_answer", F.explode("options").alias("option"))
    letter = F.upper(F.substring(trimmed(F.col("option")), 1, 1))
    chosen = F.col("letter") == F.col("answer")
    return rows.withColumn("letter", letter).select(
        "session_id", "q_order", "letter",
        F.when(chosen & F.col("is_correct"), "correct").when(chosen, "incorrect")
        .when(F.col("letter") == F.col("correct_answer"), "revealed-correct").otherwise("idle").alias("state"),
    )


def session_summary(finished: DataFrame) -> DataFrame:
    """Progress and rounded score."""
    pct = _round(F.coalesce("score", F.lit(0.0)))
    return finished.select(
        "session_id", _round(F.col("answered") / F.col("total_questions") * 100).alias("progress"),
        pct.alias("percent"), (pct >= GOOD_PERCENT).alias("good"))


def question_preview(c: Column) -> Column:
    """The first characters of a question."""
    return F.concat(F.substring(c, 1, PREVIEW_CHARS), F.lit("..."))


def list_exams(exams: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; ``limit`` makes it a top-k."""
    d = exams.select("exam_id", "title", "status", "created_at", "total_questions").orderBy(
        F.col("created_at").desc(), "exam_id")
    return d if limit is None else d.limit(limit)


def list_questions(exams: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions of the exams that can be shown, by number."""
    shown = exams.filter(F.col("status").isin("reviewing", "completed")).select("exam_id")
    return questions.join(shown, "exam_id", "left_semi").orderBy("exam_id", "q_order", "question_id")


def review_queue(questions: DataFrame, exams: DataFrame, threshold: float = REVIEW_BELOW) -> DataFrame:
    """Weak questions, with the question count of their exam."""
    n = questions.groupBy("exam_id").agg(F.count("*").alias("_n"))
    total = exams.select("exam_id", "total_questions").join(n, "exam_id", "left").select(
        "exam_id", F.coalesce(F.col("total_questions").cast("bigint"), "_n").alias("exam_questions"))
    weak = questions.filter(F.col("confidence") < threshold)
    return weak.join(total, "exam_id", "left").select(
        "exam_id", "q_order", _round(F.col("confidence")).alias("percent"), "exam_questions")


def question_explanations(questions: DataFrame) -> DataFrame:
    """Explanation or the text shown for want of one."""
    return questions.select("question_id", F.coalesce("explanation", F.lit(MSG_NO_EXPLANATION)).alias("explanation"))


def exam_status_view(exams: DataFrame) -> DataFrame:
    """Status fields, and whether there is a key file."""
    return exams.select(
        "exam_id", "status", "error_message", "total_questions", "page_offset", "page_start", "page_end",
        "booklet", "template_id", F.col("key_path").isNotNull().alias("has_key"))
