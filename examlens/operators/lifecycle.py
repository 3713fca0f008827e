"""Status changes and edits of stored exams and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlens.functions.text import error_category

EDITABLE = ("reviewing", "completed")


STATUSES = ("queued", "processing", "reviewing", "completed", "failed")
_DAY = 86_400_000_000


def _after(acc: Column, e: Column) -> Column:
    """The state of an exam after one event; ``changed`` tells whether any event so far changed it."""
    some = F.coalesce(e["question_count"], F.lit(0)) > 0
    is_ = lambda name, state: (e["event"] == name) & (acc["status"] == state)
    nothing = is_("extracted", "processing") & ~some
    new = (
        F.when(is_("start", "queued"), "processing")
        .when(is_("extracted", "processing"), F.when(some, "reviewing").otherwise("failed"))
        .when(is_("fail", "processing"), "failed")
        .when(is_("publish", "reviewing") & some, "completed")
        .when(is_("reprocess", "failed"), "queued")
    )
    code = (
        F.when(new.isNotNull() | is_("publish", "completed"), F.lit(None).cast("string"))
        .when(is_("publish", "reviewing"), "NO_QUESTIONS")
        .when(e["event"] == "reprocess", "EXAM_NOT_FAILED")
        .otherwise("INVALID_STATE")
    )
    message = error_category(F.when(nothing, "ZERO_VALID_QUESTIONS").otherwise(e["message"]))
    counted = new.isin("reviewing", "completed")
    return F.struct(
        F.coalesce(new, acc["status"]).alias("status"),
        e["event"].alias("event"),
        code.alias("code"),
        (acc["changed"] | new.isNotNull()).alias("changed"),
        F.when(new.isNull(), acc["error"]).when(new == "failed", message).alias("error"),
        F.when(counted | (new == "queued"), True).otherwise(acc["counted"]).alias("counted"),
        F.when(counted, e["question_count"]).when(new == "queued", None).otherwise(acc["total"]).cast("int").alias("total"),
        F.when(new.isin("completed", "failed"), e["at"]).otherwise(acc["ended"]).alias("ended"),
    )


def advance_status(exams: DataFrame, events: DataFrame, block_us: int = _DAY) -> DataFrame:
    """All events of each exam applied to its status, in order of time.

    ``events(exam_id, event_id, event, question_count, message, at)`` with events
    start, extracted, fail, publish and reprocess. A change the current status
    does not allow is answered with a code and leaves the exam as it is; the
    result has the last event and its code, and what all of them lead to.

    The events of a block of time become a table from status to status, so no
    task needs an exam's events all at once; the tables are then applied in order.
    """
    at_type = events.schema["at"].dataType.simpleString()
    blank = lambda status: F.struct(
        status.alias("status"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("code"), F.lit(False).alias("changed"),
        F.lit(None).cast("string").alias("error"), F.lit(False).alias("counted"), F.lit(None).cast("int").alias("total"), F.lit(None).cast(at_type).alias("ended"))
    block = F.expr(f"unix_micros(cast(at as timestamp)) div {block_us}")
    listed = F.array_sort(F.collect_list(F.struct("at", "event_id", "event", "question_count", "message")))
    tables = events.groupBy("exam_id", block.alias("_block")).agg(listed.alias("_es")).select(
        "exam_id", F.struct("_block", F.array(*[F.aggregate("_es", blank(F.lit(s)), _after) for s in STATUSES]).alias("to")).alias("_b"))

    def apply(acc: Column, b: Column) -> Column:
        to = F.get(b["to"], F.array_position(F.array(*map(F.lit, STATUSES)), acc["status"]).cast("int") - 1)
        return F.struct(
            F.coalesce(to["status"], acc["status"]).alias("status"), F.coalesce(to["event"], b["to"][0]["event"]).alias("event"),
            F.when(to.isNull(), "INVALID_STATE").otherwise(to["code"]).alias("code"),
            (acc["changed"] | F.coalesce(to["changed"], F.lit(False))).alias("changed"),
            F.when(F.coalesce(to["changed"], F.lit(False)), to["error"]).otherwise(acc["error"]).alias("error"),
            (acc["counted"] | F.coalesce(to["counted"], F.lit(False))).alias("counted"),
            F.when(F.coalesce(to["counted"], F.lit(False)), to["total"]).otherwise(acc["total"]).alias("total"),
            F.coalesce(to["ended"], acc["ended"]).alias("ended"))

    per_exam = tables.groupBy("exam_id").agg(F.array_sort(F.collect_list("_b")).alias("_bs"))
    joined = per_exam.join(exams.select("exam_id", "status", "total_questions"), "exam_id", "left")
    end = F.col("_e")
    return joined.withColumn("_e", F.aggregate("_bs", blank(F.col("status")), apply)).select(
        "exam_id", end["event"].alias("event"), F.col("status").alias("old_status"), end["status"].alias("new_status"),
        F.when(F.col("status").isNull(), "EXAM_NOT_FOUND").otherwise(end["code"]).alias("reject_code"), end["error"].alias("error_message"),
        F.when(end["counted"], end["total"]).otherwise(F.col("total_questions")).alias("total_questions"), end["ended"].alias("processed_at"),
    )


def _editable(exams: DataFrame) -> DataFrame:
    return exams.filter(F.col("status").isin(*EDITABLE)).select("exam_id")


def patch_questions(questions: DataFrame, patches: DataFrame, exams: DataFrame) -> DataFrame:
    """Supplied fields replace stored ones, in exams under review or published.

    A null field is one that was not supplied; ``has_context`` tells an explicit
    null context from none.
    """
    fields = [c for c in ("question_text", "options", "subject", "correct_answer") if c in patches.columns]
    p = patches.join(_editable(exams), "exam_id", "left_semi").select(
        "exam_id", "q_order", *[F.col(c).alias(f"_{c}") for c in fields],
        F.col("has_context").alias("_has"), F.col("context_text").alias("_context_text"),
    )
    changed = {c: F.coalesce(f"_{c}", c).alias(c) for c in fields}
    changed["context_text"] = F.when(F.col("_has"), F.col("_context_text")).otherwise(F.col("context_text")).alias("context_text")
    return questions.join(p, ["exam_id", "q_order"], "left").select(*[changed.get(c, F.col(c)) for c in questions.columns])


def drop_questions(questions: DataFrame, ids: DataFrame, exams: DataFrame) -> DataFrame:
    """Single questions removed, under the same guard."""
    gone = ids.join(_editable(exams), "exam_id", "left_semi").select("exam_id", "q_order")
    return questions.join(gone, ["exam_id", "q_order"], "left_anti")


def delete_cascade(
    exams: DataFrame, questions: DataFrame, sessions: DataFrame, answers: DataFrame, ids: DataFrame
) -> dict[str, DataFrame]:
    """Removing exams removes their questions, sessions and answers."""
    gone_sessions = sessions.join(ids, "exam_id", "left_semi").select("session_id")
    return {
        "exams": exams.join(ids, "exam_id", "left_anti"),
        "questions": questions.join(ids, "exam_id", "left_anti"),
        "sessions": sessions.join(ids, "exam_id", "left_anti"),
        "answers": answers.join(gone_sessions, "session_id", "left_anti"),
    }
