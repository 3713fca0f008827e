"""Arriving uploads, answers, session events and status events as Structured Streaming jobs.

Each function takes a streaming DataFrame and starts or returns the stream.
Checkpoints and tables belong in the shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from examlens.functions.text import normalize_answer
from examlens.operators.quiz import score_percent
from examlens.sources.sinks import replace_in_table

POLL = "2 seconds"
_STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed_state(df: DataFrame) -> DataFrame:
    """Stateful processors keep several states per key, which needs the RocksDB store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_PROVIDER)
    return df


def stream_uploads(
    uploads: DataFrame, table: str, process: Callable[[DataFrame], DataFrame], checkpoint: str, buckets: int = 64
) -> DataStreamWriter:
    """Every arriving exam is processed once; a repeated upload replaces the earlier one.

    ``process`` maps exam rows to question rows (the extraction plan bound to its
    inputs). Replaying a batch after a failure gives the same table.
    """

    def batch(df: DataFrame, _: int) -> None:
        columns = [c for c in df.columns if c != "exam_id"]
        newest = df.groupBy("exam_id").agg(
            F.max_by(F.struct(*columns), F.col("uploaded_at")).alias("u")).select("exam_id", "u.*")
        replace_in_table(df.sparkSession, table, process(newest), newest, buckets)

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def first_answer_updates(attempts: DataFrame, lateness: str = "1 day", window: str = "1 day") -> DataFrame:
    """Earliest valid attempt per (session, question, event-time window), updated as it improves.

    The aggregate combines before the shuffle; windows older than the watermark
    are dropped from the state.
    """
    return (
        attempts.withColumn("answered_at", F.col("answered_at").cast("timestamp"))
        .withColumn("answer", normalize_answer(F.col("raw_answer")))
        .filter("answer is not null")
        .withWatermark("answered_at", lateness)
        .groupBy(F.window("answered_at", window), "session_id", "q_order")
        .agg(F.min(F.struct("answered_at", "event_id", "answer")).alias("f"))
        .select("session_id", "q_order", "f.*")
    )


def stream_answers(attempts: DataFrame, path: str, checkpoint: str, lateness: str = "1 day") -> DataStreamWriter:
    """Writes the updates of each micro-batch under its own number, so that a replay overwrites it."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    updates = first_answer_updates(attempts, lateness)
    return updates.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)


def read_first_answers(updates: DataFrame, sessions: DataFrame, questions: DataFrame) -> DataFrame:
    """The first answer per session and question out of all updates, for open sessions and known questions."""
    first = updates.groupBy("session_id", "q_order").agg(F.min(F.struct("answered_at", "event_id", "answer")).alias("f"))
    open_sessions = sessions.filter("finished_at is null").select("session_id", "exam_id")
    return (
        first.select("session_id", "q_order", "f.*")
        .join(open_sessions, "session_id")
        .join(questions.select("exam_id", "q_order").hint("merge"), ["exam_id", "q_order"], "left_semi")
        .withColumn("answered_at", F.col("answered_at").cast("timestamp_ntz"))
    )


class _Session(StatefulProcessor):
    """Counts of one session and the questions it has answered, kept until nothing has come for the time to live."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "answered int, correct int, last_us bigint, done boolean", ttlDurationMs=self.ttl_ms)
        self.seen = handle.getMapState("seen", "q_order int", "at bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first: dict[int, tuple] = {}
        end, total, rejected = None, 0, 0
        answered, correct, last, done = self.counts.get() if self.counts.exists() else (0, 0, 0, False)
        for f in rows:
            total = int(f["total_questions"].iloc[0])
            for n, us, event, ok, fin in zip(f["q_order"], f["at_us"], f["event_id"], f["is_correct"], f["is_finish"]):
                if fin:
                    end = min(end, us) if end is not None else us
                elif done:
                    rejected += 1
                elif n not in first or (us, event) < first[n][:2]:
                    first[n] = (us, event, bool(ok))
        if not done:
            for n, (us, _, ok) in sorted(first.items(), key=lambda x: x[1]):
                if done or (end is not None and us > end):
                    rejected += 1
                elif not self.seen.containsKey((int(n),)):
                    self.seen.updateValue((int(n),), (int(us),))
                    answered, correct, last = answered + 1, correct + int(ok), max(last, int(us))
                    done = answered >= total
            if end is not None and not done:
                done, last = True, int(end)
            self.counts.update((answered, correct, last, done))
            if done:
                self.seen.clear()
                yield pd.DataFrame({
                    "session_id": [key[0]], "answered": [answered], "correct": [correct],
                    "total_questions": [total], "finished_us": [last], "rejected": [rejected]})
                return
        if rejected:
            yield pd.DataFrame({
                "session_id": [key[0]], "answered": [None], "correct": [None],
                "total_questions": [total], "finished_us": [last], "rejected": [rejected]})

    def close(self) -> None:
        pass


def stream_sessions(answers: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A result per session when its last question is answered or a finish event comes.

    ``answers(session_id, q_order, event_id, answered_at, is_correct, is_finish,
    total_questions)``, already graded by a stream-static join. The state of a
    session is two counts and the numbers it answered; with ``ttl_ms`` it goes so long after its
    last change, for queries that run by processing time and not until the input
    is used up. Answers after the end are only counted as rejected.
    """
    rows = answers.select(
        "session_id", "q_order", "event_id", "total_questions",
        F.unix_micros(F.col("answered_at").cast("timestamp")).alias("at_us"),
        F.coalesce("is_correct", F.lit(False)).alias("is_correct"), F.coalesce("is_finish", F.lit(False)).alias("is_finish"))
    out = _keyed_state(rows).groupBy("session_id").transformWithStateInPandas(
        _Session(ttl_ms), "session_id bigint, answered int, correct int, total_questions int, finished_us bigint, rejected int",
        "append", "processingTime" if ttl_ms else "none")
    return out.select(
        "session_id", "answered", "correct", "total_questions",
        F.when(F.col("answered").isNotNull(), score_percent(F.col("correct"), F.col("total_questions"))).alias("score"),
        F.timestamp_micros("finished_us").alias("finished_at"), "rejected")


# Fixed values: (event, status) to the next status; where a count decides, the one without questions.
_NEXT = {
    ("start", "queued"): ("processing", "processing"),
    ("extracted", "processing"): ("reviewing", "failed"),
    ("fail", "processing"): ("failed", "failed"),
    ("publish", "reviewing"): ("completed", None),
    ("reprocess", "failed"): ("queued", "queued"),
}


class _Status(StatefulProcessor):
    """Status of one exam; emits each change in event order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string", ttlDurationMs=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status = self.status.get()[0] if self.status.exists() else "queued"
        events = sorted(
            (at, event_id, event, n) for f in rows
            for at, event_id, event, n in zip(f["at_us"], f["event_id"], f["event"], f["question_count"]))
        changes = []
        for at, _, event, n in events:
            nxt = _NEXT.get((event, status), (None, None))[0 if n > 0 else 1]
            if nxt and nxt != status:
                changes.append((key[0], status, nxt, nxt in ("completed", "failed"), at))
                status = nxt
        self.status.update((status,))
        if changes:
            yield pd.DataFrame(changes, columns=["exam_id", "old_status", "new_status", "terminal", "at_us"])

    def close(self) -> None:
        pass


def stream_status(events: DataFrame) -> DataFrame:
    """I4: feed of status changes; write it with ``trigger(processingTime=POLL)``.

    ``events(exam_id, event_id, event, question_count, at)``; a new exam is queued.
    """
    rows = events.select(
        "exam_id", "event_id", "event", F.coalesce("question_count", F.lit(0)).alias("question_count"),
        F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))
    out = _keyed_state(rows).groupBy("exam_id").transformWithStateInPandas(
        _Status(), "exam_id bigint, old_status string, new_status string, terminal boolean, at_us bigint", "append", "none")
    return out.select("exam_id", "old_status", "new_status", "terminal", F.timestamp_micros("at_us").alias("at"))


def due_batches(batches: DataFrame, now) -> DataFrame:
    """Deferred work whose day has come; the same on a stream and on a table."""
    return batches.filter(F.col("due_day") <= now)
