"""Streaming: the arriving rows are read as file streams of the given tables.

Each query runs its stream to the end of the available files and returns what
it wrote, so that it can be compared with the batch operators.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from examlens.operators import quiz as z
from examlens.plans import extract as px
from examlens.registry import classify as rc
from examlens.registry import enrich as re_
from examlens.registry import quiz as rz
from examlens.registry.fixtures import view, with_views
from examlens.sources.sinks import ensure_checkpoint_dir, read_exam_table, write_exam_table
from examlens.streaming import streams as st


def _place(s, name):
    return f"{ensure_checkpoint_dir(s)}/examlens/{name}-{uuid.uuid4().hex}"


def _stream(s, df, files=1):
    """A staged view as a stream of its files."""
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _table_stream(s, d, name, schema):
    return s.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def _answers(s, d):
    base = _place(s, "stream-answers")
    _finish(st.stream_answers(_stream(s, view(s, d, "fx_answers")), f"{base}/updates", f"{base}/checkpoint", "3650 days"))
    updates = s.read.parquet(f"{base}/updates").drop("batch")
    known = rz._known(s, d)
    return z.grade_answers(st.read_first_answers(updates, rz._sessions(s, d), known), known)


def _session_stream(s, d):
    q = rz._known(s, d)
    sessions = view(s, d, "fx_sessions").filter("finished_at is null").select("session_id", "total_questions")
    attempts = _stream(s, view(s, d, "fx_answers"), 100)
    known = attempts.join(q.select("exam_id", "q_order").hint("merge"), ["exam_id", "q_order"], "left_semi")  # an unknown question is no answer
    graded = z.grade_answers(
        known.withColumn("answer", st.normalize_answer(F.col("raw_answer"))).filter("answer is not null"), q)
    return graded.join(sessions, "session_id").withColumn("is_finish", F.lit(False))


def _sessions(s, d):
    base = _place(s, "stream-sessions")
    out = st.stream_sessions(_session_stream(s, d))
    _finish(out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"))
    done = s.read.parquet(f"{base}/out").filter("answered is not null")
    return done.select("session_id", "answered", "correct", "total_questions", "score")


def _status(s, d):
    base = _place(s, "stream-status")
    ev = _table_stream(s, d, "events", s.read.parquet(f"{d}/events.parquet").schema)
    kind = F.array(*[F.lit(x) for x in ("start", "extracted", "fail", "publish", "reprocess")])
    events = ev.select(
        F.col("user_id").alias("exam_id"), "event_id", F.get(kind, (F.col("event_id") % 5).cast("int")).alias("event"),
        (F.col("event_id") % 3).cast("int").alias("question_count"), F.col("ts").alias("at"))
    out = st.stream_status(events)
    _finish(out.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint"))
    return s.read.parquet(f"{base}/out").select("exam_id", "old_status", "new_status", "terminal", F.col("at").cast("timestamp_ntz").alias("at"))


def _uploads(s, d):
    base = _place(s, "stream-uploads")
    fr, pg, kl, ex = re_._extract_inputs(s, d)
    arriving = _stream(s, ex).withColumn("uploaded_at", F.lit(0))

    def process(exams):
        only = lambda df: df.join(exams.select("exam_id"), "exam_id", "left_semi")
        return px.extract_exams(only(fr), only(pg), only(kl), exams.drop("uploaded_at"))

    empty = process(ex.limit(0).withColumn("uploaded_at", F.lit(0)))
    write_exam_table(s.createDataFrame([], empty.schema), f"{base}/questions", 8)
    _finish(st.stream_uploads(arriving, f"{base}/questions", process, f"{base}/checkpoint", 8))
    got = read_exam_table(s, f"{base}/questions", empty.schema)
    return re_._flat(got).select(
        "exam_id", "q_order", "question_text", "options", "source_page", "context_text", "score",
        "correct_answer", "key_matched", "subject", "content_hash", "confidence")


QUERIES = {
    "stream_uploads": _uploads,
    "stream_answers": _answers,
    "stream_sessions": _sessions,
    "stream_status": _status,
    "due_batches": lambda s, d: st.due_batches(rc._budget(s, d), F.lit("2024-01-02")),
}

_STATUS = """with recursive ev as (select user_id exam_id, ['start','extracted','fail','publish','reprocess'][event_id%5+1] event, event_id%3 n, ts, row_number() over (partition by user_id order by ts, event_id) i from events),
 walk(exam_id,i,old_status,new_status,ts) as (
 select exam_id, 0, null::varchar, 'queued', null::timestamp from (select distinct exam_id from ev) x union all
 select e.exam_id, e.i, w.new_status, case when e.event='start' and w.new_status='queued' then 'processing' when e.event='extracted' and w.new_status='processing' then case when e.n>0 then 'reviewing' else 'failed' end when e.event='fail' and w.new_status='processing' then 'failed' when e.event='publish' and w.new_status='reviewing' and e.n>0 then 'completed' when e.event='reprocess' and w.new_status='failed' then 'queued' else w.new_status end, e.ts
 from walk w join ev e on e.exam_id=w.exam_id and e.i=w.i+1)
 select exam_id, old_status, new_status, new_status in ('completed','failed') terminal, ts as at from walk where i>0 and old_status<>new_status"""

ORACLES = {
    "stream_uploads": re_.ORACLES["extract_exams"],
    "stream_answers": rz.ORACLES["grade_answers"],
    "stream_sessions": with_views(*rz.STEPS,
        "select s.session_id, cast(a as int) answered, cast(c as int) correct, s.total_questions, round(c/s.total_questions*100,2) score from sess s join cnt on cnt.session_id=s.session_id where s.finished_at is null and a>=s.total_questions"),
    "stream_status": _STATUS.replace(" as at from", ' as "at" from'),
    "due_batches": rc._o("select * from b where due_day<='2024-01-02'", *rc.QUEUE, ("b", rc.ORACLES["daily_budget"].split("\n")[-1])),
}
