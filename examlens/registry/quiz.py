"""Quiz sessions: registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.functions import text as t
from examlens.operators import quiz as z
from examlens.registry.fixtures import table, view, with_views

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _q(s, d):
    return view(s, d, "fx_questions")


def _attempts(s, d):
    return view(s, d, "fx_answers")


def _sessions(s, d):
    return view(s, d, "fx_sessions")


def _known(s, d):
    """The questions with their keys; their texts are neither graded nor derived for it."""
    return view(s, d, "fx_questions", "exam_id", "q_order", "correct_answer")


def _graded(s, d):
    return z.grade_answers(z.first_answers(_attempts(s, d), _sessions(s, d), _known(s, d)), _known(s, d))


def _finished(s, d):
    return z.finish_sessions(_sessions(s, d), _graded(s, d), _now())


def _requests(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").alias("exam_id")).agg(
        F.min("ts").alias("started_at"), F.min("event_id").alias("session_id"))


def _ready(s, d):
    return z.quiz_ready(_requests(s, d), view(s, d, "fx_exams"), _q(s, d))


def _options(s, d):
    letters = [F.concat(F.lit(f"{x}) "), F.coalesce(f"o{x.lower()}", F.lit(""))) for x in "ABCDE"]
    return _q(s, d).select("exam_id", "q_order", F.array(*letters).alias("options"))


def _exam_files(s, d):
    e = view(s, d, "fx_exams").select("exam_id", "status", "total_questions")
    i = view(s, d, "fx_exam_info")
    return e.join(i, "exam_id").withColumns({
        "error_message": F.when(F.col("status") == "failed", "x"), "page_offset": F.lit(1),
        "key_path": F.when(F.col("has_key"), F.concat(F.lit("keys/"), F.col("exam_id")))})


def _dates(s, d):
    o = table(s, d, "orders")
    day = F.date_format("o_orderdate", "ddMMyyyy")
    m = F.col("o_orderkey") % 4
    return o.select("o_orderkey", F.when(m == 0, day).when(m == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
                    .when(m == 2, F.substring(day, 1, 3)).otherwise(F.concat(day, F.lit("99"))).alias("typed"))


QUERIES = {
    "quiz_ready": _ready,
    "start_sessions": lambda s, d: z.start_sessions(_ready(s, d)),
    "accept_answers": lambda s, d: z.accept_answers(_attempts(s, d), _sessions(s, d), _known(s, d)),
    "first_answers": lambda s, d: z.first_answers(_attempts(s, d), _sessions(s, d), _known(s, d)),
    "grade_answers": _graded,
    "upsert_answers": lambda s, d: z.upsert_answers(_attempts(s, d)),
    "finish_sessions": _finished,
    "auto_finalize": lambda s, d: z.auto_finalize(_sessions(s, d), _graded(s, d), _now()),
    "session_results": lambda s, d: z.session_results(_finished(s, d), _graded(s, d), _q(s, d)),
    "answer_states": lambda s, d: z.answer_states(_graded(s, d), _options(s, d)),
    "session_summary": lambda s, d: z.session_summary(_finished(s, d)),
    "question_preview": lambda s, d: _q(s, d).select("question_id", z.question_preview(F.col("question_text")).alias("preview")),
    "list_exams": lambda s, d: z.list_exams(view(s, d, "fx_exams")),
    "list_exams_top": lambda s, d: z.list_exams(view(s, d, "fx_exams"), 20),
    "list_questions": lambda s, d: z.list_questions(view(s, d, "fx_exams"), _q(s, d)).select(
        "question_id", "exam_id", "q_order", "question_text", "source_page", "subject", "classification_status", "confidence", "correct_answer"),
    "review_queue": lambda s, d: z.review_queue(_q(s, d), view(s, d, "fx_exams")),
    "normalize_exam_date": lambda s, d: _dates(s, d).select("o_orderkey", t.normalize_exam_date(F.col("typed")).alias("exam_date")),
    "question_explanations": lambda s, d: z.question_explanations(_q(s, d)),
    "exam_status_view": lambda s, d: z.exam_status_view(_exam_files(s, d)),
}

_A = r"nullif(regexp_extract(upper(trim({c})),'^([A-E])(?:$|[).:\-\s])',1),'')"
STEPS = [
    ("sess", "select * from fx_sessions"),
    ("known", "select * from fx_questions"),
    ("tried", f"select a.event_id, a.session_id, s.exam_id, a.q_order, {_A.format(c='a.raw_answer')} answer, a.answered_at, s.session_id is not null has_s, s.finished_at, k.q_order is not null has_q from fx_answers a left join sess s on s.session_id=a.session_id left join known k on k.exam_id=s.exam_id and k.q_order=a.q_order"),
    ("coded", "select *, case when answer is null then 'INVALID_INPUT' when not has_s then 'SESSION_NOT_FOUND' when finished_at is not null then 'SESSION_FINISHED' when not has_q then 'QUESTION_NOT_FOUND' end code from tried"),
    ("verdict", "select *, coalesce(code, case when row_number() over (partition by session_id, q_order, code is null order by answered_at, event_id)>1 then 'QUESTION_ALREADY_ANSWERED' end) reject_code from coded"),
    ("firsts", "select session_id, exam_id, q_order, answered_at, event_id, answer from verdict where reject_code is null"),
    ("graded", f"select f.*, {_A.format(c='k.correct_answer')} correct_answer, coalesce(f.answer={_A.format(c='k.correct_answer')},false) is_correct from firsts f join known k on k.exam_id=f.exam_id and k.q_order=f.q_order"),
    ("cnt", "select session_id, count(*) a, count(*) filter (where is_correct) c from graded group by session_id"),
]


def _finish(cond: str) -> str:
    return f"""select s.session_id, s.exam_id, s.total_questions, coalesce(a,0) answered, case when {cond} then coalesce(c,0) else 0 end correct,
 case when {cond} then case when s.total_questions>0 then round(coalesce(c,0)/s.total_questions*100,2) else 0 end end score, case when {cond} then timestamp '{NOW}' else s.finished_at end finished_at from sess s left join cnt on cnt.session_id=s.session_id"""


_FIN = ("fin", _finish("s.finished_at is null"))
_READY = """select r.exam_id, r.started_at, r.session_id, code reject_code, case when code is null then n end total_questions from (
 select r.*, n, case when x.status is null then 'EXAM_NOT_FOUND' when x.status in ('queued','processing') then 'EXAM_NOT_READY' when x.status='failed' then 'EXAM_FAILED' when coalesce(n,0)<1 then 'QUESTIONS_NOT_FOUND' end code
 from (select user_id exam_id, min(ts) started_at, min(event_id) session_id from events group by user_id) r left join fx_exams x on x.exam_id=r.exam_id left join (select exam_id, count(*) n from fx_questions group by exam_id) q on q.exam_id=r.exam_id) r"""


def _o(select, *more):
    return with_views(*STEPS, *more, select)


ORACLES = {
    "quiz_ready": with_views(_READY),
    "start_sessions": with_views(("ready", _READY), "select session_id, exam_id, cast(total_questions as int) total_questions, started_at from ready where reject_code is null"),
    "accept_answers": _o("select event_id, session_id, exam_id, q_order, answer, answered_at, reject_code from verdict"),
    "first_answers": _o("select * from firsts"),
    "grade_answers": _o("select * from graded"),
    "upsert_answers": with_views("select session_id, q_order, answered_at, event_id, raw_answer from (select *, row_number() over (partition by session_id, q_order order by answered_at desc, event_id desc) rn from fx_answers) t where rn=1"),
    "finish_sessions": _o("select * from fin", _FIN),
    "auto_finalize": _o(_finish("s.finished_at is null and coalesce(a,0)>=s.total_questions")),
    "session_results": _o("select g.session_id, coalesce(f.score, case when f.total_questions>0 then round(f.correct/f.total_questions*100,2) else 0 end) score, f.correct, f.total_questions total, g.q_order, k.question_text, g.answer, g.is_correct, g.correct_answer, g.answered_at from graded g join known k on k.exam_id=g.exam_id and k.q_order=g.q_order join fin f on f.session_id=g.session_id", _FIN),
    "answer_states": _o("select g.session_id, g.q_order, l letter, case when l=g.answer and g.is_correct then 'correct' when l=g.answer then 'incorrect' when l=g.correct_answer then 'revealed-correct' else 'idle' end state from graded g join fx_questions q on q.exam_id=g.exam_id and q.q_order=g.q_order cross join (select unnest(['A','B','C','D','E']) l) x"),
    "session_summary": _o("select session_id, cast(floor(answered/total_questions*100+0.5) as int) progress, cast(floor(coalesce(score,0)+0.5) as int) percent, floor(coalesce(score,0)+0.5)>=70 good from fin", _FIN),
    "question_preview": with_views("select question_id, substr(question_text,1,160)||'...' preview from fx_questions"),
    "list_exams": with_views("select exam_id, title, status, created_at, total_questions from fx_exams"),
    "list_exams_top": with_views("select exam_id, title, status, created_at, total_questions from fx_exams order by created_at desc, exam_id limit 20"),
    "list_questions": with_views("select question_id, exam_id, q_order, question_text, source_page, subject, classification_status, confidence, correct_answer from fx_questions where exam_id in (select exam_id from fx_exams where status in ('reviewing','completed'))"),
    "review_queue": with_views("select q.exam_id, q.q_order, cast(floor(q.confidence+0.5) as int) percent, case when x.exam_id is not null then coalesce(cast(x.total_questions as bigint), (select count(*) from fx_questions y where y.exam_id=q.exam_id)) end exam_questions from fx_questions q left join fx_exams x on x.exam_id=q.exam_id where q.confidence<80"),
    "normalize_exam_date": "select o_orderkey, case when o_orderkey%4=2 then substr(strftime(o_orderdate,'%d%m%Y'),1,2)||'/'||substr(strftime(o_orderdate,'%d%m%Y'),3,1) else strftime(o_orderdate,'%Y-%m-%d') end exam_date from orders",
    "question_explanations": with_views(f"select question_id, coalesce(explanation,'{t.MSG_NO_EXPLANATION}') explanation from fx_questions"),
    "exam_status_view": with_views("select e.exam_id, e.status, case when e.status='failed' then 'x' end error_message, e.total_questions, 1 page_offset, i.page_start, i.page_end, i.booklet, i.template_id, i.has_key from fx_exams e join fx_exam_info i on i.exam_id=e.exam_id"),
}
