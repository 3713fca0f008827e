"""Assembly, quality and lifecycle: registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.functions import text as t
from examlens.operators import enrich as e
from examlens.operators import lifecycle as lc
from examlens.operators import quality as ql
from examlens.plans import extract as px
from examlens.registry import keys as rk
from examlens.registry import layout as rl
from examlens.registry import questions as rq
from examlens.registry.fixtures import table, view, with_views
from examlens.sources.sinks import materialize


def _q(s, d):
    return view(s, d, "fx_questions")


def _flat(df, name="options"):
    return df.withColumn(name, F.array_join(name, "|"))


def _as_parsed(s, d):
    q = _q(s, d)
    return q.select(
        "exam_id", F.col("q_order").alias("num"), F.col("question_text").alias("text"), F.col("source_page").alias("page"),
        *[F.coalesce(f"o{x}", F.lit("")).alias(x) for x in "abcde"], "context_text", F.col("confidence").alias("score"),
    )


def _rows(s, d):
    return e.to_question_rows(_as_parsed(s, d))


def _items(s, d):
    """Rows with untidy options: blanks, repeats, missing numbers."""
    return _q(s, d).select(
        "exam_id", F.col("q_order").alias("position"),
        F.when(F.col("q_order") % 7 == 0, 0).otherwise(F.col("q_order")).alias("q_order"),
        F.concat(F.lit("  "), "question_text", F.lit(" ")).alias("question_text"),
        F.array(*[F.coalesce(x, F.lit("")) for x in ("oa", "ob", "oa")], F.concat(F.lit(" "), F.coalesce("oc", F.lit("")), F.lit("  ")), F.lit("")).alias("options"),
    )


def _keys(s, d):
    return rk.QUERIES["parse_answer_keys"](s, d)


def _keyed(s, d):
    q = _q(s, d).select("exam_id", "q_order")
    ex = view(s, d, "fx_explicit")
    return e.apply_answer_key(q.join(ex, ["exam_id", "q_order"], "left"), _keys(s, d))


def _info(s, d):
    return view(s, d, "fx_exam_info")


def _confidence(s, d):
    q = _q(s, d)
    return ql.exam_confidence(q.withColumn("score", F.col("confidence").cast("int")), _info(s, d))


def _gated(s, d):
    return ql.quality_gate(_confidence(s, d))


def _health(s, d):
    g = ql.route_exams(_gated(s, d)).join(ql.questions_expected(_info(s, d), _keys(s, d)), "exam_id")
    g = g.withColumn("inserted", F.when(F.col("exam_id") % 13 == 0, F.lit(0).cast("bigint")).otherwise(F.col("questions")))
    g = g.withColumns({
        "used_path": F.when(F.col("tier") == "fastpath", "fastpath").otherwise("reader"),
        "duration_ms": F.col("exam_id") * 10, "cost_usd": F.lit(0.0)})
    h = ql.parsing_health(g)
    return h.select(
        "exam_id", "tier", "parsing_log.health", "parsing_log.questionsExtracted", "parsing_log.questionsExpected",
        "parsing_log.durationMs", "parsing_log.tierUsed", "parsing_log.fallbackReason")


def _messages(s, d):
    m = F.col("doc_id") % 5
    return table(s, d, "documents").select(
        "doc_id",
        F.when(m == 0, F.lit("ZERO_VALID_QUESTIONS")).when(m == 1, F.concat(F.lit("PIPELINE_RUNTIME_ERROR:"), "text"))
        .when(m == 2, F.concat(F.lit("Invalid "), "lang", F.lit(" PDF"))).otherwise(F.col("text")).alias("message"),
    )


def status_events(s, d):
    ev = table(s, d, "events")
    kind = F.array(*[F.lit(x) for x in ("start", "extracted", "fail", "publish", "reprocess")])
    return ev.select(
        F.col("user_id").alias("exam_id"), "event_id", F.get(kind, (F.col("event_id") % 5).cast("int")).alias("event"),
        (F.col("event_id") % 3).cast("int").alias("question_count"), F.concat(F.lit("broken "), "event_type").alias("message"),
        F.col("ts").alias("at"),
    )


def _overrides(s, d):
    return _q(s, d).filter("(exam_id + q_order) % 9 = 0").select(
        "exam_id", "q_order", F.when(F.col("q_order") % 2 == 0, "Matemática").otherwise("Sem matéria").alias("subject"))


def _hash_rows(s, d):
    return _rows(s, d).select("exam_id", "q_order", e.content_hash(F.col("question_text"), F.col("options")).alias("content_hash"))


def _extract_inputs(s, d):
    return view(s, d, "fx_fragments"), view(s, d, "fx_pages"), view(s, d, "fx_key_lines"), _info(s, d)


def extract(s, d):
    out = px.extract_exams(*_extract_inputs(s, d))
    return _flat(out).select(
        "exam_id", "q_order", "question_text", "options", "source_page", "context_text", "score",
        "correct_answer", "key_matched", "subject", "content_hash", "confidence")


def outcomes(s, d):
    fr, pg, kl, ex = _extract_inputs(s, d)
    rows = materialize(px.parsed_rows(fr, pg, ex), "rows")
    answers = rk.k.parse_answer_keys(kl, ex.filter("has_key"))
    stored = e.clean_questions(px.gate_rows(rows).filter("tier = 'fastpath'"))
    return px.exam_outcomes(rows, stored, answers, ex)


QUERIES = {
    "to_question_rows": lambda s, d: _flat(_rows(s, d)),
    "exam_confidence": _confidence,
    "quality_gate": _gated,
    "route_exams": lambda s, d: ql.route_exams(_gated(s, d)).select("exam_id", "tier", "fallback_reason"),
    "clean_questions": lambda s, d: _flat(e.clean_questions(_items(s, d))),
    "normalize_answer": lambda s, d: view(s, d, "fx_answers").select(
        "event_id", t.normalize_answer(F.col("raw_answer")).alias("answer")),
    "apply_answer_key": _keyed,
    "answer_mismatches": lambda s, d: e.answer_mismatches(_keyed(s, d)),
    "infer_subject": lambda s, d: e.infer_subject(_q(s, d).select("exam_id", "q_order", "subject"), _info(s, d)),
    "subject_roster": lambda s, d: e.subject_roster(_q(s, d), _info(s, d), _overrides(s, d)).withColumn(
        "questions", F.array_join("questions", ",")),
    "template_catalog": lambda s, d: e.template_catalog(view(s, d, "fx_uploads")),
    "with_known_template": lambda s, d: e.with_known_template(view(s, d, "fx_uploads")).select("upload_id", "template_id"),
    "content_hash": _hash_rows,
    "key_coverage": lambda s, d: ql.key_coverage(_keyed(s, d), _keys(s, d), _info(s, d)),
    "questions_expected": lambda s, d: ql.questions_expected(_info(s, d), _keys(s, d)),
    "parsing_health": _health,
    "error_category": lambda s, d: _messages(s, d).select("doc_id", t.error_category(F.col("message")).alias("user_message")),
    "advance_status": lambda s, d: lc.advance_status(view(s, d, "fx_exams"), status_events(s, d)),
    "page_offset": lambda s, d: ql.page_offset(_q(s, d)),
    "extract_exams": extract,
    "exam_outcomes": outcomes,
}

_KEYED = """select q.exam_id, q.q_order, x.explicit_answer, coalesce(k.answer, x.explicit_answer) correct_answer, k.answer is not null key_matched, coalesce(k.answer<>x.explicit_answer,false) answer_mismatch
 from fx_questions q left join fx_explicit x on x.exam_id=q.exam_id and x.q_order=q.q_order left join (select * from final where not annulled) k on k.exam_id=q.exam_id and k.q_order=q.q_order"""
_CONF = """select i.exam_id, coalesce(n,0) questions, coalesce(c,0) confidence, coalesce(s,false) has_short_text from fx_exam_info i left join
 (select exam_id, count(*) n, avg(cast(confidence as int)) c, bool_or(length(trim(question_text))<10) s from fx_questions group by exam_id) q on q.exam_id=i.exam_id"""
_GATED = """select *, reason is null acceptable from (select *, case when questions<1 then 'LOW_QUESTION_COUNT:'||questions when confidence<80 then 'LOW_CONFIDENCE:'||regexp_replace(cast(confidence as varchar),'\\.0$','') when has_short_text then 'LOW_TEXT_QUALITY' end reason from conf) t"""
_RANGES = "select * from (values " + ", ".join(
    f"('{a}',{b},'{c}','{d}',{f},{g},cast({h} as double),{str(i).lower()})" for a, b, c, d, f, g, h, i in __import__("examlens.templates", fromlist=["SUBJECT_RANGES"]).SUBJECT_RANGES
) + ") t(template_id, seq, subject, area, first, last, points_each, has_shared_text)"
_TEMPLATES = "select * from (values " + ", ".join(
    f"('{a}','{b}','{c}',{d})" for a, b, c, d in __import__("examlens.templates", fromlist=["TEMPLATES"]).TEMPLATES
) + ") t(template_id, label, board, total_questions)"
_NORM = r"lower(trim(regexp_replace(nfc_normalize({x}),'\s+',' ','g')))"


def _hash(text, opts):
    o = f"list_transform({opts}, lambda x: regexp_replace({_NORM.format(x='x')},'^[a-e]\\s*[).:\\-]?\\s*',''))"
    return f"sha256(concat({_NORM.format(x=text)},'||',array_to_string(list_sort({o}),'||')))"


_OPTS = "list_filter([" + ",".join(f"case when {c}<>'' then '{x}) '||{c} end" for x, c in zip("ABCDE", ("oa", "ob", "oc", "od", "oe"))) + "], lambda x: x is not null)"
_ROWS = f"select exam_id, q_order, question_text, {_OPTS} opts, source_page, context_text, confidence score from fx_questions"
_CLEAN = """select exam_id, position, case when q_order>0 then q_order else position end q_order, question_text, array_to_string(opts,'|') options from (
 select exam_id, position, q_order, trim(question_text) question_text, list_filter(raw, lambda x, i: x<>'' and list_position(raw,x)=i) opts from (
 select exam_id, q_order as position, case when q_order%7=0 then 0 else q_order end q_order, question_text, list_transform([coalesce(oa,''),coalesce(ob,''),coalesce(oa,''),' '||coalesce(oc,'')||'  ',''], lambda x: trim(x)) raw from fx_questions) a) b where question_text<>'' and len(opts)>=2"""
_MSG = "select doc_id, case doc_id%5 when 0 then 'ZERO_VALID_QUESTIONS' when 1 then 'PIPELINE_RUNTIME_ERROR:'||text when 2 then 'Invalid '||lang||' PDF' else text end as m from documents"
_EVENTS = "select user_id exam_id, event_id, ['start','extracted','fail','publish','reprocess'][event_id%5+1] event, cast(event_id%3 as int) question_count, 'broken '||event_type message, ts as ev_at from events"
_STATUS = f"""with recursive ev as (select *, row_number() over (partition by exam_id order by ev_at, event_id) i from ({_EVENTS}) e),
 walk(exam_id,i,event,old_status,status,code,error,total,ended) as (
 select v.exam_id, 0::bigint, null::varchar, x.status, x.status, null::varchar, null::varchar, x.total_questions, null::timestamp from (select distinct exam_id from ev) v left join ({{exams}}) x on x.exam_id=v.exam_id union all
 select exam_id, i, event, old_status, coalesce(nw,status), case when nw is not null or (event='publish' and status='completed') then null when event='publish' and status='reviewing' then 'NO_QUESTIONS' when event='reprocess' then 'EXAM_NOT_FAILED' else 'INVALID_STATE' end,
  case when nw is null then error when nw='failed' then case when event='extracted' then '{t.MSG_NONE_FOUND}' else message end end,
  case when nw in ('reviewing','completed') then question_count when nw='queued' then null else total end, case when nw in ('completed','failed') then ev_at else ended end
 from (select e.exam_id, e.i, e.event, e.question_count, e.message, e.ev_at, w.old_status, w.status, w.error, w.total, w.ended,
  case when e.event='start' and w.status='queued' then 'processing' when e.event='extracted' and w.status='processing' then case when e.question_count>0 then 'reviewing' else 'failed' end when e.event='fail' and w.status='processing' then 'failed' when e.event='publish' and w.status='reviewing' and e.question_count>0 then 'completed' when e.event='reprocess' and w.status='failed' then 'queued' end nw
  from walk w join ev e on e.exam_id=w.exam_id and e.i=w.i+1) t)
select exam_id, event, old_status, status new_status, case when old_status is null then 'EXAM_NOT_FOUND' else code end reject_code, error error_message, total total_questions, ended processed_at
from (select *, row_number() over (partition by exam_id order by i desc) rn from walk where i>0) z where rn=1"""


def _clipped(steps):
    out = []
    for name, sql in steps:
        out.append((name, sql.replace("fx_fragments", "frag_in").replace("fx_pages", "pages_in")))
    return out


_FLOW = [
    ("lastp", "select exam_id, max(page) n from fx_pages group by exam_id"),
    ("rng", "select l.exam_id, least(coalesce(case when i.page_start>0 then i.page_start end,1),n) a, least(coalesce(case when i.page_end>0 then i.page_end end,n),n) z from lastp l left join fx_exam_info i on i.exam_id=l.exam_id"),
    ("frag_in", "select f.* from fx_fragments f join rng r on r.exam_id=f.exam_id where f.page between r.a and greatest(r.a,r.z)"),
    ("pages_in", "select f.* from fx_pages f join rng r on r.exam_id=f.exam_id where f.page between r.a and greatest(r.a,r.z)"),
    *_clipped(rl.STEPS),
    *rq.steps("ordered", "pages_in"),
    *rk.STEPS,
    ("conf", "select i.exam_id, coalesce(n,0) questions, coalesce(c,0) confidence, coalesce(s,false) has_short_text from fx_exam_info i left join (select exam_id, count(*) n, avg(score) c, bool_or(length(trim(text))<10) s from parsed where status='real_question_confirmed' group by exam_id) q on q.exam_id=i.exam_id"),
    ("gated", _GATED),
    ("stored", "select * from (select p.*, g.confidence, " + _OPTS.replace("oa", "a").replace("ob", "b").replace("oc", "c").replace("od", "d").replace("oe", "e") + " opts from parsed p join gated g on g.exam_id=p.exam_id where p.status='real_question_confirmed' and g.acceptable) t where text<>'' and len(list_distinct(opts))>=2"),
    ("sr", _RANGES),
    ("usable", "select f.* from final f join fx_exam_info i on i.exam_id=f.exam_id where i.has_key and not f.annulled"),
]

ORACLES = {
    "to_question_rows": with_views(f"select exam_id, q_order, question_text, array_to_string(opts,'|') options, source_page, context_text, score from ({_ROWS})"),
    "exam_confidence": with_views(_CONF),
    "quality_gate": with_views(("conf", _CONF), _GATED),
    "route_exams": with_views(("conf", _CONF), f"select exam_id, case when acceptable then 'fastpath' else 'fallback' end tier, reason fallback_reason from ({_GATED})"),
    "clean_questions": with_views(_CLEAN),
    "normalize_answer": with_views(r"select event_id, nullif(regexp_extract(upper(trim(raw_answer)),'^([A-E])(?:$|[).:\-\s])',1),'') answer from fx_answers"),
    "apply_answer_key": with_views(*rk.STEPS, _KEYED),
    "answer_mismatches": with_views(*rk.STEPS, f"select exam_id, q_order, explicit_answer, correct_answer from ({_KEYED}) where answer_mismatch"),
    "infer_subject": with_views(("sr", _RANGES), "select q.exam_id, q.q_order, coalesce(nullif(trim(q.subject),''), r.subject) subject from fx_questions q join fx_exam_info i on i.exam_id=q.exam_id left join sr r on r.template_id=i.template_id and q.q_order between r.first and r.last"),
    "subject_roster": with_views(
        ("sr", _RANGES),
        ("placed", "select q.exam_id, q.q_order, case when (q.exam_id+q.q_order)%9=0 then case when q.q_order%2=0 then 'Matemática' else 'Sem matéria' end else r.subject end subject from fx_questions q join fx_exam_info i on i.exam_id=q.exam_id left join sr r on r.template_id=i.template_id and q.q_order between r.first and r.last"),
        "select i.exam_id, i.template_id, r.seq, r.subject, r.area, r.points_each, r.has_shared_text, coalesce((select string_agg(cast(p.q_order as varchar),',' order by p.q_order) from placed p where p.exam_id=i.exam_id and p.subject=r.subject),'') questions from fx_exam_info i join sr r on r.template_id=i.template_id"),
    "template_catalog": with_views(("tp", _TEMPLATES), "select tp.*, (select count(*) from fx_uploads u where u.template_id=tp.template_id) uploads from tp"),
    "with_known_template": with_views(("tp", _TEMPLATES), "select upload_id, template_id from fx_uploads where template_id in (select template_id from tp)"),
    "content_hash": with_views(f"select exam_id, q_order, {_hash('question_text', 'opts')} content_hash from ({_ROWS})"),
    "key_coverage": with_views(*rk.STEPS, f"""select i.exam_id, coalesce(a,0) answers, coalesce(q,0) extracted, coalesce(m,0) matched, case when coalesce(q,0)>0 then round(m/q,4) else 0 end coverage, coalesce(a,0)=0 zero_answers from fx_exam_info i
 left join (select exam_id, count(*) a from final where not annulled group by exam_id) k on k.exam_id=i.exam_id left join (select exam_id, count(*) q, count(*) filter (where key_matched) m from ({_KEYED}) group by exam_id) x on x.exam_id=i.exam_id where i.has_key"""),
    "questions_expected": with_views(*rk.STEPS, "select i.exam_id, case when has_key then (select count(*) from final f where f.exam_id=i.exam_id and not annulled) end questions_expected from fx_exam_info i"),
    "parsing_health": with_views(*rk.STEPS, ("conf", _CONF), ("gated", _GATED), """select exam_id, tier, case when tier='fastpath' then 'healthy' when ins=0 then 'poor' when acceptable then 'healthy' else 'degraded' end health, ins "questionsExtracted", expected "questionsExpected", exam_id*10 "durationMs",
 case when tier='fastpath' then 'fastpath' else 'reader' end "tierUsed", case when tier<>'fastpath' then reason end "fallbackReason" from (select g.*, case when acceptable then 'fastpath' else 'fallback' end tier, case when g.exam_id%13=0 then 0 else g.questions end ins, case when i.has_key then (select count(*) from final f where f.exam_id=g.exam_id and not annulled) end expected from gated g join fx_exam_info i on i.exam_id=g.exam_id) t"""),
    "error_category": with_views(("msg", _MSG), f"select doc_id, case when m='ZERO_VALID_QUESTIONS' then '{t.MSG_NONE_FOUND}' when lower(m) like '%pdf%' or lower(m) like '%parser%' or contains(lower(m),'pipeline_') or lower(m) like '%pipeline input%' then '{t.MSG_UNPROCESSABLE}' when length(m)>220 then substr(m,1,217)||'...' else m end user_message from msg"),
    "advance_status": _STATUS.format(exams=with_views("select * from fx_exams")),
    "page_offset": with_views("select exam_id, min_by(source_page,q_order) page_offset from fx_questions group by exam_id"),
    "extract_exams": with_views(*_FLOW, "select s.exam_id, s.num q_order, s.text question_text, array_to_string(s.opts,'|') options, s.page source_page, s.context_text, s.score, u.answer correct_answer, u.answer is not null key_matched, r.subject, "
                                + _hash("s.text", "s.opts") + " content_hash, s.confidence from stored s join fx_exam_info i on i.exam_id=s.exam_id left join usable u on u.exam_id=s.exam_id and u.q_order=s.num left join sr r on r.template_id=i.template_id and s.num between r.first and r.last"),
    "exam_outcomes": with_views(*_FLOW, """select exam_id, case when acceptable then 'fastpath' else 'fallback' end tier, reason fallback_reason, case when acceptable then case when ins>0 then 'reviewing' else 'failed' end else 'processing' end status, confidence, ins inserted, page_offset, expected questions_expected,
 case when acceptable then 'healthy' end health, case when acceptable and ins=0 then 'ZERO_VALID_QUESTIONS' end as error from (select g.*, (select count(*) from stored s where s.exam_id=g.exam_id) ins, (select min_by(page,num) from stored s where s.exam_id=g.exam_id) page_offset, case when i.has_key then (select count(*) from usable u where u.exam_id=g.exam_id) end expected from gated g join fx_exam_info i on i.exam_id=g.exam_id) t"""),
}
