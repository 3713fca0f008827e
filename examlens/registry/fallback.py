"""The fallback tier: registered queries and their DuckDB counterparts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from examlens.functions.text import MSG_NONE_FOUND, MSG_UNPROCESSABLE
from examlens.operators import lifecycle as lc
from examlens.operators import quality as ql
from examlens.plans import fallback as fb
from examlens.registry import enrich as re_
from examlens.registry import keys as rk
from examlens.registry.fixtures import view, with_views
from examlens.sources import sinks as sk

CHUNK = 2000


def toy_primary(name: str, content: bytes) -> tuple[str, float]:
    """Stands for the reader of the file's own text: fails, finds a little, or finds all."""
    text = bytes(content).decode()
    if len(content) % 7 == 0:
        raise ValueError("size")
    return (text[:100], 0.5) if len(text) % 3 == 0 else (text, 1.0)


def toy_secondary(name: str, content: bytes) -> tuple[str, float]:
    """Stands for the second reader."""
    text = bytes(content).decode()
    if len(text) % 5 == 0:
        raise RuntimeError("ocr")
    return (text[:150] if len(text) % 2 else text), 0.25


def toy_structure(prompt: str) -> str:
    """Stands for the model: a question for every line with a number and a dot."""
    chunk = prompt.split("Texto:\n", 1)[1]
    if len(chunk) % 11 == 0:
        raise RuntimeError("quota")
    numbered = [m for m in (re.fullmatch(r"([0-9]{1,2})\. (.*)", line) for line in chunk.split("\n")) if m]
    return json.dumps({"questions": [
        {"order": int(m[1]), "questionText": m[2], "options": [" A) um", "B) dois", "B) dois", ""], "correctAnswer": "c", "sourcePage": int(m[1]) % 5 + 1}
        for m in numbered]})


TIER = fb.Tier(toy_primary, toy_secondary, toy_structure, "toy", max_chars=CHUNK)


def files(s, d):
    """An exam's lines as the bytes of one file."""
    whole = F.expr(r"listagg(text, '\n') within group (order by line_no)")
    return view(s, d, "fx_lines").groupBy("exam_id").agg(whole.alias("t")).select(
        "exam_id", F.concat(F.lit("f"), "exam_id", F.lit(".pdf")).alias("filename"), F.encode("t", "UTF-8").alias("content"))


def _run(s, d):
    ledger = f"{sk.ensure_checkpoint_dir(s)}/examlens/ledger-{uuid.uuid4().hex}"
    routed = ql.route_exams(re_._gated(s, d))
    return fb.fallback_exams(routed, files(s, d), rk.QUERIES["parse_answer_keys"](s, d), re_._info(s, d), TIER, ledger)


_STORED = ("exam_id", "q_order", "question_text", "subject", "correct_answer", "source_page")


def _stored(s, d):
    rows, outcome = _run(s, d)
    return fb.stored_rows(view(s, d, "fx_questions").select(*_STORED), rows, outcome)


def _statuses(s, d):
    _, outcome = _run(s, d)
    queued = outcome.select("exam_id", F.lit("queued").alias("status"), F.lit(None).cast("int").alias("total_questions"))
    return lc.advance_status(queued, fb.outcome_events(outcome, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))).select(
        "exam_id", "new_status", "error_message", "total_questions")


QUERIES = {
    "fallback_outcomes": lambda s, d: _run(s, d)[1],
    "fallback_rows": _stored,
    "fallback_status": _statuses,
}

_TIER = [
    *rk.STEPS, ("conf", re_._CONF), ("gated", re_._GATED), ("sr", re_._RANGES),
    ("fb_files", "select exam_id, string_agg(text, chr(10) order by line_no) t from fx_lines group by exam_id"),
    ("fb_prim", "select g.exam_id, g.reason, t, case when t is null then 'PIPELINE_FILE_NOT_FOUND' when strlen(t)%7=0 then 'PIPELINE_RUNTIME_ERROR:ValueError:size' end e1, case when strlen(t)%7=0 then null when length(t)%3=0 then substr(t,1,100) else t end p from gated g left join fb_files f on f.exam_id=g.exam_id where not g.acceptable"),
    ("fb_sec", "select *, case when e1 is null and length(coalesce(p,''))<180 and length(t)%5=0 then 'PIPELINE_RUNTIME_ERROR:RuntimeError:ocr' end e2, case when e1 is null and length(coalesce(p,''))<180 and length(t)%5<>0 then case when length(t)%2=1 then substr(t,1,150) else t end end s from fb_prim"),
    ("fb_chosen", "select exam_id, reason, coalesce(e1,e2) err, case when length(coalesce(p,''))<180 and length(coalesce(s,''))>length(coalesce(p,'')) then 0.25e0 when p is null then null when length(t)%3=0 then 0.5e0 else 1e0 end conf, case when length(coalesce(p,''))<180 and length(coalesce(s,''))>length(coalesce(p,'')) then s else coalesce(p,'') end t from fb_sec"),
    ("fb_parts", "select exam_id, unnest(string_split(t,chr(10))) part, unnest(range(len(string_split(t,chr(10))))) i from fb_chosen where err is null"),
    ("fb_walk(exam_id,i,chunk,size)", f"""select exam_id, i, 0, length(part)+1 from fb_parts where i=0 union all
 select p.exam_id, p.i, case when w.size+length(p.part)>{CHUNK} then w.chunk+1 else w.chunk end, case when w.size+length(p.part)>{CHUNK} then length(p.part) else w.size+length(p.part)+1 end from fb_walk w join fb_parts p on p.exam_id=w.exam_id and p.i=w.i+1"""),
    ("fb_chunks", "select exam_id, chunk, length(string_agg(part, chr(10) order by i))%11=0 quota from fb_walk join fb_parts using (exam_id, i) group by exam_id, chunk"),
    ("fb_failing", "select exam_id, min(chunk) chunk from fb_chunks where quota group by exam_id"),
    ("fb_found", """select * from (select exam_id, cast(n as int) n, regexp_extract(part,'^[0-9]{1,2}\\. (.*)$',1) txt, row_number() over (partition by exam_id, cast(n as int) order by i) rn
 from (select *, nullif(regexp_extract(part,'^([0-9]{1,2})\\. .*$',1),'') n from fb_parts) u where n is not null) z where rn=1"""),
    ("fb_invalid", "select exam_id, bool_or(n<1 or txt='') bad from fb_found group by exam_id"),
    ("fb_verdict", """select c.exam_id, c.reason, length(c.t) chars, c.conf, coalesce(c.err, 'PIPELINE_RUNTIME_ERROR:GEMINI_EXTRACTION_FAILED on chunk '||(f.chunk+1)||': RuntimeError:quota', case when coalesce(v.bad,true) then 'PIPELINE_VALIDATION_ERROR' end) err
 from fb_chosen c left join fb_failing f on f.exam_id=c.exam_id left join fb_invalid v on v.exam_id=c.exam_id"""),
    ("fb_kept", """select q.exam_id, q.n q_order, trim(q.txt) question_text, r.subject, coalesce(k.answer,'C') correct_answer, q.n%5+1 source_page from fb_found q join fb_verdict v on v.exam_id=q.exam_id and v.err is null join fx_exam_info i on i.exam_id=q.exam_id
 left join (select * from final where not annulled) k on k.exam_id=q.exam_id and k.q_order=q.n left join sr r on r.template_id=i.template_id and q.n between r.first and r.last where trim(q.txt)<>''"""),
    ("fb_ended", """select v.*, coalesce(n,0) inserted, page_offset, coalesce(err, case when n is null then 'ZERO_VALID_QUESTIONS' end) failure from fb_verdict v left join (select exam_id, count(*) n, min_by(source_page,q_order) page_offset from fb_kept group by exam_id) k on k.exam_id=v.exam_id"""),
    ("fb_shown", f"select *, case when failure='ZERO_VALID_QUESTIONS' then '{MSG_NONE_FOUND}' when failure is not null then '{MSG_UNPROCESSABLE}' end msg from fb_ended"),
]

ORACLES = {
    "fallback_outcomes": with_views(*_TIER, """select e.exam_id, 'fallback' tier, reason fallback_reason, case when failure is null then 'reviewing' else 'failed' end status, inserted, page_offset, case when i.has_key then (select count(*) from final f where f.exam_id=e.exam_id and not annulled) end questions_expected, case when failure is null then 'degraded' end health,
 case when chars>=180 then 'toy' else 'gemini-structuring-fallback' end used_path, chars extraction_chars, conf read_confidence, case when chars>=180 then reason else reason||'|LOW_EXTRACTION_CHARS:'||chars end read_reason, failure as error, msg error_message from fb_shown e join fx_exam_info i on i.exam_id=e.exam_id"""),
    "fallback_rows": with_views(*_TIER, f"select {', '.join(_STORED)} from fx_questions where exam_id not in (select exam_id from fb_ended where coalesce(failure,'ZERO_VALID_QUESTIONS')='ZERO_VALID_QUESTIONS') union all select {', '.join(_STORED)} from fb_kept"),
    "fallback_status": with_views(*_TIER, "select exam_id, case when failure is null then 'reviewing' else 'failed' end new_status, msg error_message, case when failure is null then cast(inserted as int) end total_questions from fb_shown"),
}
