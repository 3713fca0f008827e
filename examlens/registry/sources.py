"""Scans and sinks: registered queries and their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from examlens.config import MAX_UPLOAD_BYTES
from examlens.operators import lifecycle as lc
from examlens.operators import texttier as x
from examlens.registry.fixtures import table, view, with_views
from examlens.sources import readers as r
from examlens.sources import sinks as sk


def _files(s, d):
    return r.read_documents(s, d, "*.parquet")


def _document_files(s, d):
    """Every document as a file: its path and the bytes of its text."""
    return table(s, d, "documents").select(
        F.concat(F.lit("docs/"), "doc_id").alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def toy_reader(path: str, content: bytes) -> tuple[str, float]:
    """Stands for the user's reader: fails where the length is a multiple of seven."""
    if len(content) % 7 == 0:
        raise ValueError("size")
    return bytes(content).decode(), min(len(content) / 4096, 1.0)


def _results(s, d):
    """Extractor output as JSON text: sound, broken, failed, empty, or with a bad number."""
    doc = table(s, d, "documents")
    m = F.col("doc_id") % 7
    question = lambda n: F.struct(n.alias("order"), F.col("text").alias("questionText"), F.array(F.lit("A) x"), F.lit("B) y")).alias("options"))
    ok = lambda qs: F.to_json(F.struct(F.lit("ok").alias("status"), F.col("source").alias("usedPath"), F.col("n_chars").cast("int").alias("extractionChars"), qs.alias("questions")))
    return doc.select(
        F.col("doc_id").alias("exam_id"),
        F.when(m == 0, F.lit("{oops"))
        .when(m == 1, F.to_json(F.struct(F.lit("error").alias("status"), F.lit("PIPELINE_RUNTIME_ERROR").alias("errorCode"), F.col("lang").alias("message"))))
        .when(m == 2, ok(F.filter(F.array(question(F.lit(1))), lambda q: F.lit(False))))
        .when(m == 3, ok(F.array(question(F.lit(0)))))
        .otherwise(ok(F.array(question(F.lit(2)), question(F.lit(1))))).alias("result"))


def _q(s, d):
    return view(s, d, "fx_questions").select("exam_id", "q_order", "question_text", "context_text", "subject", "correct_answer", "source_page")


def _new(s, d):
    return _q(s, d).filter("exam_id % 4 = 1 and q_order <= 4").withColumn("question_text", F.concat(F.lit("new "), "question_text"))


def _touched(s, d):
    return view(s, d, "fx_exam_info").filter("exam_id % 4 in (1, 2)").select("exam_id")


def _replaced_table(s, d):
    path = f"{sk.ensure_checkpoint_dir(s)}/examlens/replaced-{uuid.uuid4().hex}"
    sk.write_exam_table(_q(s, d), path, 8)
    sk.replace_in_table(s, path, _new(s, d), _touched(s, d), 8)
    return sk.read_exam_table(s, path, _q(s, d).schema)


def _cascade(s, d):
    sessions = view(s, d, "fx_sessions")
    left = lc.delete_cascade(
        view(s, d, "fx_exam_info"), _q(s, d), sessions, view(s, d, "fx_answers"),
        view(s, d, "fx_exam_info").filter("exam_id % 3 = 0").select("exam_id"))
    keys = {"exams": "exam_id", "questions": "exam_id*100+q_order", "sessions": "session_id", "answers": "event_id"}
    out = None
    for name, df in left.items():
        part = df.select(F.lit(name).alias("kept"), F.expr(keys[name]).cast("bigint").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def _patches(s, d):
    n = F.col("exam_id") + F.col("q_order")
    return view(s, d, "fx_questions").filter("(exam_id + q_order) % 3 = 0").select(
        "exam_id", "q_order",
        F.when(n % 2 == 0, F.concat(F.lit("edited "), "oa")).alias("question_text"),
        (n % 4 == 0).alias("has_context"), F.when(n % 8 == 0, F.lit("ctx")).alias("context_text"),
        F.when(n % 5 == 0, F.lit("Física")).alias("subject"), F.lit("E").alias("correct_answer"))


QUERIES = {
    "read_documents": lambda s, d: _files(s, d).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length"),
    "extract_with": lambda s, d: x.extract_with(_document_files(s, d), toy_reader),
    "validate_uploads": lambda s, d: r.validate_uploads(view(s, d, "fx_uploads")),
    "read_extraction_results": lambda s, d: r.read_extraction_results(_results(s, d)).withColumn("questions", F.size("questions")),
    "extracted_items": lambda s, d: r.extracted_items(r.read_extraction_results(_results(s, d))).select(
        "exam_id", "position", "q_order", "question_text", F.array_join("options", "|").alias("options")),
    "replace_for_exams": lambda s, d: sk.replace_for_exams(_q(s, d), _new(s, d), _touched(s, d)),
    "replace_in_table": _replaced_table,
    "delete_cascade": _cascade,
    "patch_questions": lambda s, d: lc.patch_questions(_q(s, d), _patches(s, d), view(s, d, "fx_exams")),
    "drop_questions": lambda s, d: lc.drop_questions(_q(s, d), _patches(s, d), view(s, d, "fx_exams")),
}

_QS = "select exam_id, q_order, question_text, context_text, subject, correct_answer, source_page from fx_questions"
_REPLACED = with_views(f"{_QS} where exam_id%4 not in (1,2) union all select exam_id, q_order, 'new '||question_text, context_text, subject, correct_answer, source_page from fx_questions where exam_id%4=1 and q_order<=4")
_EDITABLE = "exam_id in (select exam_id from fx_exams where status in ('reviewing','completed'))"

ORACLES = {
    "extract_with": "select path, case when bad then '' else t end as text, case when bad then 0e0 else least(strlen(t)/4096e0, 1e0) end confidence, case when bad then 'ValueError:size' end error from (select 'docs/'||doc_id path, coalesce(text,'') t, strlen(coalesce(text,''))%7=0 bad from documents) u",
    "validate_uploads": with_views(
        ("f", f"""select *, case when page_start<=0 then 'page_start' when page_end<=0 then 'page_end' when page_end<page_start then 'page_range' when template_id is not null and template_id not in ('agente-tecnologia','agente-comercial','escriturario','escriturario-agente-comercial') then 'template_id'
 when content_type not in ('application/pdf','image/png','image/jpeg','image/jpg','image/webp') then 'content_type' when size_bytes<=0 or size_bytes>{MAX_UPLOAD_BYTES} then 'size_bytes' end reject_field from fx_uploads"""),
        "select upload_id, filename, reject_field, case when reject_field='content_type' then 'INVALID_FILE_TYPE' when reject_field='size_bytes' then 'INVALID_FILE_SIZE' when reject_field is not null then 'INVALID_INPUT' end reject_code, case when content_type='application/pdf' then 'pdf' else 'image' end file_type, regexp_replace(substr(filename,1,length(filename)-4),'[^a-zA-Z0-9._-]','_','g')||'.pdf' safe_name, filename title, nullif(upper(trim(prova_type)),'') booklet, template_id, page_start, page_end from f"),
    "read_extraction_results": """select doc_id exam_id, case when doc_id%7>=4 then 'ok' else 'error' end status, case doc_id%7 when 0 then 'PIPELINE_INVALID_OUTPUT' when 1 then 'PIPELINE_RUNTIME_ERROR' when 2 then 'PIPELINE_VALIDATION_ERROR' when 3 then 'PIPELINE_VALIDATION_ERROR' end error_code, case when doc_id%7=1 then lang end message,
 case when doc_id%7>=4 then source end used_path, case when doc_id%7>=4 then cast(n_chars as int) end extraction_chars, case when doc_id%7>=4 then 2 end questions from documents""",
    "extracted_items": "select doc_id exam_id, p as position, 3-p q_order, text question_text, 'A) x|B) y' options from documents cross join (select unnest([1,2]) p) t where doc_id%7>=4",
    "replace_for_exams": _REPLACED,
    "replace_in_table": _REPLACED,
    "delete_cascade": with_views("select 'exams' kept, exam_id id from fx_exam_info where exam_id%3<>0 union all select 'questions', exam_id*100+q_order from fx_questions where exam_id%3<>0 union all select 'sessions', session_id from fx_sessions where exam_id%3<>0 union all select 'answers', event_id from fx_answers where session_id not in (select session_id from fx_sessions where exam_id%3=0)"),
    "patch_questions": with_views(f"""select exam_id, q_order, case when p and n%2=0 then coalesce('edited '||oa, question_text) else question_text end question_text, case when p and n%4=0 then case when n%8=0 then 'ctx' end else context_text end context_text,
 case when p and n%5=0 then 'Física' else subject end subject, case when p then 'E' else correct_answer end correct_answer, source_page from (select *, exam_id+q_order n, (exam_id+q_order)%3=0 and {_EDITABLE} p from fx_questions) t"""),
    "drop_questions": with_views(f"{_QS} where not ((exam_id+q_order)%3=0 and {_EDITABLE})"),
}
