"""Classification and text tier: registered queries and their DuckDB counterparts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from examlens.operators import classify as c
from examlens.operators import texttier as x
from examlens.registry.fixtures import table, view, with_views

CHUNK = 2000


def _questions(s, d):
    q = view(s, d, "fx_questions")
    return q.withColumn("options", F.array(*[F.coalesce(o, F.lit("")) for o in ("oa", "ob", "oc")]))


def _pending(s, d):
    return c.pending_questions(_questions(s, d))


def _batches(s, d):
    return c.make_batches(_pending(s, d))


def _parsed(s, d):
    return c.parse_classifications(view(s, d, "fx_responses"))


def _items(s, d):
    i = c.classification_items(_parsed(s, d), ["exam_id", "idx"])
    return i.select("exam_id", F.lit(0).alias("batch_no"), "idx", "pos", "index", "subject", "topic", "difficulty")


def _matched(s, d):
    late = view(s, d, "fx_responses").filter("exam_id % 12 = 7").select("exam_id", F.lit(0).alias("batch_no")).distinct()
    items = _items(s, d).withColumnRenamed("idx", "seq")
    return c.match_classifications(_batches(s, d), items, late, F.struct("seq", "pos"))


def _three(s, d):
    ok, retry, failed = _matched(s, d)
    none = F.lit(None).cast("string")
    pick = lambda df, kind: df.select(
        "exam_id", "batch_no", "idx", "question_id", F.lit(kind).alias("outcome"),
        *[(F.col(k) if k in df.columns else none).alias(k) for k in ("subject", "topic", "difficulty")])
    return pick(ok, "classified").unionByName(pick(retry, "retry")).unionByName(pick(failed, "failed"))


def _retries(s, d):
    _, retry, _ = _matched(s, d)
    answers = _parsed(s, d).select((F.col("exam_id") * 100 + F.col("idx") + 1).alias("question_id"), "items", "error")
    ok, bad = c.match_retries(retry, answers)
    return ok.select("question_id", "subject").unionByName(bad.select("question_id", F.lit(None).cast("string").alias("subject")))


def _usage(s, d):
    r = view(s, d, "fx_responses")
    m = F.col("idx") % 3
    return c.usage_cost(r.select(
        "exam_id", "idx", (F.col("exam_id") * 10 + F.col("idx")).alias("seq"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day_no")).alias("day"),
        "prompt_tokens", F.when(m == 0, F.col("output_tokens")).alias("response_tokens"),
        F.when(m <= 1, F.col("output_tokens") + 1).alias("candidates_tokens"),
        F.when(m == 2, F.lit(77).cast("bigint")).alias("total_tokens")))


def _budget(s, d):
    from dataclasses import replace

    return c.daily_budget(_usage(s, d), replace(c.CLASSIFICATION, daily_usd=0.05), block=128).select(
        "exam_id", "idx", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("cost_before").cast("double").alias("cost_before"),
        "runs", F.date_format("due_day", "yyyy-MM-dd").alias("due_day"))


def _applied(s, d):
    ok, _, failed = _matched(s, d)
    q = _questions(s, d).withColumn("topic", F.lit(None).cast("string")).withColumn("difficulty", F.lit(None).cast("string"))
    return c.apply_classifications(q, ok, failed).select(
        "question_id", "exam_id", "q_order", "subject", "topic", "difficulty", "classification_status")


def toy_model(prompt: str) -> str:
    """Stands for the user's model: subject by the length of the question."""
    items = json.loads(prompt.split("\n\n", 1)[1])
    return json.dumps({"items": [
        {"index": i["index"], "subject": f"s{len(i['questionText']) % 3}", "topic": "t", "difficulty": "easy"} for i in items]})


def _classified_with(s, d):
    answered = c.classify_with(c.batch_payload(_batches(s, d)), toy_model)
    items = c.classification_items(c.parse_classifications(answered), ["exam_id", "batch_no"])
    ok, _, _ = c.match_classifications(_batches(s, d), items, answered.filter("timed_out"), F.col("pos"))
    return ok.select("question_id", "subject", "topic", "difficulty")


def _docs(s, d):
    return table(s, d, "documents")


def _text_pages(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))


def _joined(s, d):
    a = x.join_pages(_text_pages(s, d)).withColumn("reader", F.lit("direct"))
    return a.unionByName(x.join_pages(_text_pages(s, d), ocr=True).withColumn("reader", F.lit("ocr")))


def _confidence(s, d):
    j = x.join_pages(_text_pages(s, d), ocr=True)
    t = F.col("text")
    return j.select("doc_id", x.direct_confidence(t).alias("direct"), x.ocr_confidence(t, F.col("pages")).alias("ocr"),
                    x.document_confidence(t).alias("single"))


def _read(s, d):
    return _docs(s, d).select(
        "doc_id", F.concat(F.lit("f"), "doc_id", F.lit(".pdf")).alias("filename"),
        F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 2 == 0, F.split("text", "\n")[0]).otherwise(F.col("text")).alias("primary"),
        F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("secondary"), F.lit("LOW_CONFIDENCE:50").alias("fallback_reason"))


def _found(s, d):
    q = _questions(s, d)
    n = F.lit(0) + (F.col("exam_id") + F.col("q_order")) % 3 + 1
    return q.select(
        "exam_id", F.col("q_order").alias("position"), ((F.col("q_order") - 1) % 7 + 1).alias("q_order"),
        "question_text", "oa", F.explode(F.sequence(F.lit(1).cast("bigint"), n)).alias("chunk"))


QUERIES = {
    "pending_questions": lambda s, d: _pending(s, d).withColumn("options", F.array_join("options", "|")),
    "make_batches": lambda s, d: _batches(s, d).select("exam_id", "q_order", "question_id", "batch_no", "idx"),
    "batch_payload": lambda s, d: c.batch_payload(_batches(s, d)),
    "parse_classifications": lambda s, d: _parsed(s, d).select(
        "exam_id", "idx", "error", F.when(F.col("error").isNull(), F.get("items", F.lit(0))["subject"]).alias("subject")),
    "classification_items": _items,
    "match_classifications": _three,
    "match_retries": _retries,
    "usage_cost": lambda s, d: _usage(s, d).select("exam_id", "idx", "input_tokens", "output_tokens", "total_tokens", F.round("cost_usd", 9).alias("cost_usd")),
    "daily_budget": _budget,
    "apply_classifications": _applied,
    "classify_with": _classified_with,
    "join_pages": _joined,
    "extraction_confidence": _confidence,
    "choose_text": lambda s, d: x.choose_text(_read(s, d)),
    "chunk_text": lambda s, d: x.chunk_text(_docs(s, d).select("doc_id", "text"), CHUNK),
    "chunk_text_default": lambda s, d: x.chunk_text(_docs(s, d).select("doc_id", "text")),
    "merge_chunk_questions": lambda s, d: x.merge_chunk_questions(_found(s, d)),
}

_PAY = "'[' || string_agg(json_object('index', idx, 'questionText', question_text, 'options', opts)::varchar, ',' order by idx) || ']'"
STEPS = [
    ("pend", "select exam_id, q_order, question_id, question_text, [coalesce(oa,''),coalesce(ob,''),coalesce(oc,'')] opts from fx_questions where classification_status='pending'"),
    ("batches", "select *, cast((n-1)//10 as int) batch_no, cast((n-1)%10 as int) idx from (select *, row_number() over (partition by exam_id order by q_order, question_id) n from pend) t"),
    ("resp", r"""select *, case when doc_ok then case when diff in ('easy','medium','hard') then null else 'CLASSIFICATION_INVALID_SCHEMA' end else 'CLASSIFICATION_INVALID_JSON' end err from (
 select *, json_valid(response) doc_ok, case when json_valid(response) then response->'items'->0->>'difficulty' end diff, case when json_valid(response) then cast(response->'items'->0->>'index' as int) end ix,
 case when json_valid(response) then trim(response->'items'->0->>'subject') end subject, case when json_valid(response) then trim(response->'items'->0->>'topic') end topic from fx_responses) t"""),
    ("items", "select exam_id, 0 batch_no, idx, 0 pos, ix as \"index\", subject, topic, diff difficulty from resp where err is null"),
    ("three", """select b.exam_id, b.batch_no, b.idx, b.question_id, case when b.exam_id%12=7 and b.batch_no=0 then 'failed' when i.subject is null then 'retry' else 'classified' end outcome,
 case when not (b.exam_id%12=7 and b.batch_no=0) then i.subject end subject, case when not (b.exam_id%12=7 and b.batch_no=0) then i.topic end topic, case when not (b.exam_id%12=7 and b.batch_no=0) then i.difficulty end difficulty
 from batches b left join items i on i.exam_id=b.exam_id and i.batch_no=b.batch_no and i."index"=b.idx"""),
    ("cost", """select exam_id, idx, exam_id*10+idx seq, day_no, prompt_tokens input_tokens, case idx%3 when 0 then output_tokens when 1 then output_tokens+1 else 0 end output_tokens, case when idx%3=2 then 77 else prompt_tokens+case idx%3 when 0 then output_tokens else output_tokens+1 end end total_tokens from fx_responses"""),
]


# The queue, batch by batch: the limit of a day is used up, or the next batch comes on a later day.
QUEUE = [
    ("queued", "select exam_id, idx, day_no, cast(round((input_tokens/1e6*0.3e0+output_tokens/1e6*2.5e0)*1e12) as hugeint) cost, row_number() over (order by day_no, seq) i from cost"),
    ("walk(exam_id, idx, day_no, i, run_day, spent, used)", """select cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(0 as bigint), cast(-1 as bigint), cast(0 as hugeint), cast(0 as hugeint) union all
 select q.exam_id, q.idx, q.day_no, q.i, greatest(q.day_no, w.run_day + case when w.used >= 50000000000 then 1 else 0 end),
 case when q.day_no > w.run_day or w.used >= 50000000000 then 0 else w.used end, case when q.day_no > w.run_day or w.used >= 50000000000 then 0 else w.used end + q.cost
 from walk w join queued q on q.i = w.i + 1"""),
]


def _o(select, *more):
    return with_views(*STEPS, *more, select)


def _chunks(size: int) -> str:
    return f"""with recursive parts as (select doc_id, unnest(string_split(text,chr(10))) part, unnest(range(len(string_split(text,chr(10))))) i from documents),
 walk(doc_id,i,chunk,size) as (select doc_id, i, 0, length(part)+1 from parts where i=0 union all
 select p.doc_id, p.i, case when w.size+length(p.part)>{size} then w.chunk+1 else w.chunk end, case when w.size+length(p.part)>{size} then length(p.part) else w.size+length(p.part)+1 end from walk w join parts p on p.doc_id=w.doc_id and p.i=w.i+1)
 """


ORACLES = {
    "pending_questions": _o("select exam_id, q_order, question_id, question_text, array_to_string(opts,'|') options from pend"),
    "make_batches": _o("select exam_id, q_order, question_id, batch_no, idx from batches"),
    "batch_payload": _o(f"select exam_id, batch_no, '{c.INSTRUCTIONS}' || chr(10) || chr(10) || {_PAY} prompt, count(*) questions from batches group by exam_id, batch_no"),
    "parse_classifications": _o("select exam_id, idx, err as error, case when err is null then subject end subject from resp"),
    "classification_items": _o("select * from items"),
    "match_classifications": _o("select * from three"),
    "match_retries": _o("select t.question_id, case when r.err is null then r.subject end subject from three t left join resp r on r.exam_id*100+r.idx+1=t.question_id where t.outcome='retry'"),
    "usage_cost": _o("select exam_id, idx, input_tokens, output_tokens, total_tokens, round(input_tokens/1e6*0.3e0+output_tokens/1e6*2.5e0,9) cost_usd from cost"),
    "daily_budget": _o("select exam_id, idx, strftime(date '2024-01-01'+cast(day_no as int),'%Y-%m-%d') as day, cast(spent as double)/1e12 cost_before, run_day=day_no runs, strftime(date '2024-01-01'+cast(run_day as int),'%Y-%m-%d') due_day from walk where i>0", *QUEUE),
    "apply_classifications": _o("select q.question_id, q.exam_id, q.q_order, case when t.outcome='classified' then t.subject else q.subject end subject, t.topic, t.difficulty, case when t.outcome in ('classified','failed') then t.outcome else q.classification_status end classification_status from fx_questions q left join (select question_id, outcome, subject, case when outcome='classified' then topic end topic, case when outcome='classified' then difficulty end difficulty from three) t on t.question_id=q.question_id"),
    "classify_with": _o("select question_id, 's'||length(question_text)%3 subject, 't' topic, 'easy' difficulty from batches"),
    "join_pages": "select doc_id, replace(text,chr(10),chr(10)||chr(10)) as text, len(string_split(text,chr(10))) pages, 'direct' reader from documents union all "
                  "select doc_id, array_to_string(list_filter(string_split(text,chr(10)), lambda x: trim(x)<>''), chr(10)||chr(10)||'---'||chr(10)||chr(10)), len(string_split(text,chr(10))), 'ocr' from documents",
    "extraction_confidence": "select doc_id, case when length(trim(regexp_replace(t,'\\s+',' ','g')))>100 then 1e0 end direct, least(length(t)/greatest(p*500,1),1e0) ocr, case when length(t)>0 then least(length(t)/500,1e0) else 0e0 end single from "
                             "(select doc_id, array_to_string(list_filter(string_split(text,chr(10)), lambda x: trim(x)<>''), chr(10)||chr(10)||'---'||chr(10)||chr(10)) t, len(string_split(text,chr(10))) p from documents) u",
    "choose_text": "select doc_id, length(t)>=180 usable, cast(length(t) as int) extraction_chars, case when length(t)>0 then t else 'Arquivo: '||filename||'. OCR não extraiu conteúdo suficiente.' end source_text, case when length(t)>=180 then 'LOW_CONFIDENCE:50' else 'LOW_CONFIDENCE:50|LOW_EXTRACTION_CHARS:'||length(t) end fallback_reason from "
                   "(select doc_id, 'f'||doc_id||'.pdf' filename, case when length(p)<180 and length(coalesce(s,''))>length(p) then s else p end t from (select doc_id, case when doc_id%5=0 then '' when doc_id%2=0 then string_split(text,chr(10))[1] else text end p, case when doc_id%3=0 then text end s from documents) a) b",
    "chunk_text": _chunks(CHUNK) + "select w.doc_id, w.chunk, string_agg(p.part, chr(10) order by p.i) as text from walk w join parts p on p.doc_id=w.doc_id and p.i=w.i group by w.doc_id, w.chunk",
    "chunk_text_default": _chunks(30000) + "select w.doc_id, w.chunk, string_agg(p.part, chr(10) order by p.i) as text from walk w join parts p on p.doc_id=w.doc_id and p.i=w.i group by w.doc_id, w.chunk",
    "merge_chunk_questions": with_views(
        ("found", "select exam_id, q_order position, (q_order-1)%7+1 q_order, question_text, oa, unnest(range(1,2+(exam_id+q_order)%3)) chunk from fx_questions"),
        "select exam_id, q_order, chunk, position, question_text, oa from (select *, row_number() over (partition by exam_id, q_order order by chunk, position) rn from found) t where rn=1"),
}
