"""Input views over the driver tables, in Spark SQL and in DuckDB SQL.

Each ``fx_*`` view gives an operator an input of its own shape. ``view`` builds
the Spark side for a data folder; ``with_views`` prefixes an oracle query with
the DuckDB side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from examlens.sources.sinks import materialize

SPARK_SQL = {
    "fx_lines": r"""
with w as (select doc_id, filter(split(regexp_replace(text,'\\s+',' '),' '), x -> x <> '') w from documents),
q as (select cast(doc_id div 10 as bigint) exam_id, cast(doc_id % 10 + 1 as int) q_order, doc_id,
  concat(array_join(slice(w,1,12),' '),'?') stem,
  transform(sequence(0,4), k -> array_join(slice(w,13+3*k,3),' ')) opts,
  transform(sequence(0, cast(ceil((greatest(size(w),28)-27)/12) as int)-1), j -> array_join(slice(w,28+12*j,12),' ')) more from w),
l as (select exam_id,q_order,doc_id, inline(filter(concat(array(
   named_struct('line_no',q_order*100000,'text', case when doc_id%13=0 then cast(q_order as string) else concat(q_order,'. ',stem) end),
   named_struct('line_no',q_order*100000+1,'text', case when doc_id%13=0 then stem else '' end),
   named_struct('line_no',q_order*100000+50002,'text', concat('(A) ',opts[0])), named_struct('line_no',q_order*100000+50003,'text', concat('(B) ',opts[1])),
   named_struct('line_no',q_order*100000+50004,'text', concat('(C) ',opts[2])), named_struct('line_no',q_order*100000+50005,'text', concat('(D) ',opts[3])),
   named_struct('line_no',q_order*100000+50006,'text', case when doc_id%17=0 then 'RASCUNHO' else concat('(E) ',opts[4]) end)),
   transform(more, (t, j) -> named_struct('line_no', q_order*100000 + if(doc_id%3=0, 2, 50010) + j, 'text', t))), s -> s.text<>'')) from q)
select exam_id, cast(1 + (row_number() over (partition by exam_id order by line_no) - 1) div 45 as int) page, line_no, text from l
""",
    "fx_lines_x": r"""
with b as (select exam_id, page, line_no, text, cast(floor(line_no/100000) as int) q,
   lead(text) over (partition by exam_id order by line_no) nxt from fx_lines)
select exam_id, page, line_no, case when (exam_id*10+q)%19=5 and line_no%100000=50002 then concat(text,' ',nxt) else text end text
 from b where not ((exam_id*10+q)%19=5 and line_no%100000=50003)
union all select distinct exam_id, 1, 50, 'Leia o texto a seguir para responder as questoes 1 a 3' from fx_lines where exam_id%5=0
union all select distinct exam_id, 1, 51, concat('Texto base do exame ', cast(exam_id as string), ' com algumas frases de apoio.') from fx_lines where exam_id%5=0
union all select distinct exam_id, 1, 250000, '50. fora de sequencia' from fx_lines where exam_id%6=1
union all select e.exam_id, 1, cast(i*10+j as int), case when j=0 then concat(cast(i as string),'. Verifique se este caderno contem todas as paginas numeradas e bem impressas.') else concat('(',substr('ABC',j,1),') opcao breve') end
 from (select exam_id, i, explode(sequence(0,3)) j from (select exam_id, explode(sequence(1,5)) i from (select distinct exam_id from fx_lines where exam_id%10=7) d) f) e
union all select exam_id, 1, cast(60+i as int), concat(cast(i as string),' - Confira os dados impressos na capa deste caderno antes de comecar.') from (select exam_id, explode(sequence(1,10)) i from (select distinct exam_id from fx_lines where exam_id%10=3) d) f
union all select distinct exam_id, 1, 80, '15. Nao e permitido o uso de aparelhos eletronicos na sala.' from fx_lines where exam_id%10=9
union all select exam_id, page, 990000 + line_no % 100000, text from fx_lines where exam_id%10=1 and line_no div 100000 = 9
""",
    "fx_pages": r"""
select exam_id, page, 595e0 page_width, 842e0 page_height, (exam_id+page)%7=0 has_images from fx_lines group by exam_id, page
""",
    "fx_fragments": r"""
select exam_id, page, line_no, k, str,
 cast(case when exam_id % 2 = 0 then 50 + 300 * (case when r >= 23 then 1 else 0 end) + 12 * k else 180 + 25 * ((k + r) % 10) + (case when k >= 10 then 2 else 0 end) end as double) x,
 cast(100 + 14 * (case when exam_id % 2 = 0 then r % 23 else r end) as double) + (case when k % 2 = 1 then 0.4e0 else 0e0 end) y,
 cast(case when k % 5 = 4 then 10 else 4 end as double) width, cast(case when (k+r)%11=3 then 18 when k%7=5 then 6 else 10 end as double) font_size
 from (select exam_id,page,line_no,r, posexplode(split(text,' ')) as (k,str) from (select *, cast(row_number() over (partition by exam_id,page order by line_no)-1 as int) r from fx_lines) t) u
 where str <> ''
 union all select exam_id, page, 0, 0, 'CONCURSO 2024', 50e0, 20e0, 80e0, 10e0 from fx_lines group by exam_id,page
 union all select exam_id, page, 9999, 0, cast(page as string), 290e0, 820e0, 6e0, 10e0 from fx_lines group by exam_id,page
""",
    "fx_key_lines": r"""
with e as (select exam_id, explode(sequence(0,1)) s from (select distinct exam_id from fx_lines) d),
 x as (select exam_id,s,q, case when (exam_id+q)%23=0 then '*' else substr('ABCDE',cast((exam_id*7+q*3+s)%5+1 as int),1) end l from (select exam_id, s, explode(sequence(1,10)) q from e) y)
select exam_id, s*100 line_no, concat('GABARITO ',cast(s+1 as string),' - PROVA ',substr('AB',s+1,1)) text from e
union all select exam_id, s*100+q, case q%4 when 0 then concat(cast(q as string),'-',l) when 1 then concat(cast(q as string),' ',l) when 2 then concat(cast(q as string),') ',l) else concat(cast(q as string),l) end from x
union all select exam_id, s*100+50, 'Questao 5 ANULADA' from e where exam_id%9=0
union all select exam_id, cast(400 + (line_no - 100000 * (line_no div 100000)) % 100 as int), regexp_replace(text, '[0-9]', '') from fx_lines where line_no between 150010 and 150030
""",
    "fx_uploads": r"""
select page_id upload_id, concat('prova (',cast(page_id as string),') ação.pdf') filename,
 case page_id%6 when 0 then 'image/png' when 1 then 'text/html' when 2 then 'image/jpg' else 'application/pdf' end content_type,
 case when page_id%11=0 then 0 else length(html)*cast(3000 as bigint) end size_bytes,
 case when page_id%4=0 then null else cast(page_id%7 as int) end page_start, case when page_id%3=0 then null else cast(page_id%5+1 as int) end page_end,
 case page_id%3 when 0 then ' a ' when 1 then 'B' else null end prova_type,
 case page_id%5 when 0 then 'escriturario' when 1 then 'nope' when 2 then 'agente-comercial' else null end template_id from pages
""",
    "fx_exams": r"""
select o_orderkey exam_id, concat('Exam ',cast(o_orderkey as string)) title,
 case when o_orderkey%5=0 then 'queued' when o_orderkey%5=1 then 'processing' when o_orderstatus='O' then 'reviewing' when o_orderstatus='F' then 'failed' else 'completed' end status,
 o_orderdate created_at, case when o_orderkey%4=0 then null else cast(o_orderkey%70 as int) end total_questions from orders
""",
    "fx_responses": r"""
select cast(doc_id div 10 as bigint) exam_id, cast(doc_id%10 as int) idx,
 case when doc_id%29=0 then '{oops' else concat('{"items":[{"index":', case when doc_id%31=0 then '99' else cast(doc_id%10 as string) end, ',"subject":" ', lang, ' ","topic":"', source, '","difficulty":"', case doc_id%4 when 0 then 'easy' when 1 then 'medium' when 2 then 'hard' else 'HARD' end, '"}]}') end response,
 cast(n_chars % 900 + 100 as bigint) prompt_tokens, cast(n_chars % 300 as bigint) output_tokens, cast(doc_id % 3 as int) day_no from documents
""",
    "fx_answers": r"""
select user_id session_id, exam_id, q_order,
 case event_type when 'click' then lower(substr('ABCDE',cast(event_id%5 as int)+1,1)) when 'error' then 'X' when 'view' then concat(substr('ABCDE',cast(event_id%5 as int)+1,1),') opt') else substr('ABCDE',cast(event_id%5 as int)+1,1) end raw_answer, ts answered_at, event_id from (
 select user_id, user_id % 20 exam_id, cast(event_id % 10 + 1 as int) q_order, event_type, event_id, ts from events
 union all select user_id + 1000000000, user_id % 20, cast(event_id % 10 + 1 as int), event_type, event_id + 1000000000, ts from events where event_id%17=5
 union all select user_id, user_id % 20, 77, event_type, event_id + 2000000000, ts from events where event_id%13=4) e
""",
    "fx_sessions": r"""
select distinct session_id, exam_id, 10 total_questions, case when session_id%6=0 then cast('2024-01-20 00:00:00' as timestamp_ntz) end finished_at from fx_answers where session_id < 1000000000
""",
    "fx_explicit": r"""
select exam_id, cast(floor(line_no/100000) as int) q_order, substr('ABCDE',cast((exam_id*7+cast(floor(line_no/100000) as int)*3)%5+1 as int),1) explicit_answer from fx_lines where line_no%100000=0
""",
}

# Views whose text differs in DuckDB.
DUCK_SQL = {
    "fx_lines": r"""
with w as (select doc_id, list_filter(string_split(regexp_replace(text,'\s+',' ','g'),' '), lambda x: x <> '') w from documents),
q as (select cast(doc_id//10 as bigint) exam_id, cast(doc_id%10+1 as int) q_order, doc_id,
  concat(array_to_string(list_slice(w,1,12),' '),'?') stem, w from w),
l as (select exam_id,q_order,doc_id, unnest(list_concat([
   {'line_no': q_order*100000, 'text': case when doc_id%13=0 then cast(q_order as varchar) else concat(q_order,'. ',stem) end},
   {'line_no': q_order*100000+1,'text': case when doc_id%13=0 then stem else '' end},
   {'line_no': q_order*100000+50002,'text': '(A) '||array_to_string(list_slice(w,13,15),' ')},
   {'line_no': q_order*100000+50003,'text': '(B) '||array_to_string(list_slice(w,16,18),' ')},
   {'line_no': q_order*100000+50004,'text': '(C) '||array_to_string(list_slice(w,19,21),' ')},
   {'line_no': q_order*100000+50005,'text': '(D) '||array_to_string(list_slice(w,22,24),' ')},
   {'line_no': q_order*100000+50006,'text': case when doc_id%17=0 then 'RASCUNHO' else '(E) '||array_to_string(list_slice(w,25,27),' ') end}],
   list_transform(range(cast(ceil((greatest(len(w),28)-27)/12) as int)), lambda j: {'line_no': cast(q_order*100000 + case when doc_id%3=0 then 2 else 50010 end + j as int), 'text': array_to_string(list_slice(w,28+12*j,39+12*j),' ')}))) s from q)
select exam_id, cast(1 + (row_number() over (partition by exam_id order by s.line_no) - 1) // 45 as int) page, s.line_no line_no, s.text text from l where s.text<>''
""",
    "fx_lines_x": r"""
with b as (select exam_id, page, line_no, text, cast(floor(line_no/100000) as int) q,
   lead(text) over (partition by exam_id order by line_no) nxt from fx_lines)
select exam_id, page, line_no, case when (exam_id*10+q)%19=5 and line_no%100000=50002 then concat(text,' ',nxt) else text end text
 from b where not ((exam_id*10+q)%19=5 and line_no%100000=50003)
union all select distinct exam_id, 1, 50, 'Leia o texto a seguir para responder as questoes 1 a 3' from fx_lines where exam_id%5=0
union all select distinct exam_id, 1, 51, concat('Texto base do exame ', cast(exam_id as varchar), ' com algumas frases de apoio.') from fx_lines where exam_id%5=0
union all select distinct exam_id, 1, 250000, '50. fora de sequencia' from fx_lines where exam_id%6=1
union all select e.exam_id, 1, cast(i*10+j as int), case when j=0 then concat(cast(i as varchar),'. Verifique se este caderno contem todas as paginas numeradas e bem impressas.') else concat('(',substr('ABC',j,1),') opcao breve') end
 from (select exam_id, i, unnest(range(4)) j from (select exam_id, unnest(range(1,6)) i from (select distinct exam_id from fx_lines where exam_id%10=7) d) f) e
union all select exam_id, 1, cast(60+i as int), concat(cast(i as varchar),' - Confira os dados impressos na capa deste caderno antes de comecar.') from (select exam_id, unnest(range(1,11)) i from (select distinct exam_id from fx_lines where exam_id%10=3) d) f
union all select distinct exam_id, 1, 80, '15. Nao e permitido o uso de aparelhos eletronicos na sala.' from fx_lines where exam_id%10=9
union all select exam_id, page, 990000 + line_no % 100000, text from fx_lines where exam_id%10=1 and line_no // 100000 = 9
""",
    "fx_fragments": r"""
select exam_id, page, line_no, k, str,
 cast(case when exam_id % 2 = 0 then 50 + 300 * (case when r >= 23 then 1 else 0 end) + 12 * k else 180 + 25 * ((k + r) % 10) + (case when k >= 10 then 2 else 0 end) end as double) x,
 cast(100 + 14 * (case when exam_id % 2 = 0 then r % 23 else r end) as double) + (case when k % 2 = 1 then 0.4e0 else 0e0 end) y,
 cast(case when k % 5 = 4 then 10 else 4 end as double) width, cast(case when (k+r)%11=3 then 18 when k%7=5 then 6 else 10 end as double) font_size
 from (select exam_id,page,line_no,r, unnest(string_split(text,' ')) str, cast(unnest(range(len(string_split(text,' ')))) as int) k from (select *, cast(row_number() over (partition by exam_id,page order by line_no)-1 as int) r from fx_lines) t) u
 where str <> ''
 union all select exam_id, page, 0, 0, 'CONCURSO 2024', 50e0, 20e0, 80e0, 10e0 from fx_lines group by exam_id,page
 union all select exam_id, page, 9999, 0, cast(page as varchar), 290e0, 820e0, 6e0, 10e0 from fx_lines group by exam_id,page
""",
    "fx_key_lines": r"""
with e as (select exam_id, cast(unnest(range(2)) as int) s from (select distinct exam_id from fx_lines) d),
 x as (select exam_id,s,q, case when (exam_id+q)%23=0 then '*' else substr('ABCDE',cast((exam_id*7+q*3+s)%5+1 as int),1) end l from (select exam_id, s, cast(unnest(range(1,11)) as int) q from e) y)
select exam_id, s*100 line_no, concat('GABARITO ',cast(s+1 as varchar),' - PROVA ',substr('AB',s+1,1)) text from e
union all select exam_id, s*100+q, case q%4 when 0 then concat(cast(q as varchar),'-',l) when 1 then concat(cast(q as varchar),' ',l) when 2 then concat(cast(q as varchar),') ',l) else concat(cast(q as varchar),l) end from x
union all select exam_id, s*100+50, 'Questao 5 ANULADA' from e where exam_id%9=0
union all select exam_id, cast(400 + (line_no % 100000) % 100 as int), regexp_replace(text, '[0-9]', '', 'g') from fx_lines where line_no between 150010 and 150030
""",
    "fx_uploads": r"""
select page_id upload_id, concat('prova (',cast(page_id as varchar),') ação.pdf') filename,
 case page_id%6 when 0 then 'image/png' when 1 then 'text/html' when 2 then 'image/jpg' else 'application/pdf' end content_type,
 case when page_id%11=0 then 0 else length(html)*cast(3000 as bigint) end size_bytes,
 case when page_id%4=0 then null else cast(page_id%7 as int) end page_start, case when page_id%3=0 then null else cast(page_id%5+1 as int) end page_end,
 case page_id%3 when 0 then ' a ' when 1 then 'B' else null end prova_type,
 case page_id%5 when 0 then 'escriturario' when 1 then 'nope' when 2 then 'agente-comercial' else null end template_id from pages
""",
    "fx_exams": r"""
select o_orderkey exam_id, concat('Exam ',cast(o_orderkey as varchar)) title,
 case when o_orderkey%5=0 then 'queued' when o_orderkey%5=1 then 'processing' when o_orderstatus='O' then 'reviewing' when o_orderstatus='F' then 'failed' else 'completed' end status,
 o_orderdate created_at, case when o_orderkey%4=0 then null else cast(o_orderkey%70 as int) end total_questions from orders
""",
    "fx_responses": r"""
select cast(doc_id//10 as bigint) exam_id, cast(doc_id%10 as int) idx,
 case when doc_id%29=0 then '{oops' else concat('{"items":[{"index":', case when doc_id%31=0 then '99' else cast(doc_id%10 as varchar) end, ',"subject":" ', lang, ' ","topic":"', source, '","difficulty":"', case doc_id%4 when 0 then 'easy' when 1 then 'medium' when 2 then 'hard' else 'HARD' end, '"}]}') end response,
 cast(n_chars % 900 + 100 as bigint) prompt_tokens, cast(n_chars % 300 as bigint) output_tokens, cast(doc_id % 3 as int) day_no from documents
""",
    "fx_sessions": r"""
select distinct session_id, exam_id, 10 total_questions, case when session_id%6=0 then cast('2024-01-20 00:00:00' as timestamp) end finished_at from fx_answers where session_id < 1000000000
""",
}

_QUESTIONS = r"""
select exam_id, q_order, cast(exam_id*100+q_order as bigint) question_id, page source_page,
 trim(concat(coalesce(s0,''),' ',coalesce(s1,''),' ',coalesce(s2,''))) question_text, oa, ob, oc, od, oe,
 case when exam_id%5=0 and q_order<=3 then concat('Texto base do exame ',cast(exam_id as string)) end context_text,
 case when (exam_id+q_order)%6=0 then concat(' ',oa,' ') when (exam_id+q_order)%6=1 then '' end subject,
 case (exam_id+q_order)%8 when 0 then null when 1 then lower(substr('ABCDE',cast((exam_id*7+q_order*3)%5+1 as int),1)) when 2 then concat(substr('ABCDE',cast((exam_id*7+q_order*3)%5+1 as int),1),') x') else substr('ABCDE',cast((exam_id*7+q_order*3)%5+1 as int),1) end correct_answer,
 case when (exam_id+q_order)%7=0 then 'failed' when (exam_id+q_order)%4=0 then 'classified' else 'pending' end classification_status,
 cast(least(length(trim(concat(coalesce(s0,''),' ',coalesce(s1,''),' ',coalesce(s2,'')))),100) as double) confidence,
 case when (exam_id+q_order)%3=0 then concat('Ver ',oa) when (exam_id+q_order)%3=1 then s3 end explanation
from (select exam_id, cast(floor(line_no/100000) as int) q_order, min(page) page,
  max(case when line_no%100000=0 then regexp_replace(text,'^[0-9]+[.]? ?','') end) s0,
  max(case when line_no%100000=1 then text end) s1, LISTED(case when line_no%100000 between 2 and 50001 then text end) s2, LISTED(case when line_no%100000>50006 then text end) s3,
  max(case when line_no%100000=50002 then substr(text,5) end) oa, max(case when line_no%100000=50003 then substr(text,5) end) ob,
  max(case when line_no%100000=50004 then substr(text,5) end) oc, max(case when line_no%100000=50005 then substr(text,5) end) od,
  max(case when line_no%100000=50006 and text like '(E)%' then substr(text,5) end) oe
 from fx_lines group by exam_id, cast(floor(line_no/100000) as int)) t
"""
# The one construct that has no common spelling: texts joined in line order.
SPARK_SQL["fx_questions"] = re.sub(r"LISTED\((.*?)\) (s\d)", r"listagg(\1, ' ') within group (order by line_no) \2", _QUESTIONS)
DUCK_SQL["fx_questions"] = re.sub(r"LISTED\((.*?)\) (s\d)", r"string_agg(\1, ' ' order by line_no) \2", _QUESTIONS).replace("as string", "as varchar")

SPARK_SQL["fx_exam_info"] = """
select exam_id, case exam_id%3 when 0 then ' a ' when 1 then 'B' else null end booklet, exam_id%4<>3 has_key,
 case exam_id%5 when 0 then 'escriturario' when 1 then 'nope' when 2 then 'agente-comercial' when 3 then 'agente-tecnologia' else null end template_id,
 case when exam_id%7=0 then 2 when exam_id%7=1 then 9 end page_start, case when exam_id%6=0 then 2 when exam_id%6=1 then 1 end page_end
from (select distinct exam_id from fx_lines union all select distinct exam_id + 1000000 from fx_lines where exam_id%11=3) t
"""

TABLES = ("documents", "pages", "events", "orders", "conversations", "labels")


def _parents(sql: str) -> list[str]:
    names = set(re.findall(r"\bfx_\w+", sql))
    return [n for n in SPARK_SQL if n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_staged: dict[tuple[str, ...], DataFrame] = {}
# Views that are stored by the columns that their rows are worked on by, and the rows of their parent that go to one bucket.
_STORED_BY = {"fx_fragments": (["exam_id", "page"], "fx_lines", 100_000)}


def _stored(df: DataFrame, spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in _STORED_BY:
        return materialize(df, name)
    by, parent, rows = _STORED_BY[name]
    of_shuffle = rows * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df, name, by, max(1, -(-view(spark, sf_dir, parent).count() // of_shuffle)))


def view(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The view as a table: derived by Spark once per session and folder, then read. With ``columns`` only
    these are derived, for queries that use no others; a view that is there as a whole is read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if columns and key not in _staged:
        key += columns
    if key not in _staged:
        derived = derive(spark, sf_dir, name)
        _staged[key] = materialize(derived.select(*columns), name) if columns else _stored(derived, spark, sf_dir, name)
    return _staged[key].select(*columns) if columns else _staged[key]


def once(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view for a query that reads it once: part of the query's plan, not written first; a table that is there is read."""
    return _staged.get((spark.sparkContext.applicationId, sf_dir, name)) or derive(spark, sf_dir, name)


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SPARK_SQL[name]
    inputs = {}
    for parent in _parents(sql):
        inputs[parent] = view(spark, sf_dir, parent)
    for t in TABLES:
        if re.search(rf"\bfrom {t}\b", sql):
            inputs[t] = table(spark, sf_dir, t)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in inputs:
        sql = re.sub(rf"\b{n}\b", "{" + n + "}", sql)
    return spark.sql(sql, **inputs)


def _needed(sql: str) -> list[str]:
    """Views named in ``sql``, parents first."""
    found: list[str] = []

    def add(text: str) -> None:
        for n in _parents(text):
            if n not in found:
                add(DUCK_SQL.get(n, SPARK_SQL[n]))
                found.append(n)

    add(sql)
    return found


def with_views(*parts: tuple[str, str] | str) -> str:
    """Oracle query: named steps ``(name, sql)`` and a final select, after the views used."""
    *steps, final = parts
    text = " ".join([s[1] for s in steps] + [final])
    ctes = [(n, DUCK_SQL.get(n, SPARK_SQL[n])) for n in _needed(text)] + list(steps)
    if not ctes:
        return final
    body = ",\n".join(f"{n} as materialized ({sql})" if "(" not in n else f"{n} as ({sql})" for n, sql in ctes)
    return f"with recursive {body}\n{final}"
