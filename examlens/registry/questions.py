"""Question parsing: registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.operators import questions as q
from examlens.registry.fixtures import view, with_views
from examlens.sources.sinks import materialize


def steps(lines: str, pages: str | None = None, allow_reset: bool = True) -> list[tuple[str, str]]:
    """The parse as SQL steps over a lines view: a machine that reads an exam line by line."""
    img = f"select distinct exam_id, page from {pages} where has_images" if pages else "select cast(null as bigint) exam_id, cast(null as int) page where false"
    words = lambda t: f"len(regexp_extract_all({t},'\\S+'))"
    each = lambda f, sep=", ": sep.join(f(x) for x in "abcde")
    # The state before a line, what the line means to it, the judged item, the state after it.
    state = "role,on_,last,num,page,img,line,sw,se," + each(lambda x: f"w{x}") + ",opt_line,b0,b1,bn,bs,bu,bf,nc,forced,pn,pp,pimg,pl,gen"
    machine = f"""
 select exam_id, 0::bigint i, 'scan' as "role", false on_, -1 "last", -1 num, -1 page, false img, -1 line, 0 sw, false se, {each(lambda x: f'0 w{x}')}, -1 opt_line, -1 b0, -1 b1, 0 bn, 0 bs, 0 bu, false bf, 0 nc, -1 forced, -1 pn, -1 pp, false pimg, -1 pl, 0 gen, false acc, 'none' use, false is_start,
  null::struct(num int, page int, line int, ends int, score int, stem int, useful int, ok boolean, forced boolean, src boolean, gen int) fin from (select distinct exam_id from ln) e
 union all
 select exam_id, i, case when opens then 'stem' when is_opt then l_letter else "role" end, on_ or opens, case when fin is not null and fin.ok then fin.num else "last" end,
  case when opens then o_num else num end, case when opens then o_page else page end, case when opens then o_img else img end, case when opens then o_line else line end,
  case when opens then o_w when adds and "role"='stem' then sw+raw_w else sw end, case when opens then o_e when adds and "role"='stem' and raw_w>0 then raw_e else se end,
  {each(lambda x: f"case when opens then 0 when is_opt then coalesce(z{x},w{x}) when adds and role='{x.upper()}' then w{x}+raw_w else w{x} end")},
  case when opens then -1 when is_opt then line_no else opt_line end,
  case when fin.ok then case when bn>0 and fin.num=b1+1 then b0 else fin.num end else b0 end, case when fin.ok then fin.num else b1 end,
  case when fin.ok then case when bn>0 and fin.num=b1+1 then bn+1 else 1 end else bn end, case when fin.ok then case when bn>0 and fin.num=b1+1 then bs+fin.score else fin.score end else bs end,
  case when fin.ok then case when bn>0 and fin.num=b1+1 then bu+fin.useful else fin.useful end else bu end, case when fin.ok then case when bn>0 and fin.num=b1+1 then bf else nc=0 end else bf end,
  nc+cast(coalesce(fin.ok,false) as int), case when fin.forced then -1 else forced end,
  case when kind='alone' and acc then n when kind in ('alone') then pn else -1 end, case when kind='alone' and acc then l_page else pp end, case when kind='alone' and acc then l_img else pimg end,
  case when kind='alone' and (acc or pn>=0) then line_no else pl end, gen, acc,
  case when opens and kind='start' and not as_text then 'rest' when opens then 'raw' when is_opt then 'opts' when adds then 'raw' else 'none' end, opens, fin
 from (select *, case when on_ and (opens or kind='end') then {{'num':num,'page':page,'line':line,'ends':case when kind='end' then 2147483647 else o_line end,'score':sc,'stem':sw,'useful':useful,'ok':sw>=5 and useful>=1 and sc>=45 and forced<>num,'forced':forced=num,'src':img and sw<8,'gen':gen}} end fin
  from (select *, cast(greatest(0,least(100, case when sw>=10 then 30 else 0 end+present*15+case when good=5 then 10 else 0 end-case when img and sw<8 then 20 else 0 end-case when sw>5 and not se then 15 else 0 end-(5-present)*10)) as int) sc
  from (select *, {each(lambda x: f'cast(w{x}>=1 as int)', '+')} present, {each(lambda x: f'cast(w{x}>=3 as int)', '+')} good, {each(lambda x: f'cast(w{x}>=2 as int)', '+')} useful,
   kind='option' and on_ is_opt, on_ and not opens and not acc and (kind not in ('option','end','alone') or (kind='alone' and "role"='stem' and pn<0)) adds,
   case when as_text then pn else n end o_num, case when as_text then pp else l_page end o_page, case when as_text then pimg else l_img end o_img, case when as_text then pl else line_no end o_line,
   case when as_text then raw_w else own_w end o_w, case when as_text then raw_e else own_e end o_e
  from (select * replace (case when rs then -1 else "last" end as "last", case when rs then 0 else nc end as nc, case when rs then 0 else bn end as bn, case when rs then gen+1 else gen end as gen, case when rs and on_ and num between b0 and b1+1 then num else forced end as forced),
   as_text or (kind='start' and acc) opens
  from (select *, not as_text and kind in ('alone','start') and (fwd or rs) acc
  from (select *, {str(allow_reset).lower()} and kind in ('alone','start') and not as_text and not fwd and "last">=0 and n=1 and bn>=4 and bf and (bs<=40*bn or bu<=3*bn) rs
  from (select l.exam_id, l.i, l.line_no, l.kind, l.n, l.l_page, l.l_img, l.own_w, l.own_e, l.raw_w, l.raw_e, l.l_letter, {each(lambda x: f'l.z{x}')}, w.* exclude (exam_id, i, acc, use, is_start, fin),
   case when w."last"<0 then l.n<=20 else l.n>w."last" and l.n<=w."last"+5 end fwd, w.pn>=0 and l.kind not in ('alone','option','end') as_text
   from walk w join ln l on l.exam_id=w.exam_id and l.i=w.i+1) a) b) c) d) e) f) g"""
    out = [
        ("stripped", f"select * from (select exam_id, page, line_no, case when regexp_matches(text,'(?i)\\bRASCUNHO\\b') then rtrim(regexp_replace(text,'(?is)\\bRASCUNHO\\b.*','')) else text end as text from {lines}) t where text<>''"),
        ("cls", r"""select *, case when kind in ('alone','start') then cast(regexp_extract(text,'^\s*(\d{1,2})',1) as int) end num,
 case when kind='option' then regexp_extract(text,'^\s*\(([A-E])\)',1) end letter,
 case when kind='range' then cast(regexp_extract(text,'(?i)quest[õo]es?\s+(\d{1,2})\s+[ae]\s+(\d{1,2})',1) as int) end as first,
 case when kind='range' then cast(regexp_extract(text,'(?i)quest[õo]es?\s+(\d{1,2})\s+[ae]\s+(\d{1,2})',2) as int) end as last,
 case kind when 'alone' then '' when 'start' then trim(regexp_replace(text,'^\s*\d{1,2}\s*[.\-–—)]\s+','')) when 'option' then trim(regexp_replace(text,'^\s*\([A-E]\)\s*','')) else text end as rest
from (select *, case when regexp_matches(text,'^\s*\d{1,2}\s*$') then 'alone' when regexp_matches(text,'^\s*\d{1,2}\s*[.\-–—)]\s+') then 'start'
 when regexp_matches(text,'^\s*\([A-E]\)') then 'option' when regexp_matches(text,'(?i)quest[õo]es?\s+\d{1,2}\s+[ae]\s+\d{1,2}') then 'range'
 when regexp_matches(text,'(?i)^(Leia|Com base|Considere|A partir|Segundo|Observe|Analise|O texto|O trecho|O fragmento|Os textos)') then 'lead' else 'body' end kind from stripped) t"""),
        ("img", img),
        ("ln", f"""select c.*, row_number() over (partition by c.exam_id order by line_no) i, num n, page l_page, letter l_letter, {words('rest')} own_w, regexp_matches(trim(rest),'[.?!:;]$') own_e, {words('text')} raw_w, regexp_matches(trim(text),'[.?!:;]$') raw_e,
  exists (select 1 from img g where g.exam_id=c.exam_id and g.page=c.page) l_img, {each(lambda x: f"case when kind='option' then case when letter='{x.upper()}' then {words('parts[1]')} else list_extract([{words('substr(p,2)')} for p in parts[2:] if p[1]='{x.upper()}'],-1) end end z{x}")}
 from (select *, case when kind='option' then string_split(regexp_replace(rest,'\\s+\\(([B-E])\\)\\s*',chr(1)||'\\1','g'),chr(1)) end parts from cls
  union all select exam_id, 0, 2147483647, '', 'end', null, null, null, null, '', null from (select distinct exam_id from cls) z) c"""),
        (f"walk(exam_id,i,{state},acc,use,is_start,fin)".replace("role,on_,last", '"role",on_,"last"'), machine),
        ("items_", "select exam_id, fin.*, fin.ok and fin.gen<max(gen) over (partition by exam_id) back from (select exam_id, fin, max(gen) over (partition by exam_id) gen from walk) t where fin is not null"),
        ("verdict", "select exam_id, num, page, line, ends, score, stem, useful, src, ok and not back ok, back or forced rolled, case when ok and not back then 'real_question_confirmed' else 'instruction_block' end status from items_"),
        ("seg", """select w.exam_id, case when w.on_ then w.num else -1 end num, case when w.on_ then w.page end page, case when w.on_ then w.line else sh.shared_line end item_line, w.is_start and c.line_no=w.line is_start, c.line_no, c.kind, c.letter,
  case when w.on_ then case when w."role"='stem' then 'stem' else w."role" end end as "role", case when w.on_ and w.opt_line>=0 then cast(w.opt_line as bigint)*16+15 else 0 end mark, c.first, c.last,
  case when w.use='rest' then c.rest when w.use='opts' then c.rest else c.text end as text
 from walk w join ln c on c.exam_id=w.exam_id and c.i=w.i left join (select s.exam_id, s.shared_line from (select exam_id, min(line_no) shared_line from cls where kind in ('range','lead') group by exam_id) s) sh on sh.exam_id=w.exam_id
 where c.kind<>'end' and ((w.on_ and w.use<>'none') or (not w.on_ and c.line_no>=sh.shared_line and c.kind not in ('alone','start')))
 union all select w.exam_id, w.num, w.page, w.line, true, w.line, 'alone', null, 'stem', 0, null, null, '' from walk w join ln c on c.exam_id=w.exam_id and c.i=w.i where w.is_start and c.line_no<>w.line"""),
        ("pieces", r"""select exam_id, num, page, item_line, line_no, is_start, kind, first, last, k,
  case when k>0 then substr(part,1,1) when num>=0 and kind='option' then letter else coalesce("role",'stem') end as "role",
  case when num>=0 and kind='option' then line_no*16::bigint+case when k=0 then 15 else k end else mark end mark,
  case when k>0 then trim(substr(part,2)) when num>=0 and kind='option' then trim(part) else part end as text
 from (select *, parts[k+1] part from (select *, unnest(range(len(parts))) k from (select *, case when num>=0 and kind='option' then string_split(regexp_replace(text,'\s+\(([B-E])\)\s*',chr(1)||'\1','g'),chr(1)) else [text] end parts from seg) a) b) c"""),
        ("newest", 'select *, max(mark) over (partition by exam_id, item_line, num, "role") top from pieces'),
        ("asm", "select exam_id, item_line, num, max(page) page, min(line_no) first_line, "
                "min_by(first, line_no) filter (where kind='range') as first, min_by(last, line_no) filter (where kind='range') as last, "
                "trim(coalesce(string_agg(text,' ' order by line_no,k) filter (where \"role\"='stem'),'')) as text, "
                + ", ".join(f"trim(coalesce(string_agg(text,' ' order by line_no,k) filter (where \"role\"='{x}' and mark=top),'')) {x.lower()}" for x in "ABCDE")
                + " from newest group by exam_id, item_line, num"),
        ("shared", "select exam_id, case when first is not null then 'shared-'||first||'-'||last else 'shared-pre-'||first_line end shared_id, text, first, last from asm where num=-1"),
        ("items", """select a.exam_id, a.item_line, a.num, a.page, a.first_line, a.text, a.a, a.b, a.c, a.d, a.e, s.shared_id, s.text context_text,
  i.exam_id is not null and len(regexp_extract_all(a.text,'\\S+'))<8 requires_source
 from asm a left join shared s on s.exam_id=a.exam_id and a.num between s.first and s.last left join img i on i.exam_id=a.exam_id and i.page=a.page where a.num>=0"""),
        ("counted", "select *, len(regexp_extract_all(text,'\\S+')) stem_words, "
                    + "+".join(f"cast({x}<>'' as int)" for x in "abcde") + " present, "
                    + "+".join(f"cast({x}<>'' and len(regexp_extract_all({x},'\\S+'))>=3 as int)" for x in "abcde") + " good, "
                    + "+".join(f"cast(len(regexp_extract_all({x},'\\S+'))>=2 as int)" for x in "abcde") + " useful_options from items"),
        ("scored", "select *, cast(greatest(0,least(100, case when stem_words>=10 then 30 else 0 end + present*15 + case when good=5 then 10 else 0 end - case when requires_source then 20 else 0 end - case when trunc then 15 else 0 end - (5-present)*10)) as int) score, "
                   "concat_ws('; ', case when stem_words<10 then 'enunciado curto ('||stem_words||' palavras)' end, "
                   + ", ".join(f"case when {x}='' then 'alternativa {x.upper()} vazia' end" for x in "abcde")
                   + ", case when good<3 then 'alternativas com poucas palavras' end, case when requires_source then 'requer PDF (imagem detectada)' end, case when trunc then 'enunciado pode estar truncado' end) details "
                   "from (select *, stem_words>5 and not regexp_matches(text,'[.?!:;]$') trunc from counted) t"),
        ("judged", "select *, case when stem_words>=5 and useful_options>=1 and score>=45 then 'real_question_confirmed' else 'instruction_block' end status from scored"),
        ("parsed", "select j.* exclude (status), v.rolled, v.status from judged j join verdict v on v.exam_id=j.exam_id and v.line=j.item_line"),
    ]
    return out


QUESTION_COLUMNS = "exam_id, num, page, text, a, b, c, d, e, shared_id, context_text, requires_source, score, details, stem_words, useful_options"
_SQL_COLUMNS = QUESTION_COLUMNS.replace("stem_words", "cast(stem_words as int) stem_words")


def _classified(spark, sf, name="fx_lines_x"):
    return q.classify_lines(q.strip_scratch(view(spark, sf, name)))


def _scan(spark, sf, name="fx_lines_x"):
    return q.scan_numbers(q.number_spans(_classified(spark, sf, name), view(spark, sf, "fx_pages")))


def _segments(spark, sf):
    return q.segment_questions(_classified(spark, sf), _scan(spark, sf))


def _assembled(spark, sf):
    return q.assemble_questions(_segments(spark, sf))


def _items(spark, sf):
    return _assembled(spark, sf).filter("num >= 0")


def _attached(spark, sf):
    a = materialize(_assembled(spark, sf), "assembled")  # one scan and one assembly for the items and the texts
    return q.attach_shared_text(a.filter("num >= 0"), q.shared_texts(a)).select("exam_id", "item_line", "num", "shared_id", "context_text")


def _flat(df):
    return df.withColumn("details", F.array_join("details", "; "))


def _scored(spark, sf):
    return q.confidence_score(q.flag_requires_source(_items(spark, sf), view(spark, sf, "fx_pages")))


def _log(spark, sf):
    read = classified, scan = q.read_numbers(view(spark, sf, "fx_lines_x"), view(spark, sf, "fx_pages"))  # one scan for all events
    seg = q.segment_questions(classified, scan)
    texts = q.shared_texts(q.assemble_questions(q.segment_questions(classified, scan, items=False)))
    return q.parsing_log(seg, q.drop_weak_lead_block(scan), questions_of(spark, sf, "fx_lines_x", read), texts)


def questions_of(spark, sf, name="fx_lines", read=None):
    return q.parse_questions(view(spark, sf, name), view(spark, sf, "fx_pages"), read=read)


def _parsed(s, d):
    return _flat(questions_of(s, d, "fx_lines_x")).select(*QUESTION_COLUMNS.split(", "))


QUERIES = {
    "strip_scratch": lambda s, d: q.strip_scratch(view(s, d, "fx_lines_x")),
    "classify_lines": lambda s, d: _classified(s, d),
    "sequence_gate": lambda s, d: q.sequence_gate(_classified(s, d), False, view(s, d, "fx_pages")),
    "sequence_gate_reset": lambda s, d: q.sequence_gate(_classified(s, d), True, view(s, d, "fx_pages")),
    "segment_questions": lambda s, d: _segments(s, d).select("exam_id", "num", "item_line", "line_no", "is_start", "role", "text"),
    "split_inline_options": lambda s, d: q.split_inline_options(_classified(s, d)),
    "assemble_questions": lambda s, d: _items(s, d).select("exam_id", "item_line", "num", "page", "text", "a", "b", "c", "d", "e"),
    "shared_texts": lambda s, d: q.shared_texts(_assembled(s, d)),
    "attach_shared_text": _attached,
    "flag_requires_source": lambda s, d: q.flag_requires_source(_items(s, d), view(s, d, "fx_pages")).select(
        "exam_id", "item_line", "num", "page", "requires_source"),
    "confidence_score": lambda s, d: _flat(_scored(s, d)).select(
        "exam_id", "item_line", "num", "score", "details", "stem_words", "useful_options"),
    "confirm_questions": lambda s, d: q.confirm_questions(_scored(s, d)).select("exam_id", "item_line", "num", "score", "status"),
    "drop_weak_lead_block": lambda s, d: q.drop_weak_lead_block(_scan(s, d)).select(
        "exam_id", "num", F.col("line").alias("item_line"), "status", "rolled_back", "score", "stem_words", "useful_options", "requires_source"),
    "parsing_log": _log,
    "parse_questions": _parsed,
    "parse_questions_exact": _parsed,  # the name of the confirmed rule when there were two
}


def _oracle(select: str, lines: str = "fx_lines_x", pages: str | None = "fx_pages", **kw) -> str:
    return with_views(*steps(lines, pages, **kw), select)


_GATE = "select w.exam_id, c.page, c.line_no, c.n num, w.acc accepted from walk w join ln c on c.exam_id=w.exam_id and c.i=w.i where c.kind in ('alone','start')"
_KEPT = f"select {_SQL_COLUMNS} from parsed where status='real_question_confirmed'"
ORACLES = {
    "strip_scratch": _oracle("select exam_id, page, line_no, text from stripped"),
    "classify_lines": _oracle("select exam_id, page, line_no, text, kind, num, letter, first, last, rest from cls"),
    "sequence_gate": _oracle(_GATE, allow_reset=False),
    "sequence_gate_reset": _oracle(_GATE),
    "segment_questions": _oracle('select exam_id, num, item_line, line_no, is_start, "role", text from seg'),
    "split_inline_options": _oracle("""select exam_id, page, line_no, cast(k as int) k, case when k=0 then letter else substr(part,1,1) end letter, trim(case when k=0 then part else substr(part,2) end) as text
 from (select *, parts[k+1] part from (select *, unnest(range(len(parts))) k from (select *, string_split(regexp_replace(rest,'\\s+\\(([B-E])\\)\\s*',chr(1)||'\\1','g'),chr(1)) parts from cls where kind='option') x) y) z"""),
    "assemble_questions": _oracle("select exam_id, item_line, num, page, text, a, b, c, d, e from asm where num>=0"),
    "shared_texts": _oracle("select * from shared"),
    "attach_shared_text": _oracle("select exam_id, item_line, num, shared_id, context_text from items"),
    "flag_requires_source": _oracle("select exam_id, item_line, num, page, requires_source from items"),
    "confidence_score": _oracle("select exam_id, item_line, num, score, details, cast(stem_words as int) stem_words, useful_options from scored"),
    "confirm_questions": _oracle("select exam_id, item_line, num, score, status from judged"),
    "drop_weak_lead_block": _oracle("select exam_id, num, line item_line, status, rolled rolled_back, score, cast(stem as int) stem_words, cast(useful as int) useful_options, src requires_source from verdict"),
    "parsing_log": _oracle("""select exam_id, status as event, num, 'stem='||stem||' useful='||useful||' score='||score detail from verdict
 union all select exam_id, 'missing_options', num, concat_ws(', ',case when a='' then 'A' end,case when b='' then 'B' end,case when c='' then 'C' end,case when d='' then 'D' end,case when e='' then 'E' end) from parsed where status='real_question_confirmed' and ''=any([a,b,c,d,e])
 union all select exam_id, 'requires_source', num, null from verdict where src
 union all select exam_id, 'shared_text', null, first||'-'||last from shared where first is not null
 union all select exam_id, 'option_out_of_sequence', num, letter from (select *, lag("role") over (partition by exam_id, item_line order by line_no) p from seg where num>=0 and kind='option') t where p is not null and letter<>'A' and ascii(letter)<>ascii(p)+1
 union all select exam_id, 'total', null, cast(count(*) as varchar) from verdict where status='real_question_confirmed' group by exam_id
 union all select exam_id, 'sequence_reset', 1, min(num)||'-'||max(num) from verdict where rolled group by exam_id
 union all select exam_id, 'rollback', 1, cast(count(*) as varchar) from verdict where rolled group by exam_id"""),
    "parse_questions": _oracle(_KEPT),
    "parse_questions_exact": _oracle(_KEPT),
}
