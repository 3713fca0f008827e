"""Answer keys: registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlens.operators import keys as k
from examlens.registry.fixtures import view, with_views


def _lines(s, d):
    return view(s, d, "fx_key_lines")


def _sections(s, d):
    return k.split_key_sections(_lines(s, d))


def _chosen(s, d):
    return k.select_key_section(k.section_sizes(_sections(s, d)), view(s, d, "fx_exam_info"))


def _resolved(s, d):
    return k.resolve_answers(k.extract_answer_pairs(_lines(s, d)), ["exam_id"])


QUERIES = {
    "booklet_type": lambda s, d: _lines(s, d).select("exam_id", "line_no", k.booklet_type(F.col("text")).alias("booklet")),
    "split_key_sections": lambda s, d: _sections(s, d).select("exam_id", "line_no", "section", "booklet"),
    "extract_answer_pairs": lambda s, d: k.extract_answer_pairs(_lines(s, d)),
    "select_key_section": _chosen,
    "resolve_answers": _resolved,
    "apply_annulments": lambda s, d: k.apply_annulments(_resolved(s, d), k.annulled_numbers(_lines(s, d))),
    "answer_key_stats": lambda s, d: k.answer_key_stats(k.resolve_keys(_lines(s, d), view(s, d, "fx_exam_info"))).select(
        "exam_id", "answers", "annulled", "total", "pairs", "low_coverage"),
    "parse_answer_keys": lambda s, d: k.parse_answer_keys(_lines(s, d), view(s, d, "fx_exam_info")),
}

_TYPE = r"upper(coalesce(nullif(regexp_extract(text,'(?i)\bprova\s*[:\-]?\s*([A-D])\b',1),''), nullif(regexp_extract(text,'(?is)\bgabarito\b.{0,20}?\bprova\s*[:\-]?\s*([A-D])\b',1),''), nullif(regexp_extract(text,'(?i)\bgabarito\s*[:\-]?\s*([A-D])\b',1),'')))"
_PATTERNS = [r"\s*[-–:.]\s*", r"\s+", r"\)\s*", ""]
# RE2 has no look-ahead: separators are doubled, so that a match may consume the one behind it.
_ALL_PAIRS = " union all ".join(
    f"select exam_id, line_no, {i} pattern, pos, cast(regexp_extract(m,'[0-9]+') as int) q_order, upper(regexp_extract(m,'([A-Ea-e*])[\\s,;]*$',1)) answer from "
    f"(select exam_id, line_no, cast(unnest(range(len(ms))) as int) pos, unnest(ms) m from (select exam_id, line_no, regexp_extract_all(regexp_replace(text,'([\\s,;])','\\1\\1','g'), '(?:^|[\\s,;])\\d{{1,3}}{p}[A-Ea-e*](?:$|[\\s,;])') ms from fx_key_lines) t) u"
    for i, p in enumerate(_PATTERNS, 1)
)
STEPS = [
    ("typed", f"select *, {_TYPE} tp from fx_key_lines"),
    ("headed", r"select *, regexp_matches(text,'(?i)\b(gabarito|prova)\b') and (tp is not null or regexp_matches(text,'(?i)\bgabarito\b')) h from typed"),
    ("sectioned", "select exam_id, line_no, text, case when any_h then section else -1 end section, booklet from (select *, bool_or(h) over (partition by exam_id) any_h, "
                  "last_value(case when h then line_no end ignore nulls) over w section, case when last_value(case when h then line_no end ignore nulls) over w is not null then arg_max(case when h then coalesce(tp,'-') end, case when h then line_no end) over w end booklet "
                  "from headed window w as (partition by exam_id order by line_no rows between unbounded preceding and current row)) t where section is not null or not any_h"),
    ("pairs", _ALL_PAIRS),
    ("sizes", "select s.exam_id, s.section, nullif(max(s.booklet),'-') booklet, count(p.q_order) pairs from sectioned s left join pairs p on p.exam_id=s.exam_id and p.line_no=s.line_no group by s.exam_id, s.section"),
    ("wish", "select exam_id, nullif(regexp_extract(upper(trim(booklet)),'^([A-D])$',1),'') w from fx_exam_info"),
    ("sized", "select z.*, w.w, bool_or(z.booklet=w.w) over (partition by z.exam_id) m, (select count(distinct booklet) from sizes y where y.exam_id=z.exam_id) nt, row_number() over (partition by z.exam_id order by z.pairs desc, z.section) rn from sizes z left join wish w on w.exam_id=z.exam_id"),
    ("chosen", "select exam_id, section, booklet, pairs from sized where case when coalesce(m,false) then coalesce(booklet=w,false) when nt>1 then rn=1 else true end"),
    ("kept", "select s.* from sectioned s join chosen c on c.exam_id=s.exam_id and c.section=s.section"),
    ("kept_pairs", "select p.* from pairs p join kept k on k.exam_id=p.exam_id and k.line_no=p.line_no where p.q_order between 1 and 200"),
    ("kept_notes", r"select distinct exam_id, cast(regexp_extract(text,'(\d{1,3})',1) as int) q_order from kept where regexp_matches(text,'(?i)anulad[ao]') and regexp_matches(text,'\d')"),
    ("final", "select coalesce(a.exam_id,n.exam_id) exam_id, coalesce(a.q_order,n.q_order) q_order, case when n.exam_id is not null then '*' else a.answer end answer, n.exam_id is not null or a.answer='*' annulled, coalesce(a.pairs,0) pairs from (select exam_id, q_order, min_by(answer,line_no*100000+pattern*1000+pos) answer, count(*) pairs from kept_pairs group by exam_id, q_order) a full join kept_notes n on n.exam_id=a.exam_id and n.q_order=a.q_order"),
]
_RESOLVED = "select exam_id, q_order, min_by(answer,line_no*100000+pattern*1000+pos) answer, min_by(answer,line_no*100000+pattern*1000+pos)='*' annulled from pairs where q_order between 1 and 200 group by exam_id, q_order"
_NOTES = r"select distinct exam_id, cast(regexp_extract(text,'(\d{1,3})',1) as int) q_order from fx_key_lines where regexp_matches(text,'(?i)anulad[ao]') and regexp_matches(text,'\d')"

ORACLES = {
    "booklet_type": with_views(*STEPS, "select exam_id, line_no, tp booklet from typed"),
    "split_key_sections": with_views(*STEPS, "select exam_id, line_no, section, nullif(booklet,'-') booklet from sectioned"),
    "extract_answer_pairs": with_views(*STEPS, "select exam_id, line_no, pattern, pos, q_order, answer from pairs"),
    "select_key_section": with_views(*STEPS, "select * from chosen"),
    "resolve_answers": with_views(*STEPS, _RESOLVED),
    "apply_annulments": with_views(*STEPS, f"select coalesce(a.exam_id,n.exam_id) exam_id, coalesce(a.q_order,n.q_order) q_order, case when n.exam_id is not null then '*' else a.answer end answer, n.exam_id is not null or a.annulled annulled from ({_RESOLVED}) a full join ({_NOTES}) n on n.exam_id=a.exam_id and n.q_order=a.q_order"),
    "answer_key_stats": with_views(*STEPS, "select exam_id, count(*) filter (where not annulled) answers, count(*) filter (where annulled) annulled, count(*) total, cast(sum(pairs) as bigint) pairs, count(*)<10 low_coverage from final group by exam_id"),
    "parse_answer_keys": with_views(*STEPS, "select exam_id, q_order, answer from final where not annulled and q_order>0"),
}
