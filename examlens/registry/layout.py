"""Layout: registered queries and their DuckDB counterparts."""

from __future__ import annotations

from examlens.operators import layout as y
from examlens.registry.fixtures import once, view, with_views
from examlens.sources.sinks import materialize

_FRAG = ["exam_id", "page", "line_no", "k", "str", "x", "y", "width", "font_size"]


def _frags(s, d):
    return view(s, d, "fx_fragments")


def _pages(s, d):
    return view(s, d, "fx_pages")


def _tagged(s, d):
    return y.tag_zones(_frags(s, d), _pages(s, d))


def _body(s, d):
    t = _tagged(s, d)
    return y.strip_headers_footers(t, y.repeated_zone_text(t, _pages(s, d)), _pages(s, d))


def _columned(s, d):
    b = _body(s, d)
    return y.assign_columns(b, y.detect_columns(b, _pages(s, d)))


def _built(s, d):
    return y.build_lines(y.group_lines(_columned(s, d)))


_LINE = ["exam_id", "page", "line_no", "text", "column", "line_y", "line_x", "font_size"]

QUERIES = {
    "normalize_fragments": lambda s, d: y.normalize_fragments(_frags(s, d), _pages(s, d)),
    "clip_page_range": lambda s, d: y.clip_page_range(once(s, d, "fx_fragments"), _pages(s, d), view(s, d, "fx_exam_info")),
    "tag_zones": _tagged,
    "repeated_zone_text": lambda s, d: y.repeated_zone_text(_tagged(s, d), _pages(s, d)),
    "strip_headers_footers": _body,
    "x_histogram": lambda s, d: y.x_histogram(_body(s, d), _pages(s, d)),
    "detect_columns": lambda s, d: y.detect_columns(_body(s, d), _pages(s, d)),
    "assign_columns": _columned,
    "group_lines": lambda s, d: y.group_lines(_columned(s, d)),
    "group_lines_exact": lambda s, d: y.group_lines(_columned(s, d)),  # the name of the rule when there were two
    "build_lines": _built,
    "reading_order": lambda s, d: y.reading_order(materialize(_built(s, d), "built", y.PAGE)).select(*_LINE),
    "reconstruct_layout": lambda s, d: y.reconstruct_layout(_frags(s, d), _pages(s, d)).select(*_LINE),
}

_ZONE_KEY = r"regexp_replace(lower(trim(str)),'\s+',' ','g')"
STEPS = [
    ("npages", "select exam_id, count(*) n_pages from fx_pages group by exam_id"),
    ("tagged", "select f.*, case when f.y/p.page_height<0.08e0 then 'header' when f.y/p.page_height>0.92e0 then 'footer' end as zone from fx_fragments f left join fx_pages p on p.exam_id=f.exam_id and p.page=f.page"),
    ("repeated", f"select c.*, n.n_pages from (select exam_id, str_key, count(distinct page) on_pages from (select exam_id, page, {_ZONE_KEY} str_key from tagged where zone is not null) t where length(str_key)>=2 group by exam_id, str_key) c join npages n on n.exam_id=c.exam_id where n.n_pages>=2 and c.on_pages/n.n_pages>=0.7e0"),
    ("body", f"select t.* exclude (zone) from tagged t left join npages n on n.exam_id=t.exam_id where t.zone is null or n.n_pages<2 or not (exists (select 1 from repeated r where r.exam_id=t.exam_id and r.str_key={_ZONE_KEY}) or regexp_matches({_ZONE_KEY},'^\\d{{1,4}}$') or length({_ZONE_KEY})<=1)"),
    ("hist", "select g.exam_id, g.page, g.bucket, count(b.str) n from (select exam_id, page, page_width, cast(unnest(range(100)) as int) bucket from fx_pages) g left join body b on b.exam_id=g.exam_id and b.page=g.page and least(floor(b.x/(g.page_width/100)),99)=g.bucket group by g.exam_id, g.page, g.bucket"),
    ("total", "select exam_id, page, sum(n) tot from hist group by exam_id, page"),
    ("sparse", "select h.exam_id, h.page, h.bucket, h.bucket-row_number() over (partition by h.exam_id,h.page order by h.bucket) grp from hist h join total t on t.exam_id=h.exam_id and t.page=h.page where h.bucket between 30 and 70 and t.tot>=10 and h.n<=ceil(0.03e0*t.tot)"),
    ("runs", "select exam_id, page, min(bucket) a, max(bucket) z, count(*) w from sparse group by exam_id, page, grp having count(*)>=5"),
    ("best", "select * from (select *, row_number() over (partition by exam_id, page order by w desc, z desc) rn from runs) t where rn=1"),
    ("lay", "select p.exam_id, p.page, b.a is not null double_column, cast(floor((b.a+b.z)/2e0*(p.page_width/100)+0.5e0) as int) split_x, p.page_width from fx_pages p left join best b on b.exam_id=p.exam_id and b.page=p.page"),
    ("columned", "select b.*, case when l.split_x is null then 'single' when b.x<l.split_x then 'left' else 'right' end as \"column\" from body b left join lay l on l.exam_id=b.exam_id and l.page=b.page"),
    ("folded", """select exam_id, page, "column", list(str order by y,x,str) strs, list(r order by y,x,str) rs, list_reduce(list({'y': y, 'fonts': font_size, 'n': 1, 'line': 0, 'lines': [0]} order by y,x,str),
 lambda a, f: case when abs(f.y-a.y) > greatest(0.55e0*a.fonts/a.n, 3e0) then {'y': f.y, 'fonts': f.fonts, 'n': 1, 'line': a.line+1, 'lines': list_append(a.lines, a.line+1)}
  else {'y': f.y, 'fonts': a.fonts+f.fonts, 'n': a.n+1, 'line': a.line, 'lines': list_append(a.lines, a.line)} end).lines as lines
 from (select *, row_number() over () r from columned) c group by exam_id, page, "column\""""),
    ("lined", 'select c.* exclude (r), cast(f.line_ord as int) line_ord from (select *, row_number() over () r from columned) c join (select unnest(rs) r, unnest(lines) line_ord from folded) f on f.r=c.r'),
    ("built", "select exam_id, page, \"column\", line_ord, trim(string_agg(part,'' order by x,y,str)) as text, arg_min(y,{'x':x,'y':y,'s':str}) line_y, min(x) line_x, max(font_size) font_size from (select *, case when x-lag(x+width) over w > 0.3e0*lag(case when font_size=0 then 10 else font_size end) over w then ' '||str else str end part from lined window w as (partition by exam_id,page,\"column\",line_ord order by x,y,str)) t group by exam_id, page, \"column\", line_ord"),
    ("ordered", "select *, cast(row_number() over (partition by exam_id order by page, case when \"column\"='right' then 1 else 0 end, line_y, line_ord) as int) line_no from built"),
]


def _o(select):
    return with_views(*STEPS, select)


ORACLES = {
    "normalize_fragments": with_views("select f.exam_id, f.page, f.line_no, f.k, f.str, round(f.x,1) x, round(p.page_height-f.y,1) y, round(coalesce(f.width,0),1) width, round(f.font_size,1) height, round(f.font_size,1) font_size from fx_fragments f join fx_pages p on p.exam_id=f.exam_id and p.page=f.page where trim(f.str)<>''"),
    "clip_page_range": with_views(
        ("lastp", "select exam_id, max(page) n from fx_pages group by exam_id"),
        ("rng", "select l.exam_id, least(coalesce(case when i.page_start>0 then i.page_start end,1),n) a, least(coalesce(case when i.page_end>0 then i.page_end end,n),n) z from lastp l left join fx_exam_info i on i.exam_id=l.exam_id"),
        "select f.* from fx_fragments f join rng r on r.exam_id=f.exam_id where f.page between r.a and greatest(r.a,r.z)"),
    "tag_zones": _o("select * from tagged"),
    "repeated_zone_text": _o("select * from repeated"),
    "strip_headers_footers": _o("select * from body"),
    "x_histogram": _o("select * from hist"),
    "detect_columns": _o("select * from lay"),
    "assign_columns": _o("select * from columned"),
    "group_lines": _o("select * from lined"),
    "group_lines_exact": _o("select * from lined"),
    "build_lines": _o("select * from built"),
    "reading_order": _o('select exam_id, page, line_no, text, "column", line_y, line_x, font_size from ordered'),
    "reconstruct_layout": _o('select exam_id, page, line_no, text, "column", line_y, line_x, font_size from ordered'),
}
