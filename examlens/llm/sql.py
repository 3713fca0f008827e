"""DuckDB SQL of the registered operators, where SQL can express them."""

from __future__ import annotations

from .decontaminate import SeedSpec
from .linededup import AROUND, SpreadSpec
from .mixing import BUCKETS, MixSpec
from .phrases import PhraseSpec
from .resample import ResampleSpec
from .sharding import BLOCKS
from .urls import LINK, RULES

SPACE = r"[^\x20\x09-\x0D]+"


def hex52(s: str) -> str:
    return f"cast('0x' || substr(md5({s}), 1, 13) as bigint)"


CRC_TABLE = """
crc_step as (select i, i::bigint as c, 0 as k from range(256) t(i)),
crc_rec as (
  with recursive r as (
    select i, c, k from crc_step
    union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from r where k < 8)
  select i, c from r where k = 8),
crc_table as (select list(c order by i) as t from crc_rec)"""


def shard_sql(docs: str = "documents", regions: int = 2, racks: int = 4, per_rack: int = 5) -> str:
    """op1 over a relation of documents, for equal weights."""
    draw = lambda path, w: f"ln(({hex52(path)} + 0.5) / 4503599627370496.0) / {float(w)!r}"
    best = lambda draws: f"list_position([{draws}], list_max([{draws}])) - 1"
    top = ", ".join(draw(f"k || '/{r}'", racks * per_rack) for r in range(regions))
    more = draw(f"k || '/{regions}'", 1)
    rack = ", ".join(draw(f"k || '/' || r || '/{i}'", per_rack) for i in range(racks))
    leaf = ", ".join(draw(f"k || '/' || r || '/' || c || '/{i}'", 1) for i in range(per_rack))
    return f"""
with {CRC_TABLE},
k as (select *, coalesce(doc_id::varchar, '') as k, coalesce(strlen(text), 0) + 16 as size,
  case when text = '' then [] else list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint)) end as bytes from {docs}),
r as (select *, {best(top)} as r, {best(f"{top}, {more}")} as r2 from k),
c as (select *, {best(rack)} as c from r),
s as (select *, r * {racks * per_rack} + c * {per_rack} + {best(leaf)} as shard from c),
crc as (select s.*, case when bytes is null then null else xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) end as text_crc32 from s, crc_table)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by {hex52("'slot/' || k")} % {BLOCKS}, doc_id, size, text_crc32) - 1 as slot,
  (case when r2 = {regions} then {regions * racks * per_rack} else shard end)::int as grown_shard
from crc"""


def leaks_sql(spec: SeedSpec = SeedSpec()) -> str:
    """Pairs of document and item; seeds are compared as lists of words."""
    seed = lambda i, m: f"concat_ws(' ', '{i}', " + ", ".join(f"w[i + {j + 1}]" for j in m) + ")"
    seeds = lambda of, keep: " union all ".join(
        f"select {keep}, i, {seed(k, m)} as seed from {of}" for k, m in enumerate(spec.masks))
    return f"""
with d0 as (select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}') as w from documents),
b0 as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}') as w from benchmark),
d1 as (select *, unnest(range(len(w) - {spec.span - 1})) as i from d0 where len(w) >= {spec.span}),
b1 as (select *, unnest(range(len(w) - {spec.span - 1})) as i from b0 where len(w) >= {spec.span}),
ds as ({seeds('d1', 'doc_id, text')}), bs as ({seeds('b1', 'item_id')}),
shifts as (select distinct doc_id, text, item_id, ds.i - bs.i as shift, bs.i as hit from ds join bs using (seed)),
laid as (select s.*, least(len(b0.w), {spec.window}) as n, b0.w as item, d0.w as doc from shifts s
  join b0 on b0.item_id is not distinct from s.item_id join d0 on d0.doc_id is not distinct from s.doc_id and d0.text = s.text),
windows as (select *, unnest(range(greatest(hit + {spec.span} - n, 0), least(hit, len(item) - n) + 1)) as lo from laid),
counted as (select doc_id, text, item_id, n, len(list_filter(range(lo, lo + n), lambda j: j + shift >= 0 and item[j + 1] = doc[j + shift + 1])) as m from windows)
select doc_id, item_id, max(n)::int as words, max(m)::int as matches from counted where m >= ceil(n * {spec.share}) group by doc_id, text, item_id"""


def lines_sql(spec: SpreadSpec = SpreadSpec()) -> str:
    around = " || ".join(f"chr({ord(c)})" for c in AROUND)
    return f"""
with d as (select row_number() over () as row, doc_id, source, text, string_split(text, chr(10)) as l from documents),
e as (select row, source, trim(unnest(l), {around}) as line from d),
bad as (select line from e where line <> '' group by line having count(distinct source) >= {spec.min_sites}),
f as (select row, unnest(l) as raw, unnest(range(len(l))) as nr from d),
g as (select f.row, count(bad.line) as gone, string_agg(case when bad.line is null then raw end, chr(10) order by nr) as text from f left join bad on trim(raw, {around}) = bad.line group by f.row)
select doc_id, coalesce(len(l), 0)::int as n_lines, coalesce(gone, 0)::int as n_removed,
  case when d.text is null then null when coalesce(gone, 0) = 0 then d.text else coalesce(g.text, '') end as text
from d left join g using (row)"""


def mix_sql(spec: MixSpec = MixSpec()) -> str:
    """Each source gives its quota exactly, so a document's words follow from its place in the stream."""
    weights = f"[{', '.join(map(str, spec.weights))}]"
    return f"""
with d as (select doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '{SPACE}'))::bigint as size,
  {hex52("'mix/' || coalesce(doc_id::varchar, '')")} as ord from documents),
s as (select source, sum(size)::bigint as words from d group by source),
r as (select *, row_number() over (order by source is null, source) - 1 as rank from s),
w as (select *, {weights}[rank % {len(spec.weights)} + 1]::bigint as weight, words * {spec.repeats} as cap from r),
a as (select *, sum(words) over () as aw, sum(weight) over () as ag,
  coalesce(sum(cap) over (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding), 0) as caps,
  coalesce(sum(weight) over (order by cap::double / weight, rank rows between unbounded preceding and 1 preceding), 0) as heavy from w),
c as (select *, cap * (ag - heavy) <= (aw - caps) * weight as capped from a),
t as (select *, case when capped then cap::double else (weight * (aw - over_))::double / nullif(ag - gone, 0)::double end as target
  from (select *, coalesce(sum(case when capped then cap end) over (), 0) as over_, coalesce(sum(case when capped then weight end) over (), 0) as gone from c)),
p as (select d.*, t.words as source_size, target, floor(target + 0.5)::bigint as quota,
  coalesce(sum(size) over (partition by d.source order by ord % {BUCKETS}, ord, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as lo
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size::bigint as source_size, target,
  ({' + '.join(f'greatest(0, least(lo + size + {e} * source_size, quota) - (lo + {e} * source_size))' for e in range(spec.repeats))})::bigint as taken
from p"""


def urls_sql(rounds: int = 8, damping: float = 0.85) -> str:
    """The ranks by a fixed number of rounds; verdicts only need which of two is larger."""
    fits = [(r, f"(host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}')") for r in sorted(RULES, key=lambda r: (-len(r.text), r.text))]
    rule = "case " + " ".join(f"when {f} then '{r.text}'" for r, f in fits) + " end"
    verdict = "case " + " ".join(f"when {f} then '{r.verdict}'" for r, f in fits) + " end"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = LINK.replace("'", "''")
    steps = "".join(f"""
r{i + 1} as (select kind, host, sum(rank) as rank from (
  select e.kind, e.dst as host, e.share * r.rank * {damping} as rank from shares e join r{i} r on r.kind = e.kind and r.host = e.src
  union all select kind, host, base from base) x group by kind, host),""" for i in range(rounds))
    return f"""
with p as (select page_id, html, coalesce({low("regexp_extract(url, '://([^/?#]*)', 1)")}, '') as host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
j as (select page_id, host, path, {rule} as rule, {verdict} as v from p),
l as (select host as src, {low("regexp_extract(link, '//([^/?#]*)', 1)")} as dst from (select host, unnest(regexp_extract_all(html, '{link}', 1)) as link from p)),
h as (select src, dst, count(*) as links from l where src <> '' and dst <> '' and src <> dst group by src, dst),
b as (select 'allow' as kind, src, dst, links from h union all select 'block', dst, src, links from h),
shares as (select kind, src, dst, links / sum(links) over (partition by kind, src) as share from b),
base as (select v as kind, host, {1 - damping!r} * count(*) / sum(count(*)) over (partition by v) as base from j where v is not null group by v, host),
r0 as (select kind, host, base as rank from base),{steps}
g as (select host from r{rounds} group by host having coalesce(sum(case when kind = 'block' then rank end), 0) > coalesce(sum(case when kind = 'allow' then rank end), 0))
select page_id, host, path, rule, coalesce(v, case when host in (select host from g) then 'block' else 'allow' end) as verdict from j"""


def resample_sql(docs: str = "documents", target: str = "benchmark", spec: ResampleSpec = ResampleSpec()) -> str:
    """op12: distinct n-grams are hashed byte by byte."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}'), [])"
    grams = " || ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in range(1, spec.order + 1))
    return f"""
with {CRC_TABLE},
d0 as materialized (select row_number() over () as r, doc_id, {words} as w from {docs}),
b0 as (select {words} as w from {target}),
dg as materialized (select r, g, count(*) as k from (select r, unnest({grams}) as g from d0) group by all),
bg as materialized (select g, count(*) as k from (select unnest({grams}) as g from b0) group by all),
every as (select distinct g from (select g from dg union all select g from bg)),
hashed as materialized (select g, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda x: cast('0x' || x as bigint))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {spec.buckets} as b from every, crc_table),
s as (select b, sum(k) as s from dg join hashed using (g) group by b), t as (select b, sum(k) as t from bg join hashed using (g) group by b),
total as (select (select coalesce(sum(s), 0) from s)::double + {spec.buckets} as s_all, (select coalesce(sum(t), 0) from t)::double + {spec.buckets} as t_all),
gain as (select s.b, floor(1000.0::double * ln((coalesce(t.t, 0) + 1)::double * s_all / ((s.s + 1)::double * t_all)))::bigint as gain from s left join t using (b), total),
weight as (select r, sum(k) as f, sum(k * gain) as weight from dg join hashed using (g) join gain using (b) group by r),
scored as (select r, doc_id, len(w) as n_words, coalesce(f, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  cast('0x' || substr(sha256('{spec.seed}:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) as h from d0 left join weight using (r)),
drawn as (select *, weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from scored),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, weight, n_features) as rank from drawn where n_words >= {spec.min_words}),
most as (select {spec.percent} * count(*) // 100 as n from ranked)
select doc_id, n_features, weight, score, case when rank <= n then rank end::bigint as rank from drawn left join ranked using (r), most"""


def phrases_sql(docs: str = "documents", spec: PhraseSpec = PhraseSpec()) -> str:
    """op13 by phrases as text, every inner phrase looked up."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " union all ".join(f"select lang, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) as p from pieces" for m in range(1, spec.longest + 1))
    return f"""
with split as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({low}, '[.,;:!?\\x0A-\\x0D]')) as piece from {docs}),
pieces as materialized (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from split),
total as (select lang, sum(len(w))::bigint as n from pieces group by lang),
f as materialized (select lang, p, count(*) as f, string_split(p, ' ') as w from ({grams}) group by lang, p having count(*) >= {spec.least}),
cand as (select lang, p, f as a, w, len(w) as m from f where len(w) > 1),
cuts as (select lang, p, a, unnest(range(1, m)) as k, w, m from cand),
parts as (select lang, p, a, k, array_to_string(w[1:k], ' ') as lp, array_to_string(w[k + 1:m], ' ') as rp from cuts),
scored as (select c.lang, c.p, c.a, c.k, x.f as l, y.f as r, n, ((1000::hugeint * c.a * n) // (x.f::hugeint * y.f))::bigint as score
  from parts c join f x on x.lang = c.lang and x.p = c.lp join f y on y.lang = c.lang and y.p = c.rp join total t on t.lang = c.lang),
best as (select * from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
inside as (select lang, a, m, w, unnest(range(1, m)) as i from cand),
subs as (select lang, a, array_to_string(w[i:i + j - 1], ' ') as p from (select *, unnest(range(2, m)) as j from inside) where i + j - 1 <= m),
around as (select lang, p, max(a) as around from subs group by lang, p),
kept as (select b.* from best b left join around using (lang, p) where around is null or 100 * around < {spec.inside} * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, p) as rank from kept)
select lang, rank::bigint as rank, p as phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score from ranked where rank <= {spec.top}"""
