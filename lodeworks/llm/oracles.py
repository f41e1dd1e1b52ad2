"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import licenses, quality, sharding

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = licenses.UPPER, licenses.LOWER


# Quotas: as in the operator, only the quotients near the fair share are ranked; all others are certain.
MIXING = f"""
with d as (select doc_id, source, case when source is null then 'null' else '=' || source end as key, len({WORDS})::bigint as size, md5(coalesce(doc_id::varchar, '') || ':20') as draw from documents),
n as (select greatest(64, (count(*) + 99999) // 100000) as shards from d),
s as (select d.*, ('0x' || substr(draw, 1, 9))::bigint % shards as shard from d, n),
c as (select key, shard, any_value(source) as source, sum(size)::bigint as cell_size from s group by 1, 2),
o as (select key, any_value(source) as source, sum(cell_size)::bigint as source_size from c group by 1),
a as (select *, row_number() over (order by source nulls last, key) as rn from o),
b as (select *, [5, 2, 1][(rn - 1) % 3 + 1] as weight, source_size * 3 as most, sum(source_size) over () as total from a),
e as (select *, most / weight as room, row_number() over (order by most / weight, rn) as pos,
  coalesce(sum(most) over (order by most / weight, rn rows between unbounded preceding and 1 preceding), 0) as fixed,
  sum(weight) over (order by most / weight, rn rows between current row and unbounded following) as open from b),
f as (select *, (total - fixed)::double / open as level from e),
g as (select *, min(case when most > level * weight then pos end) over () as first_open from f),
h as (select *, max(case when pos = first_open then level end) over () as final from g),
t as (select key, rn, source_size, total, coalesce(pos < first_open, true) as held, case when coalesce(pos < first_open, true) then most::double else final * weight end as target from h),
-- seats of sources
m as (select *, round(total / 16)::bigint as seats, count(*) over (partition by target > 0) as k from t),
q as (select *, case when target <= 0 then 0 when seats > k / 2 then greatest(0, floor(target * (seats - k / 2) / total + 0.5) - 1) else 0 end::bigint as base, case when target > 0 then floor(target * (seats + k / 2) / total + 0.5) + 1 else -1 end::bigint as top from m),
r as (select rn, target, seats, base, unnest(range(base, top + 1)) as j, 0 as z from q where target > 0),
u as (select rn, base, row_number() over (order by target / (2 * j + 1) desc, rn) <= seats - (select sum(base) from q where target > 0) as won from r),
v as (select rn, any_value(base) + count(*) filter (won) as source_quota from u group by 1),
-- seats of shards
w as (select c.key, c.shard, c.cell_size, t.source_size, t.target, t.held, coalesce(v.source_quota, 0) as seats from c join t using (key) left join v using (rn)),
x as (select *, count(*) filter (cell_size > 0) over (partition by key) as k, sum(cell_size) over (partition by key) as votes from w),
y as (select *, case when seats > k / 2 then greatest(0, floor(cell_size * (seats - k / 2) / votes + 0.5) - 1) else 0 end::bigint as base, (floor(cell_size * (seats + k / 2) / votes + 0.5) + 1)::bigint as top from x where cell_size > 0),
aa as (select *, seats - sum(base) over (partition by key) as rest from y),
bb as (select key, shard, base, rest, cell_size, unnest(range(base, top + 1)) as j from aa),
cc as (select key, shard, base, row_number() over (partition by key order by cell_size / (2 * j + 1) desc, shard) <= rest as won from bb),
dd as (select key, shard, any_value(base) + count(*) filter (won) as quota from cc group by 1, 2),
ee as (select w.*, case when held then cell_size * 3 else least(coalesce(quota, 0) * 16, cell_size * 3) end::bigint as take from w left join dd using (key, shard)),
ff as (select s.*, coalesce(sum(size) over (partition by key, shard order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from s),
gg as (select ff.*, source_size, target, take, cell_size, case when cell_size > 0 then take // cell_size else 0 end as copies from ff join ee using (key, shard))
select doc_id, size, source_size, target, (size * copies + greatest(0, least(size, take - copies * cell_size - before)))::bigint as taken from gg
"""


def licence_sql(least: float = 0.75) -> str:
    vocabulary, postings = licenses._index(licenses.NOTICES)
    df = {w: len({x // licenses.STEP for x in postings[w]}) for w in vocabulary}
    notices = ", ".join(f"({n}, '{label}', {len(t.split())})" for n, (label, t, _) in enumerate(licenses.NOTICES))
    anchors = ", ".join("({}, '{}', {})".format(n, *licenses._anchor(t, ps, df)) for n, (_, t, ps) in enumerate(licenses.NOTICES))
    words = ", ".join(f"({n}, {k}, '{w}')" for n, (_, t, _) in enumerate(licenses.NOTICES) for k, w in enumerate(t.split()))
    must = ", ".join(
        f"({n}, {next(k for k in range(len(t.split())) if t.split()[k : k + len(p.split())] == p.split()) + i}, '{w}')"
        for n, (_, t, ps) in enumerate(licenses.NOTICES) for p in ps for i, w in enumerate(p.split())
    )
    base = " union all ".join(
        f"select a.doc_id, '{label}' as label, a.i from w a " + " ".join(f"join w x{k} on x{k}.doc_id = a.doc_id and x{k}.i = a.i + {k} and x{k}.w = '{x}'" for k, x in enumerate(p.split()) if k) + f" where a.w = '{p.split()[0]}'"
        for p, label in licenses.BASE.items()
    )
    return rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as a from documents),
w as (select doc_id, unnest(a) as w, unnest(range(0, len(a))) as i from d),
b as ({base}),
base as (select doc_id, count(*) as n, min(i) as lo, max(i) as hi, list(distinct label) as labels from b group by 1),
notice(n, label, size) as (values {notices}),
anchor(n, w, back) as (values {anchors}),
nw(n, k, w) as (values {words}),
must(n, k, w) as (values {must}),
hits as (select w.doc_id, anchor.n, w.i - anchor.back as start from w join anchor using (w)),
firm as (select h.doc_id, h.n, h.start from hits h join must using (n) left join w on w.doc_id = h.doc_id and w.i = h.start + must.k and w.w = must.w group by 1, 2, 3 having count(*) = count(w.w)),
scored as (select f.doc_id, f.n, f.start, count(w.w) / any_value(notice.size) as score from firm f join nw on nw.n = f.n join notice on notice.n = f.n left join w on w.doc_id = f.doc_id and w.i = f.start + nw.k and w.w = nw.w group by 1, 2, 3),
own as (select doc_id, max(score) as score, coalesce(list(distinct label) filter (score >= {least}), []) as labels from scored join notice using (n) group by 1)
select d.doc_id, len(d.a)::bigint as n_words, coalesce(base.n, 0) as n_base, base.lo::bigint as first_word, base.hi::bigint as last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') as labels, coalesce(own.score, 0)::double as score
from d left join base using (doc_id) left join own using (doc_id)
"""


def quality_sql(most_chars: float = 0.25, most_words: float = 0.2, least_chars: int = 200, least_words: int = 40) -> str:
    k, bins = len(quality.CHARACTERS), quality.BINS

    def distance(own: str, n: str, reference: str, m: str, least: int) -> str:
        part = lambda a, b: f"(case when {a} > 0 then {a} * log2(2 * {a} / ({a} + {b})) else 0 end)"
        p, q = f"(x[1] / {n})", f"(x[2] / {m})"
        terms = f"list_sum(list_transform(list_zip({own}, {reference}), lambda x: {part(p, q)} / 2 + {part(q, p)} / 2))"
        chance = f"(len(list_filter({reference}, lambda b: b > 0)) - 1) / ({n} * 8 * ln(2))"
        return f"case when {n} >= {least} and {m} >= {least} then sqrt(greatest(0, {terms} - {chance})) else 0 end"

    count = lambda kind: f"length(regexp_replace(text, '[^{kind}]+', '', 'g'))::bigint"
    return rf"""
with d as (select doc_id, lang, coalesce(text, '') as text, {WORDS} as w from documents),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
  list_filter(list_transform(w, lambda x: lower(rtrim(x, '.,;:!?'))), lambda x: list_contains({bins}, x)) as l, regexp_replace(text, '[\x00-\x7F]+', '', 'g') as beyond from d),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
t as (select doc_id, i, count(*) over (partition by doc_id, x) as n from g),
c as (select doc_id, least(8, coalesce(lead(i) over (partition by doc_id order by i) - i, 8)) as n from t where n > 1),
r as (select doc_id, sum(n)::bigint as n_repeat_words from c group by 1),
a as (select doc_id, coalesce('=' || lang, 'null') as key, len(w)::bigint as n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::bigint as word_chars, length(text)::bigint as n_chars,
  {count('#*$%&|<>')} as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  {count('A-Z')} as upper, {count('0-9')} as digit, {count('.,;:!?')} as stop, length(beyond)::bigint as beyond, length(regexp_replace(beyond, '[\x{{00C0}}-\x{{024F}}]+', '', 'g'))::bigint as wide,
  list_transform({bins}, lambda b: len(list_filter(l, lambda x: x = b))::bigint) as own from l left join r using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  [upper, digit, n_symbols, stop, n_chars - word_chars, beyond - wide, wide, word_chars - upper - digit - n_symbols - stop - beyond]::double[] as hc, list_append(own, n_words - list_sum(own))::double[] as hw from a),
bins as (select key, pos, sum(n) as n from (select key, unnest(list_concat(hc, hw)) as n, unnest(range({k + len(bins) + 1})) as pos from b where not base_failed) group by 1, 2),
ref as (select key, list(n order by pos) as r from bins group by 1),
e as (select b.*, r[:{k}] as rc, r[{k + 1}:] as rw, list_sum(r[:{k}]) as mc, list_sum(r[{k + 1}:]) as mw, n_chars::double as nc, n_words::double as nw from b left join ref using (key))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and ({distance('hc', 'nc', 'rc', 'mc', least_chars)}) <= {most_chars} and ({distance('hw', 'nw', 'rw', 'mw', least_words)}) <= {most_words} as kept
from e
"""


JACCARD = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s, len(w) >= 3 as whole from d),
x as (select doc_id, whole, unnest(s) as x from s),
o as (select a.doc_id as a, b.doc_id as b, count(*) as n from x a join x b on a.x = b.x and a.whole = b.whole and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from o join s p on p.doc_id = a join s q on q.doc_id = b where 100 * n >= 90 * (len(p.s) + len(q.s) - n)),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.b from r join e on e.a = r.b),
c as (select a as doc_id, min(b) as component_id from r group by 1),
k as (select a as doc_id, count(*) as n from e group by 1)
select s.doc_id, len(s.s)::bigint as n_shingles, component_id, coalesce(k.n, 0)::bigint as n_links from s join c using (doc_id) left join k using (doc_id)
"""


def sharding_sql(shards: int = 8, seed: int = 7, rounds: int = 6) -> str:
    keys = sharding.round_keys(seed, rounds)
    a, b = [k[0] for k in keys], [k[1] for k in keys]
    p = sharding.PRIME
    mixed = f"((((s & mask) % {p}) * a[k] + b[k]) % {p})"
    twice = f"((xor({mixed}, {mixed} >> 13) * 69621) % {p})"
    step = f"list_reduce(list_concat([p], range(1, {rounds + 1})), lambda s, k: ((s & mask) << half) | xor(s >> half, xor({twice}, {twice} >> 9) & mask))"
    crc = "list_reduce(list_concat([4294967295::bigint], bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))"
    table = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end))"
    return f"""
with recursive t as (select doc_id, hex(encode(coalesce(text, ''))) as h, {table} as crc from documents),
u as (select doc_id, crc, length(h) // 2 + 1 as size, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::bigint) as bytes from t),
c as (select doc_id, size::bigint as size, xor({crc}, 4294967295) as text_crc32 from u),
v as (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || text_crc32::varchar), 1, 3))::int as bucket from c),
n as (select count(*) as n, greatest(1, (case when count(*) > 1 then ceil(log2(count(*)))::int else 1 end + 1) // 2) as half from v),
m as (select *, (1::bigint << half) - 1 as mask, {a} as a, {b} as b from n),
w as (select doc_id, size, text_crc32, row_number() over (order by bucket, doc_id nulls first, text_crc32, size) - 1 as p, false as done from v),
r as (select doc_id, size, text_crc32, p, 0 as i from w union all
  select doc_id, size, text_crc32, {step} as p, i + 1 as i from r, m where i = 0 or p >= n)
select doc_id, size, text_crc32, 'rows' as law, (p % {shards})::int as shard, (p // {shards})::bigint as slot, null::int as grown_shard from r, m where i > 0 and p < n
"""


LINES = r"""
with d as (select doc_id, string_split(text, chr(10)) as l from documents),
a as (select doc_id, unnest(range(0, len(l))) as pos, regexp_extract_all(unnest(l), '[^\x20\x09-\x0D]+') as w from d),
b as (select doc_id, pos, array_to_string(w, ' ') as s, len(w) as n, w from a where len(w) > 0),
f as (select s, any_value(n) as n, any_value(w) as w, min((doc_id, pos)) as first from b group by 1),
v as (select s, n, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') as x from (select *, unnest(range(1, n + 1)) as i from f where n >= 5)),
near as (
  select p.s from v p join v q on p.n = q.n and p.i = q.i and p.x = q.x and q.first < p.first
  union select p.s from v p join f q on q.s = p.x and q.n >= 5 and q.first < p.first
  union select p.s from f p join v q on q.x = p.s and p.n >= 5 and q.first < p.first),
g as (select b.doc_id, b.pos from b join f using (s) where (b.doc_id, b.pos) > f.first or s in (select s from near)),
k as (select doc_id, count(distinct pos) as n, string_agg(distinct pos, ',' order by pos) as dropped from g group by 1)
select d.doc_id, coalesce(len(d.l), 0)::bigint as n_lines, coalesce(k.n, 0)::bigint as n_dropped, coalesce(k.dropped, '') as dropped from d left join k using (doc_id)
"""

SUBSTRINGS = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
g as (select doc_id, i, md5(h[2 * i + 1:2 * i + 400]) as x from (select doc_id, h, unnest(range(0, length(h) // 2 - 199)) as i from d)),
t as (select doc_id, i from (select doc_id, i, count(*) over (partition by x) as n from g) where n > 1),
a as (select *, coalesce(i > lag(i) over (partition by doc_id order by i) + 200, true)::int as new from t),
b as (select *, sum(new) over (partition by doc_id order by i) as span from a),
s as (select doc_id, span, min(i) as lo, max(i) + 200 as hi from b group by 1, 2),
p as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as prior from s),
k as (select doc_id, sum(hi - lo) as removed, count(*) as spans, max(hi) as last, string_agg(h[2 * prior + 1:2 * lo], '' order by lo) as front from p join d using (doc_id) group by 1)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(case when last is null then h else front || h[2 * last + 1:] end)) as kept_sha256
from d left join k using (doc_id)
"""

ORACLES = {
    "op1_mixing": MIXING, "op2_licenses": licence_sql(), "op3_quality": quality_sql(), "op4_jaccard": JACCARD, "op7_sharding": sharding_sql(), "op9_lines": LINES, "op10_substrings": SUBSTRINGS,
}
