"""The queries' results in DuckDB SQL, from their definitions: all pairs, all windows."""

from __future__ import annotations

from lattica.llm.quality_rules import LEVELS, RULES

_WORDS = r"'[^\x20\x09-\x0D]+'"

JACCARD_JOIN = rf"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from t),
n as (select doc_id, count(*) as n from s group by 1),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
sides as (select a, b from links union all select b, a from links),
reach as (select doc_id, doc_id as at from documents union select r.doc_id, b from reach r join sides on a = r.at)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(r.at) as component_id from documents d left join n on n.doc_id = d.doc_id join reach r on r.doc_id = d.doc_id group by d.doc_id, n.n
"""


def _level() -> str:
    rules = []
    for count, by, cuts, high in RULES.values():
        tests = " ".join(f"when {count} / greatest({by}, 1)::double {'>' if high else '<'} {c} then {j}" for j, c in enumerate(cuts))
        rules.append(f"case {tests} else 99 end")
    return f"least({', '.join(rules)})"


def quality_rules(alpha: float = 0.02, delta: float = 0.05) -> str:
    tail = f"case when k >= n then 1.0 else list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) end"
    return rf"""
with t as (select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_WORDS}) as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from t)),
f as (select doc_id, i, count(*) over (partition by doc_id, s) as c from g),
r as (select doc_id, sum(step)::bigint as n from (select doc_id, least(8, i - coalesce(lag(i) over (partition by doc_id order by i), -8)) as step from f where c > 1) group by 1),
c as (select t.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint as n_capitals, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from t left join r on r.doc_id = t.doc_id),
v as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {_level()} as level from c),
q as (select doc_id from labels group by 1 having min(quality) = 1),
h as (select lang, level from v join q on q.doc_id = v.doc_id where not base_failed),
e as (select lang, j, count(*) as n, count(*) filter (level <= j) as k from h, (select unnest(range({LEVELS})) as j) group by 1, 2),
p as (select lang, max(j) as cut from e where ({tail}) * (select count(*) from (select distinct lang from h)) <= {delta} group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and level > coalesce(p.cut, -1) as kept from v left join p on p.lang is not distinct from v.lang
"""


SUFFIX_DEDUP = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as s from (select doc_id, h, unnest(range(0, n - 49)) as i from t)),
m as (select s, min(doc_id) as least from w group by 1 having count(*) > 1),
gone as (select w.doc_id, i from w join m on m.s = w.s and m.least < w.doc_id),
marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from gone),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from (select doc_id, i, sum(new) over (partition by doc_id order by i rows unbounded preceding) as run from marked) group by doc_id, run),
edges as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from runs),
per as (select doc_id, sum(b - a)::bigint as removed, count(*) as spans, max(b) as last from runs group by 1),
kept as (select t.doc_id, string_agg(substr(h, 2 * e.before + 1, 2 * (e.a - e.before)), '' order by e.a) as head from t join edges e on e.doc_id = t.doc_id group by 1)
select t.doc_id, n as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from t left join per on per.doc_id = t.doc_id left join kept on kept.doc_id = t.doc_id
"""

WARC_FIXITY = """
with one as (select page_id, url, html from pages),
two as (select page_id, url, case when page_id % 97 = 13 then html || chr(1) else html end as html from pages where page_id % 211 <> 5
  union all select -page_id, url, html from pages where page_id % 307 = 11),
r as (select side, coalesce(page_id, -1) as page_id, 'WARC/1.0' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(page_id, -1) || '>' || nl || 'WARC-Target-URI: ' || coalesce(url, '') || nl || 'Content-Length: ' || strlen(coalesce(html, '')) || nl || nl || coalesce(html, '') || nl || nl as record
  from (select 1 as side, * from one union all select 2, * from two), (select chr(13) || chr(10) as nl)),
h as (select side, page_id, floor(page_id / 1024.0)::bigint as file_id, strlen(record) as size, sha256(record) as hash from r),
l as (select *, sum(size) over (partition by side, file_id order by page_id, hash rows unbounded preceding)::bigint as stop, row_number() over (partition by side, page_id order by hash) as rank from h),
a as (select * from l where side = 1),
b as (select * from l where side = 2)
select coalesce(a.page_id, b.page_id) as page_id, coalesce(a.file_id, b.file_id) as file_id, a.stop - a.size as "start", a.stop as "end", a.hash as sha256, b.hash as replica_sha256,
  case when b.hash is null then 'missing' when a.hash is null then 'added' else 'corrupt' end as status
from a full join b on a.page_id = b.page_id and a.rank = b.rank where a.hash is distinct from b.hash
"""



def _crc32(column: str) -> str:
    """CRC-32 of a text's bytes, by the usual table."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(c)
    step = f"xor(c // 256, {table}[(xor(c, b) % 256) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode({column}))), lambda i: ('0x' || substr(hex(encode({column})), 2 * i + 1, 2))::bigint)), lambda c, b: {step}))"


IMPORTANCE = rf"""
with w as (select *, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from (select 0 as side, row_number() over () as r, doc_id, text from documents union all select 1, row_number() over (), item_id, text from benchmark)),
f as (select side, r, unnest(w || list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) || list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) as f from w),
n as (select side, r, f, count(*) as n from f group by all),
b as (select f, {_crc32("f")} % 10000 as b from (select distinct f from n)),
p as (select side, r, b, sum(n)::bigint as n from n join b using (f) group by all),
c as (select b, sum(n) filter (side = 0)::bigint as s, coalesce(sum(n) filter (side = 1), 0)::bigint as t from p group by b),
z as (select coalesce(sum(n) filter (side = 0), 0)::bigint as s, coalesce(sum(n) filter (side = 1), 0)::bigint as t from p),
g as (select b, floor(1000 * ln((c.t + 1) * (z.s + 10000) / ((c.s + 1) * (z.t + 10000))::double))::bigint as g from c, z),
d as (select r, sum(n)::bigint as n_features, sum(n * g)::bigint as weight from p join g using (b) where side = 0 group by r),
e as (select r, doc_id, len(w) >= 20 as able, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight from w left join d using (r) where side = 0),
x as (select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from e),
o as (select r, row_number() over (order by score desc, doc_id nulls last) as rank from x where able)
select doc_id, n_features, weight, score, case when rank <= 5 * (select count(*) from o) // 100 then rank end as rank from x left join o using (r)
"""

HARD_NEGATIVES = """
with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as ar, a.vec_id as a, a.label as al, b.vec_id as b, b.label as bl, list_dot_product(a.e, b.e)::bigint as s from v a join v b on a.vec_id % 100 = 0 and a.r <> b.r),
p as (select *, row_number() over (partition by ar order by s desc, b) as k from s where al = bl qualify k <= 5)
select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.ar, p.k order by n.s desc, n.b)::int as rank, n.b as negative_id, p.s as positive_score, n.s as negative_score
from p join s n on n.ar = p.ar and n.al <> n.bl and 30 * p.s <= 100 * n.s and 100 * n.s <= 90 * p.s qualify rank <= 10
"""

ORACLE = {"op1_jaccard_join": JACCARD_JOIN, "op5_quality_rules": quality_rules(), "op8_warc_fixity": WARC_FIXITY, "op10_suffix_dedup": SUFFIX_DEDUP, "op11_importance_resampling": IMPORTANCE, "op12_hard_negatives": HARD_NEGATIVES}
