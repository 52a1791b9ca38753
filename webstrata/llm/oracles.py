"""DuckDB SQL with the same rows as the queries, where SQL can say it."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE32 = "(select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast((cast(concat('0x', substr({0}, 5 * (i // 4) + 1, 5)) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1), '' order by i) from range(32) r(i))"

_OP1 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, 24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) as n from turns
), one as (
  select conv_id, count(*) as n_turns, string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls first, role, text) as lines,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss, cast(sum(n) as bigint) as formatted_chars, count(*) filter (role = 'assistant') as n_examples
  from sized group by conv_id
)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars, n_examples from one
"""

_WORDS2 = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP2 = f"""
with item as (select item_id, {_WORDS2} as w from benchmark where text is not null),
win as (select distinct item_id, least(len(w), 10) as l, unnest(list_transform(range(0, greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1:i + 10], ' '))) as g from item where len(w) > 0),
doc as (select doc_id, {_WORDS2} as w from documents),
lens as (select distinct l from win),
gram as (select doc_id, l, p, array_to_string(w[p + 1:p + l], ' ') as g from (select doc_id, w, l, unnest(range(0, len(w) - l + 1)) as p from doc, lens where len(w) >= l)),
hit as (select distinct doc_id, p, l, item_id from gram join win using (l, g)),
word as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(p, p + l)) as k from hit) group by doc_id),
own as (select doc_id, count(*) as n, string_agg(i, ',' order by i) as s from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
select d.doc_id, coalesce(len(d.w), 0) as n_words, coalesce(word.n, 0) as n_hit, coalesce(own.n, 0) as n_items, sha256(coalesce(own.s, '')) as items_sha256, coalesce(word.n, 0) > 0 as contaminated
from doc d left join word using (doc_id) left join own using (doc_id)
"""

_OP7 = """
with d as (select doc_id, coalesce(hex(encode(text)), '') as h from documents),
win as materialized (select doc_id, s, hash(substr(h, 2 * s + 1, 200)) as k, hash(concat('x', substr(h, 2 * s + 1, 200))) as k2 from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as s from d)),
ranked as (select doc_id, s, row_number() over (partition by k, k2 order by doc_id, s) as n from win),
start as (select doc_id, s, lag(s) over (partition by doc_id order by s) as before from ranked where n > 1),
run as (select doc_id, s, sum(case when before is null or s > before + 100 then 1 else 0 end) over (partition by doc_id order by s) as r from start),
span as materialized (select doc_id, min(s) as a, max(s) + 100 as b from run group by doc_id, r),
gap as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as a, a as b from span union all select doc_id, max(b), 1000000000 from span group by doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as h from gap join d using (doc_id) group by doc_id),
sums as (select doc_id, cast(sum(b - a) as bigint) as removed, count(*) as n from span group by doc_id)
select d.doc_id, length(d.h) // 2 as n_bytes, coalesce(s.removed, 0) as n_removed, coalesce(s.n, 0) as n_spans, sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
from d left join kept k using (doc_id) left join sums s using (doc_id)
"""

_WORDS9 = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+')"
_OP9 = f"""
with recursive doc as (select doc_id, coalesce({_WORDS9}, []) as w from documents),
sets as materialized (select doc_id, case when len(w) = 0 then [] else list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) end as s from doc),
item as materialized (select doc_id, unnest(s) as g from sets),
inter as (select a.doc_id as x, b.doc_id as y, count(*) as n from item a join item b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as materialized (select x, y from inter join sets a on a.doc_id = x join sets b on b.doc_id = y where 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
reach(doc_id, root) as (select doc_id, doc_id from sets union select r.doc_id, l.y from reach r join link l on l.x = r.root)
select s.doc_id, len(s.s) as n_shingles, c.root as component_id, c.root = s.doc_id as kept, e.set_id
from sets s join (select doc_id, min(root) as root from reach group by doc_id) c using (doc_id)
join (select doc_id, case when len(s) = 0 then doc_id else min(doc_id) over (partition by md5(array_to_string(list_sort(s), chr(10)))) end as set_id from sets) e using (doc_id)
"""

_OP10 = f"""
with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, strlen(html) as payload_bytes, {_BASE32.format('sha1(html)')} as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from p
"""


def oracle_sql() -> dict[str, str]:
    """Extraction, url verdicts, chunking, tokens and scores have none: SQL has no parser for HTML, no boosted
    trees, no rolling hash, no byte-pair merges and not this hash. Their tests hold them against brute force."""
    return {"op1_chat": _OP1, "op2_decontamination": _OP2, "op7_suffix_array": _OP7, "op9_minhash": _OP9, "op10_warc": _OP10}
