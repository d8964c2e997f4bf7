"""SQL texts of the queries on conversation structure and on the dataset manifest."""
from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: crc32 (reflected polynomial 0xEDB88320) of strings of ASCII characters, by a table of the 256 bytes.
_CRC_TABLE = """
crc_table as (
  select list(list_reduce(range(8), lambda c, k: case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n) order by n) as t
  from (select unnest(range(256)) as n))"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


REPAIR = rf"""
with recursive {_CRC_TABLE},
drawn as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
  from conversations, crc_table),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from drawn, (values (0), (1)) c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from damaged),
judged as (
  select conv_id, i, turn, role, text, left(role, 1) as initial,
         not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
         row_number() over (partition by conv_id, role, text order by i) > 1 as again,
         not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut_short,
         lag(left(role, 1)) over (partition by conv_id order by i) as before
  from placed),
kinds as (
  select *, case when blank or again then 'x'
                 else (case when initial in ('s', 'u', 'a') then initial else 'o' end) || (case when cut_short then '+' else '' end) end as symbol
  from judged),
gaps(s, letters, c, m) as (values
  (0, '', 0, 0), (0, 'I', 2, 2), (0, 'II', 4, 3), (1, '', 0, 1), (1, 'I', 2, 2), (1, 'II', 4, 3),
  (2, '', 0, 2), (2, 'I', 2, 3), (3, '', 0, 3), (3, 'I', 2, 2)),
follows(s, t, initial) as (values (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
symbols(symbol, initial, extra) as (values ('s', 's', 0), ('u', 'u', 0), ('a', 'a', 0), ('o', 'o', 0),
  ('s+', 's', 1), ('u+', 'u', 1), ('a+', 'a', 1), ('o+', 'o', 1)),
edits(symbol, s, letter, c, t) as (
  select symbol, s, 'D', 3, s from (select symbol from symbols union all select 'x'), (select unnest(range(4)) as s)
  union all select symbol, s, 'K', extra, t from symbols join follows using (initial)
  union all select symbol, s, 'R', 2 + extra, t from symbols, follows where t in (2, 3)),
convs as (select c.conv_id, count(k.i) as n from (select distinct conv_id from conversations) c
          left join kinds k on k.conv_id is not distinct from c.conv_id group by 1),
best as (
  select conv_id, 0::bigint as i, 0::bigint as s, '000000:' as path from convs
  union all
  select b.conv_id, b.i + 1, e.t::bigint,
         min(lpad((left(b.path, 6)::bigint + g.c + e.c)::varchar, 6, '0') || substr(b.path, 7) || g.letters || e.letter)
  from best b join kinds k on k.conv_id is not distinct from b.conv_id and k.i = b.i + 1
  join gaps g on g.s = b.s join edits e on e.symbol = k.symbol and e.s = g.m
  group by b.conv_id, b.i, e.t),
ends as (
  select b.conv_id, min(lpad((left(b.path, 6)::bigint + g.c)::varchar, 6, '0') || substr(b.path, 7) || g.letters) as path
  from best b join convs c on c.conv_id is not distinct from b.conv_id and c.n = b.i join gaps g on g.s = b.s where g.m in (0, 3)
  group by b.conv_id),
letters as (
  select conv_id, p, audit[p] as letter, p - length(replace(replace(replace(left(audit, p), 'D', ''), 'K', ''), 'R', '')) as row_no,
         length(replace(left(audit, p), 'D', '')) as place
  from (select conv_id, substr(path, 8) as audit, unnest(range(1, length(path) - 6)) as p from ends)),
lined as (
  select l.conv_id, l.p, l.letter, l.place, k.role, k.text, max(case when l.letter = 'K' and k.initial = 's' then 1 else 0 end) over (partition by l.conv_id) as led
  from letters l left join kinds k on k.conv_id is not distinct from l.conv_id and k.i = l.row_no and l.letter <> 'I'
  where l.letter <> 'D'),
repaired as (
  select conv_id, string_agg(case when letter = 'K' then role else case when (place - led) % 2 = 1 then 'user' else 'assistant' end end
         || ':' || case when letter = 'I' then '' else text end, chr(10) order by p) as body
  from lined group by conv_id),
faults as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (blank) as blank, count(*) filter (not blank and again) as duplicate,
         count(*) filter (not blank and not again and cut_short) as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from kinds group by conv_id)
select e.conv_id, coalesce(f.gaps, 0)::bigint as gaps, coalesce(f.blank, 0)::bigint as blank, coalesce(f.duplicate, 0)::bigint as duplicate,
       coalesce(f.truncated, 0)::bigint as truncated, coalesce(f.illegal, 0)::bigint as illegal, left(e.path, 6)::bigint as cost,
       substr(e.path, 8) as audit, sha256(coalesce(r.body, '')) as repaired_sha256
from ends e left join faults f on f.conv_id is not distinct from e.conv_id left join repaired r on r.conv_id is not distinct from e.conv_id
"""


def _levels(prefix: str, first: str, tree: str, count: int) -> str:
    """Tables {prefix}0..{prefix}count of (tree, i, d): every eight nodes become one while a tree has several."""
    out = [f"{prefix}0 as ({first})"]
    for h in range(1, count + 1):
        out.append(f"""
{prefix}{h} as (
  select {tree}, i // 8 as i, case when max(n) = 1 then max(d) else sha256(string_agg(d, '' order by i)) end as d
  from (select *, count(*) over (partition by {tree}) as n from {prefix}{h - 1}) group by {tree}, i // 8)""")
    return ",".join(out)


def _beside(prefix: str, tree: str, count: int) -> str:
    """Tables {prefix}s0.. of (tree, i, l, r, more): digests left and right of a node in its run; none where a tree has one node."""
    return ",".join(f"""
{prefix}s{h} as (
  select a.{tree}, a.i, coalesce(string_agg(b.d, '' order by b.i) filter (b.i < a.i), '') as l,
         coalesce(string_agg(b.d, '' order by b.i) filter (b.i > a.i), '') as r,
         any_value(a.n) > 1 as more
  from (select *, count(*) over (partition by {tree}) as n from {prefix}{h}) a
  join {prefix}{h} b on b.{tree} is not distinct from a.{tree} and b.i // 8 = a.i // 8 group by a.{tree}, a.i)""" for h in range(count))


def manifest(levels: int = 7, top_levels: int = 3) -> str:
    """Unrolled for up to 8 ** levels documents of a language and 8 ** top_levels languages."""
    field = lambda v: f"case when {v} is null then '-' else strlen({v}::varchar) || ':' || {v}::varchar end"
    row = lambda text: "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    folded, proof, joins = "tampered", [], []
    for h in range(levels):
        joins.append(f"join ns{h} as a{h} on a{h}.lang is not distinct from d.lang and a{h}.i = d.i // {8**h}")
        folded = f"case when a{h}.more then sha256(a{h}.l || {folded} || a{h}.r) else {folded} end"
        proof += [f"a{h}.l", f"a{h}.r"]
        joins.append(f"cross join lateral (select {folded} as f{h})")
        folded = f"f{h}"
    for h in range(top_levels):
        joins.append(f"join ts{h} as b{h} on b{h}.i = o.i // {8**h}")
        folded = f"case when b{h}.more then sha256(b{h}.l || {folded} || b{h}.r) else {folded} end"
        proof += [f"b{h}.l", f"b{h}.r"]
        joins.append(f"cross join lateral (select {folded} as g{h})")
        folded = f"g{h}"
    return f"""
with {_CRC_TABLE},
leaves as (
  select doc_id, lang, {row("text")} as leaf,
         case when {_crc("doc_id::varchar")} % 3 = 0 then {row(f"translate(text, '{_UPPER}', '{_LOWER}')")} else {row("text")} end as tampered
  from documents, crc_table),
docs as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from leaves),
{_levels("n", "select lang, i, leaf as d from docs", "lang", levels)},{_beside("n", "lang", levels)},
roots as (select *, row_number() over (order by lang nulls first) - 1 as i from (select lang, d from n{levels})),
{_levels("t", "select 0 as one, i, d from roots", "one", top_levels)},{_beside("t", "one", top_levels)}
select d.doc_id, d.leaf, o.d as subroot, w.d as root, sha256({" || ".join(proof)}) as proof_sha256, {folded} as folded_root, {folded} = w.d as verified
from docs d join roots o on o.lang is not distinct from d.lang cross join t{top_levels} w
{chr(10).join(joins)}
"""
