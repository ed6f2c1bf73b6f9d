"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from .license_scan import TEMPLATES

_NOTICES = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)

ORACLE = {
    "op3_line_dedup": r"""
with d as (select doc_id, text, string_split(text, chr(10)) ls from documents),
w as (select doc_id, unnest(range(0, len(ls) - 2)) p, unnest(list_transform(range(1, len(ls) - 1), lambda i: ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2])) t from d where len(ls) >= 3),
f as (select t, min((doc_id, p)) first_at from w where trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) != '' group by t having count(*) > 1),
g as (select doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) gone from w join f using (t) where (doc_id, p) != first_at group by doc_id)
select d.doc_id,
       case when g.gone is null then d.text
            else coalesce(array_to_string(list_filter(ls, lambda x, i: not list_contains(g.gone, i - 1)), chr(10)), '') end as text,
       coalesce(len(ls), 0)::bigint as n_lines,
       coalesce(len(g.gone), 0)::bigint as n_removed,
       coalesce(len(list_filter(g.gone, lambda x: not list_contains(g.gone, x + 1))), 0)::bigint as n_spans
from d left join g on d.doc_id = g.doc_id
""",
    "op5_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x != '') ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) ls from documents),
p as (select doc_id, unnest(range(1, len(ws) - 3)) i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) s from d where len(ws) >= 5),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) n from p) where n > 1),
c as (select doc_id, sum(least(5, coalesce(nxt - i, 5)))::bigint n from (select doc_id, i, lead(i) over (partition by doc_id order by i) nxt from r) group by doc_id),
m as (select d.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::bigint word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
             (length(t) - length(replace(t, '!', '')))::bigint n_exclaims,
             (length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')))::bigint n_letters,
             len(ls)::bigint n_lines, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words
      from d left join c on d.doc_id = c.doc_id),
b as (select *, (case when n_words < 10 then 1 else 0 end + case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end
             + case when 100 * n_symbols > 20 * n_words then 4 else 0 end + case when 100 * n_exclaims > 30 * n_words then 8 else 0 end
             + case when n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines then 16 else 0 end + case when word_chars > 20 * n_words then 32 else 0 end
             + case when n_words > 0 and 2 * n_letters < word_chars then 64 else 0 end)::bigint fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) != 0 as base_failed, fail_bits = 0 as kept, fail_bits from b
""",
    "op6_decontamination": r"""
with dw as (select doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[ \t-\r]+'), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x != '') ws from documents),
bw as (select item_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[ \t-\r]+'), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')), lambda x: x != '') ws from benchmark),
ds as (select distinct doc_id, s from (select doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) s from dw where len(ws) >= 5)),
bs as (select distinct item_id, s from (select item_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) s from bw where len(ws) >= 5)),
n as (select item_id, count(*) n_shingles from bs group by item_id)
select doc_id, item_id, n_shingles, count(*) as n_shared from ds join bs using (s) join n using (item_id)
group by doc_id, item_id, n_shingles having 5 * count(*) >= 4 * n_shingles
""",
    "op8_warc": r"""
with p as (select page_id, coalesce(html, '') h, sha256(coalesce(html, '')) d, octet_length(encode(coalesce(html, ''))) n from pages),
f as (select d, min(page_id) first_id from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
       case when n >= 100 and page_id != first_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and page_id != first_id then first_id end as refers_to
from p left join f on p.d = f.d
""",
    "op11_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, ''))::bigint n, sha256('1:' || coalesce(doc_id::varchar, '')) h from documents),
h as (select *, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
             case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from h),
c as (select *, substring(t, 1, a) p, substring(t, a + 1, b - a) m, substring(t, b + 1) s from f)
select doc_id, n, form, case when form != 'plain' then a end as prefix_chars, case when form != 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256,
       case when form != 'plain' then (a > 0 and regexp_matches(substring(t, a, 2), '^[^ \t-\r]{2}$', 's')) or (b > 0 and regexp_matches(substring(t, b, 2), '^[^ \t-\r]{2}$', 's')) end as splits_word
from c
""",
    "op12_prefix_trie": r"""
with o as (select conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} x,
                  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) p
           from conversations where conv_id is not null),
l as (select conv_id, list(x order by p) s from o group by conv_id),
h as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda y: ascii(y)::bigint)),
                 lambda c, y: list_reduce(list_prepend(xor(c, y), range(8)), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)), 4294967295) % 4 h from l),
b as (select h.conv_id, list_concat(coalesce(l.s[1:h.h], []), h.s[h.h + 1:]) s from h left join l on l.conv_id = h.conv_id - h.conv_id % 20),
m as (select conv_id, len(s) n, d, s[1:d] p from (select conv_id, s, unnest(range(0, len(s) + 1)) d from b)),
v as (select d, p, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) ends_sha256,
             case when d = 0 then 0 else len(list_filter(regexp_split_to_array(any_value(p[d].t), '[ \t-\r]+'), lambda w: w != '')) end words from m group by d, p),
a as (select m.conv_id, m.d, v.conv_id rep from m join v on m.d = v.d and m.p = v.p),
n as (select v.conv_id, v.d, a.rep parent, n_convs, words, ends_sha256 from v left join a on a.conv_id = v.conv_id and a.d = v.d - 1),
k as (select parent conv_id, d - 1 d, count(*) n_children from n where d > 0 group by 1, 2),
f as (select n.*, coalesce(n_children, 0) n_children from n left join k on k.conv_id = n.conv_id and k.d = n.d),
s as (select a.rep conv_id, a.d, count(*) filter (f.n_children = 0) n_leaves, sum((f.n_convs - 1) * f.words) saved_tokens from f join a on a.conv_id = f.conv_id and a.d <= f.d group by 1, 2)
select f.conv_id, f.d::bigint as depth, f.parent as parent_conv_id, f.n_convs, f.n_children::bigint as n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, f.ends_sha256 from f join s on s.conv_id = f.conv_id and s.d = f.d
""",
    "op13_license_scan": r"""
with d as (select doc_id, row_number() over () id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select doc_id, id, string_split(t, chr(10)) ls, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '') ws from d),
p as (select id, i - 1 word, case when ws[i] = 'mit' and ws[i + 1] = 'license' then 'mit' when ws[i] = 'apache' and ws[i + 1] = 'license' then 'apache'
             when ws[i] = 'general' and ws[i + 1] = 'public' and ws[i + 2] = 'license' then 'gpl' end as label from (select id, ws, unnest(range(1, len(ws) + 1)) i from w)),
b as (select id, count(*) n_base, min(word) first_word, max(word) last_word, list_distinct(list(label)) base from p where label is not null group by id),
c as (select id, i, list_distinct(list_filter(regexp_split_to_array(array_to_string(ls[i + 1:i + 4], chr(10)), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '')) own
      from (select id, ls, unnest(range(0, greatest(len(ls) - 4, 0) + 1)) i from w)),
n as (select label, list_distinct(list_filter(regexp_split_to_array(lower(x), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: y != '')) words from (values NOTICES) v(label, x)),
m as (select id, list_distinct(list(label)) more, max(n_shared / len(words)) share, count(distinct i) n_blocks
      from (select id, i, label, words, len(list_intersect(own, words)) n_shared from c, n) where 10 * n_shared >= 9 * len(words) group by id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(array_to_string(list_sort(base), ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') as labels,
       coalesce(n_blocks, 0)::bigint as n_blocks, case when n_base > 0 then 1.0 else coalesce(share, 0) end::double as score
from w left join b using (id) left join m using (id)
""".replace("NOTICES", _NOTICES),
}
