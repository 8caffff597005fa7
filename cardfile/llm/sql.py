"""DuckDB SQL of the operators that SQL can express, by brute force over all windows and pairs."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def decontaminate(span: int = 13) -> str:
    words = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""with docs as (select doc_id, {words} as w from documents),
    items as (select item_id, {words} as w from benchmark),
    sized as (select item_id, w, least({span}, len(w)) as n from items where len(w) > 0),
    windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win from (select *, unnest(range(1, len(w) - n + 2)) as i from sized) t),
    sizes as (select distinct n from windows),
    runs as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n) t),
    hits as (select distinct doc_id, i, r.n as n, item_id from runs r join windows v on r.n = v.n and r.win = v.win),
    hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) t group by 1),
    hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct doc_id, cast(item_id as varchar) as item from hits where item_id is not null) t group by 1)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(list, '')) as items_sha256,
      coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
    from docs d left join hit_words h on d.doc_id = h.doc_id left join hit_items t on d.doc_id = t.doc_id"""


def repeated_paragraphs(min_words: int, span_words: int, shingle_words: int, similarity: float, window: int, prime: int, characters: tuple[int, ...], words: tuple[int, ...]) -> str:
    letters = f"(unicode(w) * {characters[0]} + unicode(right(w, 1)) * {characters[1]} + length(w) * {characters[2]}) % {prime}"
    value = " + ".join(f"coalesce(lead(told, {i}) over text_order, 0) * {weight} % {prime}" for i, weight in enumerate(words))
    return rf"""with recursive chunks as (select doc_id, unnest(range(len(c))) as i, unnest(c) as c from (select doc_id, regexp_extract_all({_FOLDED}, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') as c from documents) t),
    placed as (select doc_id, i, ltrim(c, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as w, sum(length(c)) over (partition by doc_id order by i) as e from chunks),
    lettered as (select *, {letters} as told from placed),
    valued as (select doc_id, i, w, e, ({value}) % {prime} as v from lettered window text_order as (partition by doc_id order by i)),
    least as (select doc_id, i, w, e, min(v * 4294967296 + (4294967295 - i)) over (partition by doc_id order by i rows between {window - 1} preceding and current row) as m from valued),
    starts as (select distinct doc_id, 4294967295 - m % 4294967296 as i from least where i >= {window - 1} union select distinct doc_id, 0 from placed),
    numbered as (select l.doc_id, l.i, l.w, l.e, count(s.i) over (partition by l.doc_id order by l.i) - 1 as paragraph from least l left join starts s on l.doc_id = s.doc_id and l.i = s.i),
    pieces as (select doc_id, paragraph, min(e - length(w))::bigint as start, max(e)::bigint as "end", count(*)::bigint as n_words, list(w order by i) as w from numbered group by 1, 2 having count(*) >= {min_words}),
    paras as (select row_number() over (order by doc_id, paragraph) as k, doc_id, paragraph, start, "end", n_words, array_to_string(w, ' ') as t, w from pieces),
    texts as (select min(k) as d, t, any_value(w) as w from paras group by t),
    sets as (select d, list_distinct(list_transform(range(1, len(w) - {shingle_words - 2}), lambda x: array_to_string(w[x:x + {shingle_words - 1}], ' '))) as s from texts),
    shingles as (select d, unnest(s) as g from sets),
    pair_counts as (select a.d as a, b.d as b, count(*) as n from shingles a join shingles b on a.g = b.g and a.d < b.d group by 1, 2),
    links as (select a, b from pair_counts join sets x on x.d = a join sets y on y.d = b where n >= {similarity} * (len(x.s) + len(y.s) - n)),
    near as (select a, b from links union select b, a from links),
    reached(d, r) as (select a, a from near union select n.b, reached.r from reached join near n on n.a = reached.d),
    roots as (select d, min(r) as c from reached group by d),
    classed as (select p.*, coalesce(c, d) as c, count(*) over (partition by coalesce(c, d)) as class_size from paras p join texts using (t) left join roots using (d)),
    repeated as (select *, paragraph - row_number() over (partition by doc_id order by paragraph) as island from classed where class_size > 1),
    spans as (select *, sum(n_words) over one as span, min(start) over one as span_start, max("end") over one as span_end from repeated window one as (partition by doc_id, island))
    select p.doc_id, p.paragraph::bigint as paragraph, p.start, p."end", p.n_words, p.span_start, p.span_end, f.doc_id as class_id, f.paragraph::bigint as class_paragraph, p.class_size::bigint as class_size, p.k <> p.c as removed
    from spans p join paras f on f.k = p.c where p.span >= {span_words}"""


def prefix_trie(every: int = 20, most: int = 4) -> str:
    """Every prefix of every rebuilt conversation as text; nodes by grouping, subtrees by what their members' prefixes share."""
    return rf"""with recursive digits as (select c, cast(c as varchar) as s from (select distinct conv_id as c from conversations where conv_id is not null) t),
    bits(c, s, i, j, x) as (select c, s, 1, 0, xor(4294967295::bigint, ascii(s[1])) from digits
      union all select c, s, case when j = 7 then i + 1 else i end, case when j = 7 then 0 else j + 1 end,
        xor(case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end, case when j = 7 and i < length(s) then ascii(s[i + 1]) else 0 end) from bits where i <= length(s)),
    heads as (select c, xor(x, 4294967295::bigint) % {most} as h from bits where i > length(s)),
    turns as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos
      from conversations where conv_id is not null),
    sizes as (select c, count(*) as n from turns group by c),
    starts as (select h.c, h, h.c - h.c % {every} as other, least(h, coalesce(n, 0)) as taken from heads h left join sizes s on s.c = h.c - h.c % {every}),
    rebuilt as (select t.c, pos - h + taken as d, role, text from turns t join starts s on s.c = t.c where pos > h
      union all select s.c, pos, role, text from starts s join turns t on t.c = s.other where pos <= h),
    hashed as (select c, d, md5(length(role) || ':' || role || text) as x, length(regexp_extract_all(text, '[^ 	-]+')) as w from rebuilt),
    prefixes as (select c, d, w, string_agg(x, '') over (partition by c order by d) as k from hashed union all select c, 0, 0, '' from heads),
    ends as (select c, max(d) as size from prefixes group by c),
    nodes as (select k, min(c) as conv_id, d as depth, count(*) as n_convs, any_value(w) as w, (count(*) - 1) * any_value(w) as saved from prefixes group by k, d),
    ended as (select k, string_agg(cast(p.c as varchar), ',' order by p.c) as ids from prefixes p join ends e on e.c = p.c and e.size = p.d group by k),
    family as (select n.*, left(k, greatest(length(k) - 32, 0)) as above from nodes n),
    children as (select above as k, count(*) as n from family where depth > 0 group by 1),
    sums as (select p.k, sum(f.saved) as saved, sum(case when ch.n is null then 1 else 0 end) as leaves
      from family f left join children ch on ch.k = f.k join prefixes p on p.c = f.conv_id and p.d <= f.depth group by p.k)
    select f.conv_id, f.depth::bigint as depth, u.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, coalesce(ch.n, 0)::bigint as n_children, s.leaves::bigint as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
    from family f join sums s on s.k = f.k left join children ch on ch.k = f.k left join ended e on e.k = f.k left join family u on u.k = f.above and f.depth > 0"""
