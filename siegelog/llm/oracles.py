"""SQL of the queries on conversations and phrases."""

from __future__ import annotations

# crc32 of a text, bit by bit; 0xEDB88320 is the reversed polynomial
_CRC = """xor(list_reduce([4294967295::bigint] || [ascii(x)::bigint for x in string_split({text}, '')],
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)), 4294967295::bigint)"""

CONVERSATION_TRIE = r"""
    with ordered as (
        select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
            row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
        from conversations where conv_id is not null
    ),
    lists as (select c, list([role, text] order by pos) as turns, {CRC} % 4 as h from ordered group by c),
    rebuilt as (
        select a.c, coalesce(b.turns[1:a.h], []) || a.turns[a.h + 1:] as turns
        from lists a left join lists b on b.c = a.c - a.c % 20
    ),
    members as (select c, turns[1:d] as path, len(turns) = d as ends from (select c, turns, unnest(range(0, len(turns) + 1)) as d from rebuilt)),
    node as (
        select path, len(path) as depth, min(c) as conv_id, count(*) as n_convs,
            sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends_sha256
        from members group by path
    ),
    children as (select path[1:depth - 1] as path, count(*) as n from node where depth > 0 group by 1),
    valued as (
        select node.*, coalesce(n, 0) as n_children,
            case when depth > 0 then (n_convs - 1) * len(regexp_extract_all(path[depth][2], '[^\x20\x09-\x0D]+')) else 0 end as saved
        from node left join children using (path)
    ),
    below as (
        select path[1:d] as path, sum((n_children = 0)::bigint)::bigint as n_leaves, sum(saved)::bigint as saved_tokens
        from (select path, n_children, saved, unnest(range(0, depth + 1)) as d from valued) group by 1
    )
    select v.conv_id, v.depth::bigint as depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children::bigint as n_children,
        n_leaves, saved_tokens, v.ends_sha256
    from valued v join below using (path) left join node p on v.depth > 0 and p.path = v.path[1:v.depth - 1]
""".replace("{CRC}", _CRC.format(text="c::varchar"))

PHRASES = r"""
    with pieces as (
        select coalesce(lang, 'und') as lang, unnest(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
        from documents
    ),
    words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
    grams as (
        select lang, w[i:i + k - 1] as g
        from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, unnest([1, 2, 3, 4]) as t(k) where len(w) >= k)
    ),
    f as (select lang, g, count(*) as f from grams group by lang, g having count(*) >= 30),
    totals as (select lang, sum(len(w))::bigint as n from words group by lang),
    cuts as (
        select c.lang, c.g, c.f as a, k, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f::hugeint + y.f) as score
        from (select *, unnest(range(1, len(g))) as k from f where len(g) > 1) c
        join f x on x.lang = c.lang and x.g = c.g[1:k]
        join f y on y.lang = c.lang and y.g = c.g[k + 1:]
    ),
    scored as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
    longer as (
        select lang, g[i:i + k - 1] as g, max(f) as f
        from (select lang, g, f, k, unnest(range(1, len(g) - k + 2)) as i from f, unnest([2, 3]) as t(k) where len(g) > k) group by 1, 2
    ),
    kept as (
        select s.*, array_to_string(s.g, ' ') as phrase from scored s left join longer o on o.lang = s.lang and o.g = s.g
        where o.f is null or 100::hugeint * o.f < 80::hugeint * s.a
    ),
    ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
    )
    select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
"""
