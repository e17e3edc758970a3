"""DuckDB SQL for the queries that SQL can express."""

#: Words by position, item windows, and the document words that an occurrence covers.
DECONTAMINATION = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
windows as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') as x from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from b where len(w) > 0)),
sizes as (select distinct n from windows),
starts as (select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as x from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) as k from d, sizes)),
hits as (select s.doc_id, s.k, s.n, v.item_id from starts s join windows v on s.n = v.n and s.x = v.x),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names from hits group by doc_id),
best as (
    select doc_id, max(len) as longest, first(item_id order by len desc, pos, item_id) as longest_item, first(pos order by len desc, pos, item_id) as longest_at from (
        select doc_id, item_id, count(*) + 9 as len, min(k) - 1 as pos from (
            select h.doc_id, h.item_id, h.k, i.j, h.k - row_number() over (partition by h.doc_id, h.item_id, h.k - i.j order by h.k) as run, h.k - i.j as diagonal
            from (select distinct doc_id, k, item_id, n from hits where n = 10) h
            join (select item_id, j, array_to_string(w[j : j + 9], ' ') as x from (select item_id, w, unnest(range(1, len(w) - 8)) as j from b where len(w) >= 10)) i on i.item_id = h.item_id
            join starts s on s.doc_id = h.doc_id and s.k = h.k and s.n = 10 and s.x = i.x
        ) group by doc_id, item_id, diagonal, run
        union all
        select doc_id, item_id, n, k - 1 from hits where n < 10
    ) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest, 0)::bigint as longest, longest_item::bigint as longest_item, longest_at::bigint as longest_at
from d left join words using (doc_id) left join items using (doc_id) left join best using (doc_id)
"""

#: Windows by their own text, the smallest document of each, and the words they cover.
SUBSTRINGS = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, k, md5_number(array_to_string(w[k : k + 49], ' ')) as x from (select doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) as k from d)),
gone as (select doc_id, k from starts join (select x, min(doc_id) as first from starts group by x having count(distinct doc_id) > 1) using (x) where doc_id > first),
covered as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(k, k + 50)) as p from gone) group by doc_id),
kept as (select d.doc_id, len(w) as n, case when ps is null then w else list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_contains(ps, i) then null else w[i] end), lambda x: x is not null) end as words from d left join covered using (doc_id))
select doc_id, n::bigint as n_words, (n - len(words))::bigint as n_removed, sha256(array_to_string(words, ' ')) as kept_sha256 from kept
"""

#: The table of CRC-32 by its rule, as a list of 256 numbers.
CRC32 = r"""
crc_table as (
    select list_transform(range(256), lambda i: list_reduce([cast(i as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as entries
)"""
