"""The queries as SQL for another engine, where SQL expresses them."""

from __future__ import annotations

CHECKS: dict[str, str] = {
    "op3_line_bitmaps": r"""
        with texts as (
            select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        numbered as (
            select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from texts),
        keyed as (
            select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from numbered),
        frequent as (
            select key, max(doc_id) as keeper from keyed where length(key) >= 20
            group by key having count(distinct doc_id) >= 3),
        judged as (
            select k.*, f.key is not null and k.doc_id <> f.keeper as gone
            from keyed k left join frequent f on k.key = f.key)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
        from judged group by doc_id
    """,
    "op7_content_sort": r"""
        with texts as (
            select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
            row_number() over (same order by doc_id) = 1 as kept, sha256(norm) as text_sha256
        from texts window same as (partition by norm)
    """,
    "op9_jump_hash": r"""
        with recursive remainders as (
            select i, 0 as bit, i as value from range(256) r(i)
            union all
            select i, bit + 1, case when value % 2 = 1 then xor(value // 2, 3988292384) else value // 2 end
            from remainders where bit < 8),
        crc_table as (select list(value order by i) as steps from remainders where bit = 8),
        digits as (
            select doc_id, text, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'),
                lambda d: (instr('0123456789ABCDEF', d[1]) - 1) * 16 + instr('0123456789ABCDEF', d[2]) - 1) as bytes
            from documents),
        sized as (
            select doc_id, len(bytes) + 8 as size, xor(list_reduce(bytes,
                lambda crc, b: xor(crc // 256, steps[xor(crc % 256, b) + 1]), 4294967295::bigint), 4294967295) as text_crc32
            from digits, crc_table),
        jumps as (
            select distinct coalesce(doc_id, -1) as id, 0::bigint as spot,
                (coalesce(doc_id, -1)::hugeint + 18446744073709551616) % 18446744073709551616 as state
            from documents
            union all
            select id, floor((spot + 1)::double * (2147483648::double / (next // 8589934592 + 1)::double))::bigint, next
            from (select *, (state * 2862933555777941757 + 1) % 18446744073709551616 as next from jumps where spot <= 24) steps),
        placed as (
            select id, (max(spot) filter (spot < 24))::integer as shard, (max(spot) filter (spot < 25))::integer as grown_shard
            from jumps group by id)
        select doc_id, size, text_crc32, 'key' as law, shard,
            row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard
        from sized join placed on coalesce(doc_id, -1) = id
    """,
    "op11_ternary_trie": r"""
        with recursive remainders as (
            select i, 0 as bit, i as value from range(256) r(i)
            union all
            select i, bit + 1, case when value % 2 = 1 then xor(value // 2, 3988292384) else value // 2 end
            from remainders where bit < 8),
        crc_table as (select list(value order by i) as steps from remainders where bit = 8),
        turns as (
            select conv_id, turn, octet_length(encode(coalesce(text, '')))::bigint as bytes,
                substr(sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32) as digest
            from conversations where conv_id is not null),
        own as (
            select conv_id, list(struct_pack(d := digest, b := bytes) order by turn nulls first, digest) as seq from turns group by conv_id),
        taking as (
            select conv_id, seq, conv_id - conv_id % 5 as giver, xor(list_reduce(
                list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
                lambda crc, b: xor(crc // 256, steps[xor(crc % 256, b) + 1])), 4294967295) % 9 as h
            from own, crc_table),
        built as (
            select t.conv_id, list_concat(list_slice(coalesce(g.seq, []), 1, h), list_slice(t.seq, h + 1, len(t.seq))) as seq
            from taking t left join own g on g.conv_id = t.giver),
        steps_down as (
            select conv_id, depth, len(seq) as whole, case when depth = 0 then 0 else seq[depth].b end as bytes,
                array_to_string(list_transform(list_slice(seq, 1, depth), lambda s: s.d), '') as path
            from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as depth from built) x),
        nodes as (
            select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = whole), '')) as ends_sha256
            from steps_down group by path, depth),
        children as (
            select p.path, count(c.path) as n_children, any_value(p.depth) as depth
            from nodes p left join nodes c on c.depth = p.depth + 1 and left(c.path, 32 * p.depth) = p.path group by p.path),
        upwards as (
            select left(n.path, 32 * up) as path, (n_children = 0)::bigint as leaf, (n_convs - 1) * bytes as saved
            from (select n.*, n_children, unnest(range(0, n.depth + 1)) as up from nodes n join children c on c.path = n.path) n),
        sums as (select path, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from upwards group by path)
        select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, c.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
        from nodes n join children c on c.path = n.path join sums s on s.path = n.path
        left join nodes p on n.depth > 0 and p.path = left(n.path, 32 * (n.depth - 1))
    """,
    "op13_merkle_levels": r"""
        with recursive remainders as (
            select i, 0 as bit, i as value from range(256) r(i)
            union all
            select i, bit + 1, case when value % 2 = 1 then xor(value // 2, 3988292384) else value // 2 end
            from remainders where bit < 8),
        crc_table as (select list(value order by i) as steps from remainders where bit = 8),
        fields as (
            select doc_id, lang,
                concat(coalesce(concat(octet_length(encode(doc_id::varchar)), ':', doc_id), '-'),
                    coalesce(concat(octet_length(encode(source)), ':', source), '-'),
                    coalesce(concat(octet_length(encode(lang)), ':', lang), '-')) as head,
                n_chars, coalesce(concat(octet_length(encode(text)), ':', text), '-') as tail,
                xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
                    lambda crc, b: xor(crc // 256, steps[xor(crc % 256, b) + 1])), 4294967295) % 7 = 0 as tampered
            from documents, crc_table),
        counted as (
            select *, concat(length(n_chars::varchar), ':', n_chars) as own, concat(length((n_chars + 1)::varchar), ':', n_chars + 1) as more
            from fields),
        leaves as (
            select doc_id, lang, sha256(concat(head, case when n_chars is null then '-' else own end, tail)) as leaf,
                sha256(concat(head, case when n_chars is null then '-' when tampered then more else own end, tail)) as start
            from counted),
        placed as (
            select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place,
                dense_rank() over (order by encode(lang) nulls first) - 1 as top_place, count(*) over (partition by lang) as size
            from leaves),
        tree as (
            select top_place as tree, 0 as level, place, leaf as node, size from placed
            union all
            select tree, level + 1, place // 2, sha256(string_agg(node, '' order by place)), (size + 1) // 2
            from tree where size > 1 group by tree, level, place // 2, size),
        subroots as (select tree as place, node from tree where size = 1),
        tops as (
            select 0 as level, place, node, (select count(*) from subroots) as size from subroots
            union all
            select level + 1, place // 2, sha256(string_agg(node, '' order by place)), (size + 1) // 2
            from tops where size > 1 group by level, place // 2, size),
        steps_up as (
            select p.top_place, p.place, t.level, p.place >> t.level & 1 as side, s.node
            from placed p join (select distinct tree, level from tree where size > 1) t on t.tree = p.top_place
            left join tree s on s.tree = p.top_place and s.level = t.level and s.place = xor(p.place >> t.level, 1)
            union all
            select p.top_place, p.place, 1000 + t.level, p.top_place >> t.level & 1, s.node
            from placed p cross join (select distinct level from tops where size > 1) t
            left join tops s on s.level = t.level and s.place = xor(p.top_place >> t.level, 1)),
        paths as (
            select top_place, place, list(struct_pack(side := side, node := coalesce(node, '')) order by level) as path
            from steps_up group by top_place, place),
        folding as (
            select p.top_place, p.place, 1 as up, p.start as node, coalesce(path, []) as path from placed p left join paths using (top_place, place)
            union all
            select top_place, place, up + 1, sha256(case when path[up].side = 1 then concat(path[up].node, node) else concat(node, path[up].node) end), path
            from folding where up <= len(path)),
        folded as (select top_place, place, node, path from folding where up = len(path) + 1)
        select doc_id, leaf, s.node as subroot, r.node as root,
            sha256(array_to_string(list_transform(f.path, lambda x: x.node), '')) as proof_sha256,
            f.node as folded_root, f.node = r.node as verified
        from placed p join folded f using (top_place, place) join subroots s on s.place = p.top_place
        cross join (select node from tops where size = 1) r
    """,
}
