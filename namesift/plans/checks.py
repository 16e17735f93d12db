"""The registered queries as SQL for another engine, to check results against.

Written independently of the Spark side: dates are parsed by the engine, tokens
are joined in full, and nothing is pruned.
"""

from __future__ import annotations

import re

from .inventories import RENUMBERED, inventory_sql

CHECKS: dict[str, str] = {}


# Building blocks, each a SQL expression over SQL expressions

def ext(n: str) -> str:
    return rf"regexp_extract({n}, '(?s)^.+(\.[^.]+)$', 1)"


def stem(n: str) -> str:
    return f"left({n}, length({n}) - length({ext(n)}))"


def on_stem(n: str, edited: str) -> str:
    """``edited`` is an expression over {s}, the stem."""
    return f"concat({edited.format(s=stem(n))}, {ext(n)})"


def each_match(text: str, pattern: str, rewritten: str) -> str:
    """Replace every match; ``rewritten`` is an expression over m."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({text}, '{pattern}'), "
        f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda m: {rewritten})), "
        "lambda z: concat(z[1], coalesce(z[2], ''))), '')"
    )


def steps(source: str, columns: str, start: str, expressions: list[str]) -> str:
    """Chain of CTEs; every expression works on v, the previous result."""
    ctes = [f"s0 as (select *, {start} as v from {source} src)"]
    for i, expression in enumerate(expressions, 1):
        ctes.append(f"s{i} as (select * replace ({expression} as v) from s{i - 1})")
    return f"with {', '.join(ctes)} select {columns} from s{len(expressions)}"


def over(source: str, **columns: str) -> str:
    return (
        "select file_id, " + ", ".join(f"{sql} as {c}" for c, sql in columns.items())
        + f" from {inventory_sql(source)} files"
    )


# Names

def capitalized(upper_first: bool) -> str:
    first = "false" if upper_first else "i = 1"
    lead = r"regexp_extract(p, '(?s)^[^\pL]*')"
    return (
        "array_to_string(list_transform(regexp_extract_all({s}, '(?s)[^_\\-. ]*[_\\-. ]|[^_\\-. ]+'), "
        f"lambda p, i: case when {first} then lower(p) else "
        f"concat({lead}, replace(upper(substr(p, length({lead}) + 1, 1)), 'ẞ', 'SS'), lower(substr(p, length({lead}) + 2))) end), '')"
    )


def titled(text: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({text}, '(?s)\pL+|\PL+'), "
        "lambda r: concat(replace(upper(substr(r, 1, 1)), 'ẞ', 'Ss'), lower(substr(r, 2)))), '')"
    )


CHECKS["split_name_ext"] = over("inv_docs", stem=stem("name"), ext=ext("name"))
CHECKS["replace_string"] = over("inv_docs", new_name=on_stem("name", "replace({s}, '.', '_')"))
CHECKS["replace_empty_source"] = over(
    "inv_docs", new_name=on_stem("name", "concat('_', array_to_string(regexp_extract_all({s}, '(?s).'), '_'), '_')")
)
CHECKS["camel_case"] = over("inv_docs", new_name=on_stem("name", capitalized(False)))
CHECKS["pascal_case"] = over("inv_docs", new_name=on_stem("name", capitalized(True)))
CHECKS["title_case"] = over("inv_docs", new_name=titled("name"))
CHECKS["tokenize"] = over(
    "inv_docs", tokens=rf"array_to_string(regexp_extract_all(lower({stem('name')}), '[a-z]+|\d+'), '|')"
)
CHECKS["replace_pairs"] = steps(
    inventory_sql("inv_docs"), "file_id, v as new_name", "name",
    [on_stem("v", f"replace({{s}}, '{a}', '{b}')") for a, b in ((" ", "_"), ("e", "é"), ("é_", "-"), (".", ""))],
)

# Regular expressions

CHECKS["regex_groups"] = over(
    "inv_orders",
    new_name=on_stem("name", r"regexp_replace({s}, '(\d{{2}})[ .-](\d{{2}})[ .-](\d{{2}})', '\3' || '0' || '\2-\1', 'g')")
)
CHECKS["regex_case_upper"] = over(
    "inv_orders", new_name=on_stem("name", each_match("{s}", "[a-z]+", "upper(m)"))
)
CHECKS["regex_case_lower"] = over(
    "inv_parts",
    new_name=on_stem("name", each_match(
        "{s}", r"[A-Z]+_\w", "concat(right(m, 1), '+', lower(left(m, length(m) - 2)), '_\\9')"
    )),
)
CHECKS["regex_case_title"] = over(
    "inv_parts", new_name=on_stem("name", each_match("{s}", r"[\w ]+", titled("m")))
)
CHECKS["regex_whole_name"] = over("inv_orders", new_name=r"regexp_replace(name, '\.(\w+)$', '_\1.bak')")
CHECKS["regex_anchors"] = over("inv_docs", new_name="concat('new_', name)")
# An empty match precedes every character that is no digit, and the end.
CHECKS["regex_empty_matches"] = over(
    "inv_orders",
    new_name=on_stem("name", (
        "concat(array_to_string(list_transform(regexp_extract_all({s}, '[0-9]+|[^0-9]'), "
        "lambda c: case when c >= '0' and c < ':' then '#' else concat('#', c) end), ''), '#')"
    )),
)
CHECKS["regex_invalid_identity"] = over("inv_orders", new_name="name")
CHECKS["regex_missing_group_identity"] = over("inv_orders", new_name="name")

# Dates

MONTHS = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"


def written(match: str, layouts: list[tuple[str, str]], fmt: str) -> str:
    """First layout that parses, in the wanted format, else the match.

    A layout is a strptime format and a condition on the match.
    """
    cases = ""
    for layout, condition in layouts:
        # Two-digit years always belong to the 2000s.
        full = layout
        text = match
        if "%y" in layout:
            full = layout.replace("%y", "%Y")
            text = f"concat('20', {match})" if layout.startswith("%y") else f"concat(left({match}, 6), '20', right({match}, 2))"
        date = f"try_strptime({text}, '{full}')"
        parts = {
            "%Y": f"lpad(cast(year({date}) as varchar), 4, '0')",
            "%m": f"lpad(cast(month({date}) as varchar), 2, '0')",
            "%d": f"lpad(cast(day({date}) as varchar), 2, '0')",
            "%b": f"{MONTHS}[month({date})]",
            "%U": f"strftime({date}, '%U')",
            "%W": f"strftime({date}, '%W')",
            "%-d": f"cast(day({date}) as varchar)",
            "%-m": f"cast(month({date}) as varchar)",
        }
        pieces = [parts.get(piece, f"'{piece}'") for piece in re.findall("%-?.|.", fmt)]
        cases += f" when {condition} and {date} is not null and year({date}) >= 1 then concat({', '.join(pieces)})"
    return f"case{cases} else {match} end"


N1, N2, N3 = ("cast(substr(m, {}, 2) as int)".format(i) for i in (1, 4, 7))


def day_first(sep: str) -> list[tuple[str, str]]:
    return [
        (f"%d{sep}%m{sep}%Y", f"({N1} > 12 or {N2} <= 12)"),
        (f"%m{sep}%d{sep}%Y", f"({N1} <= 12)"),
    ]


def month_first(sep: str) -> list[tuple[str, str]]:
    return [
        (f"%d{sep}%m{sep}%Y", f"({N1} > 12)"),
        (f"%m{sep}%d{sep}%Y", f"({N1} <= 12)"),
    ]


PASSES = {
    "ymd_space": [(r"\b\d{4} \d{2} \d{2}\b", [("%Y %m %d", "true")])],
    "year_end": [(r"\b\d{2} \d{2} \d{4}\b", day_first(" "))],
    "two_digit": [(
        r"\b\d{2} \d{2} \d{2}\b",
        [("%y %m %d", f"({N1} > 12 or {N3} <= 12)"), ("%m %d %y", f"({N1} <= 12)")],
    )],
    "dot": [(r"\b\d{2}\.\d{2}\.\d{4}\b", day_first("."))],
    "common": [
        (r"\d{4}-\d{2}-\d{2}", [("%Y-%m-%d", "true")]),
        (r"\d{2}-\d{2}-\d{4}", month_first("-")),
        (r"\d{4}/\d{2}/\d{2}", [("%Y/%m/%d", "true")]),
        (r"\d{2}/\d{2}/\d{4}", month_first("/")),
        (r"\d{8}", [("%Y%m%d", "true")]),
        (r"\d{8}", [("%Y%m%d", "true")]),
    ],
}
PASSES["all"] = [p for key in ("ymd_space", "year_end", "two_digit", "dot", "common") for p in PASSES[key]]


def date_steps(key: str, fmt: str = "%Y.%m.%d") -> list[str]:
    return [each_match("v", pattern, written("m", layouts, fmt)) for pattern, layouts in PASSES[key]]


def dated(source: str, columns: str, key: str, fmt: str = "%Y.%m.%d") -> str:
    return steps(source, columns, stem("name"), date_steps(key, fmt))


for _key in PASSES:
    CHECKS[f"dates_{_key}"] = dated(inventory_sql("inv_orders"), f"file_id, concat(v, {ext('name')}) as new_name", _key)
CHECKS["dates_flip_quirk"] = dated(
    inventory_sql("inv_orders"), f"file_id, concat(v, {ext('name')}) as new_name", "all", "%d-%m-%Y"
)
CHECKS["dates_named_month"] = dated(
    inventory_sql("inv_orders"), f"file_id, concat(v, {ext('name')}) as new_name", "all", "%d %b %Y"
)
for _key, _format in (("week_numbers", "%Y week %U or %W"), ("without_padding", "%-d.%-m.%Y")):
    CHECKS[f"dates_{_key}"] = dated(
        inventory_sql("inv_orders"), f"file_id, concat(v, {ext('name')}) as new_name", "all", _format
    )
CHECKS["dates_text"] = steps("documents", "doc_id, v as text", "text", date_steps("all"))

# Cleaning and previews


def renamed(edits: list) -> str:
    """Inventory of orders with the result of the edits as v.

    An edit is an expression over the stem {s}, or ("dates", format).
    """
    ctes, n = [f"s0 as (select *, name as v, '' as e from {inventory_sql('inv_orders')} src)"], 0
    for edit in edits:
        if isinstance(edit, tuple):
            expressions = [f"({stem('v')})"] + date_steps("all", edit[1])
            ctes.append(f"s{n + 1} as (select * replace ({stem('v')} as v, {ext('v')} as e) from s{n})")
            n += 1
            for expression in expressions[1:]:
                ctes.append(f"s{n + 1} as (select * replace ({expression} as v) from s{n})")
                n += 1
            ctes.append(f"s{n + 1} as (select * replace (concat(v, e) as v) from s{n})")
        else:
            ctes.append(f"s{n + 1} as (select * replace ({on_stem('v', edit)} as v) from s{n})")
        n += 1
    return f"(with {', '.join(ctes)} select * exclude (e) from s{n})"


CHECKS["clean_names"] = "select file_id, v as new_name from " + renamed([
    "replace({s}, '-', '_')", capitalized(True), r"regexp_replace({s}, 'order\s+', 'Doc ', 'g')",
    each_match("{s}", r"(?i)order\s+", "concat(lower(rtrim(m)), ' ')"), ("dates", "%Y-%m-%d"),
]) + " t"

PREVIEWED = renamed(["replace({s}, 'order ', 'o ')", ("dates", "%Y.%m.%d")])
CHECKS["preview_changes"] = f"select name as original, v as new_name, path from {PREVIEWED} t where v <> name"
CHECKS["preview_table"] = f"""
select t.parent, row_number() over (partition by t.parent order by t.name) as idx,
  exists (select 1 from {inventory_sql('inv_orders')} c where c.size % 3 = 0 and c.parent = t.parent and c.name = t.name) as selected,
  t.name as current, v as new, v <> name as altered
from {PREVIEWED} t"""
CHECKS["preview_summary"] = f"""
select count(*) as files, count_if(altered) as altered, count_if(selected) as selected,
  count_if(altered and selected) as selected_altered
from ({CHECKS['preview_table']}) p"""

def changes_sql() -> str:
    return RENUMBERED.replace("{part}", "part")


CHANGES = "(select parent, name as original, v as new_name from " + renamed([
    ("dates", "%Y.%m.%d"), "regexp_replace({s}, ' [1-3]-[a-z]+$', '')", "regexp_replace({s}, '5-low$', '5-LOW')",
]) + " t where v <> name)"
CHECKS["apply_selection"] = f"""
select * from {CHANGES} t where exists (
  select 1 from {inventory_sql('inv_orders')} c where c.size % 3 = 0 and c.parent = t.parent and c.name = t.original)"""
CHECKS["rename_plan"] = f"""
with changes as {CHANGES}, files as (select distinct parent, name from {inventory_sql('inv_orders')} f),
judged as (
  select c.*, t.name is not null as taken, min(original) over (partition by c.parent, new_name) as first,
    lower(original) = lower(new_name) as case_only
  from changes c left join files t on t.parent = c.parent and t.name = c.new_name),
rated as (
  select parent, original, new_name, case
    when case_only and (taken or original <> first) then 'case_only_overwrites'
    when case_only then 'case_only'
    when taken then 'target_exists'
    when original <> first then 'duplicate_target'
    else 'ok' end as status
  from judged)
select *, case when status in ('target_exists', 'duplicate_target')
  then concat('Cannot rename ''', original, ''': ''', new_name, ''' already exists') else '' end as message
from rated"""
CHECKS["rename_counts"] = f"select status, count(*) as changes from ({CHECKS['rename_plan']}) p group by status"
CHECKS["rename_summary"] = f"""
select count_if(message = '') as success_count, count_if(message <> '') as error_count
from ({CHECKS['rename_plan']}) p"""
CHECKS["rename_sink"] = CHECKS["rename_plan"]
CHECKS["rename_steps"] = f"""
with recursive files as (select distinct parent, name from {inventory_sql('inv_numbered')} f),
moves as (
  select parent, min(original) as original, new_name from (
    select c.parent, original, min(new_name) as new_name from ({changes_sql()}) c
    join files f on f.parent = c.parent and f.name = c.original where new_name <> original group by c.parent, original) m
  group by parent, new_name),
nodes as (
  select m.*, n.original as next, n.original is null and f.name is not null as stuck from moves m
  left join moves n on n.parent = m.parent and n.original = m.new_name
  left join files f on f.parent = m.parent and f.name = m.new_name),
walk as (
  select parent, original, [original] as seen, next, stuck from nodes
  union all
  select w.parent, w.original, list_append(seen, n.original), n.next, n.stuck
  from walk w join nodes n on n.parent = w.parent and n.original = w.next where not list_contains(seen, w.next)),
longest as (select parent, original, arg_max(struct_pack(seen := seen, next := next, stuck := stuck), len(seen)) as w from walk group by parent, original),
numbered as (
  select n.parent, n.original, n.new_name, w.next is not null as cyclic, list_min(w.seen) as least, len(w.seen) as length,
    case when w.next is null then len(w.seen) when list_min(w.seen) = n.original then len(w.seen) else list_position(w.seen, list_min(w.seen)) - 1 end as step
  from nodes n join longest l using (parent, original) where not w.stuck),
ways as (
  select *, (cyclic and least = original) or lower(original) = lower(new_name) as by_way,
    concat('_temp_', left(sha256(concat(parent, original)), 16)) as halfway from numbered)
select parent, step, original as from_name, new_name as to_name from ways where not by_way
union all select parent, 0, original, halfway from ways where by_way
union all select parent, step, halfway, new_name from ways where by_way"""
CHECKS["rename_errors"] = f"select parent, original, message from ({CHECKS['rename_plan']}) p where message <> ''"

# Inventories


def parts(source: str, root: str, where: str = "true") -> str:
    name = "regexp_extract(path, '[^/]*$')"
    return f"""
select '{root}' as root, left(path, length(path) - length({name})) as parent, path,
  substr(path, {len(root) + 2}) as relative_path, {name} as name, size, lower({ext(name)}) as extension
from {inventory_sql(source)} f where {where}"""


CHECKS["path_parts"] = parts("inv_pages", "/web")
CHECKS["scan_inventory"] = parts("inv_pages_by_language", "/web/en", "path like '/web/en/%'")
CHECKS["scan_names"] = parts(
    "inv_pages_by_language", "/web/en", "path like '/web/en/%' and path not like '/web/en/%/%'"
)
CHECKS["scan_tree"] = """
select distinct concat('p_brand=', replace(p_brand, '#', '%23'), '/class=', p_size % 3) as folder, 1 as files from part"""
CHECKS["child_folders"] = f"""
select distinct split_part(path, '/', 3) as folder, 0 as more_folders
from {inventory_sql('inv_pages')} f where path like '/web/%/%'"""
CHECKS["child_folders_first"] = f"""
with folders as (
  select distinct split_part(path, '/', 3) as folder from {inventory_sql('inv_pages')} f where path like '/web/%/%')
select folder, greatest((select count(*) from folders) - 20, 0) as more_folders
from folders order by folder limit 20"""

# Matching

LEFT, RIGHT = inventory_sql("inv_parts_a"), inventory_sql("inv_parts_b")
CORPUS = f"(select path, name from {LEFT} a union all select path, name from {RIGHT} b)"
TOKENS = rf"regexp_extract_all(lower({stem('name')}), '[a-z]+|\d+')"
WEIGHTS = f"""
tokens as (select path, unnest({TOKENS}) as token from corpus),
tf as (select path, token, count(*) as tf from tokens group by path, token),
idf as (
  select token, count(*) as df, ln((select count(*) from corpus) / count(*)) as idf from tf group by token),
weights as (select path, token, tf * idf as w from tf join idf using (token)),
norms as (select path, sqrt(sum(w * w)) as norm from weights group by path)"""

CHECKS["inventory_counts"] = f"""
select 'left' as side, count(*) as files from {LEFT} a union all select 'right', count(*) from {RIGHT} b"""
CHECKS["corpus_union"] = f"select name from {CORPUS} c"
CHECKS["tf"] = f"with corpus as {CORPUS}, {WEIGHTS} select path, token, tf from tf"
CHECKS["idf"] = f"with corpus as {CORPUS}, {WEIGHTS} select token, df, round(idf, 6) as idf from idf"
CHECKS["vector_norm"] = f"with corpus as {CORPUS}, {WEIGHTS} select path, round(norm, 6) as norm from norms"
CHECKS["vector_norm_self"] = f"""
with corpus as (select path, name from {inventory_sql('inv_parts')} p),
tokens as (select path, unnest({TOKENS}) as token from corpus),
tf as (select path, token, count(*) as tf from tokens group by path, token),
idf as (select token, ln((select count(*) from corpus) / count(*)) as idf from tf group by token),
norms as (select path, sqrt(sum((tf * idf) ** 2)) as norm from tf join idf using (token) group by path)
select path, round(norm, 6) as norm from norms cross join (values (1), (2)) side(s)"""
CHECKS["token_union"] = r"""
select p_partkey, array_to_string(list_sort(list_distinct(
  regexp_extract_all(lower(concat(p_name, ' ', p_brand, ' x')), '[a-z]+|\d+'))), ' ') as tokens
from part"""
CHECKS["extension_blocks"] = f"""
select extension, l * r as pairs
from (select lower({ext('name')}) as extension, count(*) as l from {LEFT} a group by 1) a
join (select lower({ext('name')}) as extension, count(*) as r from {RIGHT} b group by 1) b using (extension)"""

SIZES = """(
select o_orderkey, size1, size2, name_sim,
  case when size1 = size2 then 1.0 else least(size1, size2)::double / greatest(size1, size2)::double end as size_sim
from (
  select o_orderkey, (o_custkey % 101) / 100.0::double as name_sim,
    cast(case when o_orderkey % 5 = 0 then 0 else floor(o_totalprice) end as bigint) as size1,
    cast(case when o_orderkey % 7 = 0 then 0 when o_orderkey % 3 = 0 then floor(o_totalprice)
      else floor(o_totalprice) + o_custkey * 11 end as bigint) as size2
  from orders) s)"""


def reasons(name_sim: str, size_sim: str) -> str:
    return f"""concat(
  case when {name_sim} >= 0.95 then 'Name exact match' when {name_sim} >= 0.8 then 'Name very similar' else 'Name similar' end, ', ',
  case when {size_sim} >= 0.99 then 'Size exact match' when {size_sim} >= 0.95 then 'Size very close' else 'Size similar' end)"""


CHECKS["size_similarity"] = f"select o_orderkey, round(size_sim, 6) as size_similarity from {SIZES} s"
CHECKS["confidence_scores"] = f"""
select o_orderkey, round(name_sim * 0.6::double + size_sim * 0.4::double, 6) as weighted, round(name_sim, 6) as by_name
from {SIZES} s"""
CHECKS["match_reasons"] = f"select o_orderkey, {reasons('name_sim', 'size_sim')} as reasons from {SIZES} s"


def readable(size: str) -> str:
    units = ["B", "KB", "MB", "GB", "TB"]
    cases = "".join(
        f" when {size} < {1024 ** (i + 1)} then printf('%.1f {u}', {size} / {1024 ** i}::double)" for i, u in enumerate(units)
    )
    return f"case{cases} else printf('%.1f PB', {size} / {1024 ** 5}::double) end"


CHECKS["format_size"] = f"""
select o_orderkey, {readable('s')} as size
from (select o_orderkey, cast(floor(o_totalprice) * power(32, o_orderkey % 8) as bigint) as s from orders) t"""
CHECKS["format_percent"] = """
select l_orderkey, l_linenumber, printf('%.1f%%', (l_orderkey % 1024) / 1024.0::double * 100) as percent,
  printf('%.1f%%', (l_partkey % 2001) / 2000.0::double * 100) as of_thousands,
  printf('%.1f%%', (l_orderkey % 10001) / 10000.0::double * 100) as of_ten_thousands,
  printf('%.1f%%', l_linenumber / (l_linenumber + l_quantity) * 100) as ratio
from lineitem"""


def matches(left: str, right: str, threshold: float, by_name: bool = False, all_pairs: bool = False, digits: int = 6) -> str:
    confidence = "sim" if by_name else "sim * 0.6::double + size_sim * 0.4::double"
    return f"""
with l as (select *, lower({ext('name')}) as extension from {left} a),
r as (select *, lower({ext('name')}) as extension from {right} b),
corpus as (select concat('l', path) as path, name from l union all select concat('r', path), name from r),
{WEIGHTS},
dots as (
  select a.path as p1, b.path as p2, sum(a.w * b.w) as dot
  from (select l.path, l.extension, token, w from l join weights w on w.path = concat('l', l.path)) a
  join (select r.path, r.extension, token, w from r join weights w on w.path = concat('r', r.path)) b
    on a.extension = b.extension and a.token = b.token
  group by 1, 2),
scored as (
  select l.name as file1_name, l.path as file1_path, l.relative_path as file1_relative_path, l.size as file1_size,
    r.name as file2_name, r.path as file2_path, r.relative_path as file2_relative_path, r.size as file2_size,
    case when coalesce(n1.norm * n2.norm, 0) = 0 then 0 else coalesce(dot, 0) / (n1.norm * n2.norm) end as sim,
    case when l.size = r.size then 1.0 else least(l.size, r.size)::double / greatest(l.size, r.size)::double end as size_sim
  from l join r on l.extension = r.extension
  {'left' if all_pairs else ''} join dots on p1 = l.path and p2 = r.path
  left join norms n1 on n1.path = concat('l', l.path) left join norms n2 on n2.path = concat('r', r.path))
select * exclude (sim, size_sim), round(sim, {digits}) as name_similarity, round(size_sim, {digits}) as size_similarity,
  round({confidence}, {digits}) as confidence, {reasons('sim', 'size_sim')} as reasons
from scored where sim >= {threshold}::double - 1e-12"""


CHECKS["find_duplicates_tfidf"] = matches(LEFT, RIGHT, 0.7)
CHECKS["find_duplicates_tfidf_strict"] = matches(LEFT, RIGHT, 0.9)
CHECKS["find_duplicates_name_confidence"] = matches(LEFT, RIGHT, 0.7, by_name=True)
CHECKS["find_duplicates_self"] = matches(inventory_sql("inv_parts"), inventory_sql("inv_parts"), 0.95)
CHECKS["find_duplicates_zero_threshold"] = matches(
    inventory_sql("inv_open"), inventory_sql("inv_closed"), 0.0, all_pairs=True
)
CHECKS["match_report"] = f"""
select file1_path as full_path_1, {readable('file1_size')} as size_1,
  file2_path as full_path_2, {readable('file2_size')} as size_2,
  printf('%.1f%%', name_similarity * 100) as name_match, printf('%.1f%%', size_similarity * 100) as size_match,
  printf('%.1f%%', confidence * 100) as confidence, reasons as reason
from ({matches(LEFT, RIGHT, 0.7, digits=15)}) m"""
CHECKS["match_counts"] = f"select reasons, count(*) as matches from ({matches(LEFT, RIGHT, 0.7)}) m group by reasons"


def ratios(pairs: str) -> str:
    """CTEs that end in ``ratios``: the sequence similarity ``sim`` of pairs ``a, b`` below 200 characters.

    The longest common block, of equal ones the leftmost in a, then in b, splits
    a pair of stretches in two; sizes of blocks add up.
    """
    return f"""
pairs as (select row_number() over () as id, a, b, length(a) as la, length(b) as lb from ({pairs}) p),
lefts as (select id, unnest(range(la)) as i, unnest(string_split(a, '')) as c from pairs where la > 0),
rights as (select id, unnest(range(lb)) as j, unnest(string_split(b, '')) as c from pairs where lb > 0),
hits as (select l.id, i, j - i as d from lefts l join rights r on r.id = l.id and r.c = l.c),
runs as (
  select id, d, min(i) as low, max(i) + 1 as high
  from (select *, i - row_number() over (partition by id, d order by i) as run from hits) h group by id, d, run),
stretches as (
  select id, 0::bigint as alo, la::bigint as ahi, 0::bigint as blo, lb::bigint as bhi, 0::bigint as size from pairs
  union all
  select id, unnest([alo, best.i + best.n]), unnest([best.i, ahi]), unnest([blo, best.j + best.n]), unnest([best.j, bhi]), unnest([best.n, 0])
  from (
    select id, alo, ahi, blo, bhi, struct_pack(n := best.n, i := -best.i, j := -best.j) as best from (
      select id, alo, ahi, blo, bhi, max(struct_pack(n := e - s, i := -s, j := -s - d)) as best from (
        select t.*, d, greatest(low, alo, blo - d) as s, least(high, ahi, bhi - d) as e
        from stretches t join runs using (id)) clipped
      where e > s group by id, alo, ahi, blo, bhi) found) b),
ratios as (
  select any_value(a) as a, any_value(b) as b, case when any_value(la + lb) = 0 then 1.0 else 2.0::double * sum(size) / any_value(la + lb) end as sim
  from stretches join pairs using (id) group by id)"""


def half_up(value: str) -> str:
    """Six decimals, ties of a value as it is written upwards."""
    return f"round(cast(({value})::varchar as decimal(30, 20)), 6)::double"


def sequence_matches(left: str, right: str, threshold: float) -> str:
    """Matches by sequence similarity; pairs with too few characters in common are not scored."""
    return f"""
with recursive l as (select *, lower({ext('name')}) as extension, lower({stem('name')}) as k from {left} a),
r as (select *, lower({ext('name')}) as extension, lower({stem('name')}) as k from {right} b),
counts as (
  select k, c, count(*) as n from (select k, unnest(string_split(k, '')) as c from (select k from l union select k from r) n) s group by k, c),
candidates as (
  select p.a, p.b from (select distinct l.k as a, r.k as b from l join r using (extension)) p
  join counts x on x.k = p.a join counts y on y.k = p.b and y.c = x.c
  where 2 * least(length(p.a), length(p.b)) >= {threshold} * (length(p.a) + length(p.b))
  group by p.a, p.b having 2 * sum(least(x.n, y.n)) >= {threshold} * (length(p.a) + length(p.b))),
{ratios('select * from candidates')},
scored as (
  select l.name as file1_name, l.path as file1_path, l.relative_path as file1_relative_path, l.size as file1_size,
    r.name as file2_name, r.path as file2_path, r.relative_path as file2_relative_path, r.size as file2_size, sim,
    case when l.size = r.size then 1.0 else least(l.size, r.size)::double / greatest(l.size, r.size)::double end as size_sim
  from l join r using (extension) join ratios on l.k = a and r.k = b)
select * exclude (sim, size_sim), {half_up('sim')} as name_similarity, {half_up('size_sim')} as size_similarity,
  {half_up('sim * 0.6::double + size_sim * 0.4::double')} as confidence, {reasons('sim', 'size_sim')} as reasons
from scored where sim >= {threshold}::double"""


CHECKS["find_duplicates_sequence"] = sequence_matches(LEFT, RIGHT, 0.7)
CHECKS["find_duplicates_sequence_strict"] = sequence_matches(LEFT, RIGHT, 0.9)
CHECKS["name_similarity"] = f"""
with recursive {ratios("select distinct lower(p_name) as a, lower(concat(p_type, ' ', p_brand)) as b from part")}
select p_partkey, round(sim, 6) as name_similarity
from part join ratios on a = lower(p_name) and b = lower(concat(p_type, ' ', p_brand))"""
