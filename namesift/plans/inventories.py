"""File inventories projected from the tables at hand.

Each is one SQL text that Spark and the checking engine both run; table names
are in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _digits(part: str, width: int) -> str:
    return f"lpad(cast({part}(o_orderdate) as varchar(4)), {width}, '0')"


_Y, _M, _D = _digits("year", 4), _digits("month", 2), _digits("day", 2)

_ORDER_DATE = f"""case o_orderkey % 8
  when 0 then concat({_Y}, ' ', {_M}, ' ', {_D})
  when 1 then concat({_D}, ' ', {_M}, ' ', {_Y})
  when 2 then concat(substr({_Y}, 3, 2), ' ', {_M}, ' ', {_D})
  when 3 then concat({_D}, '.', {_M}, '.', {_Y})
  when 4 then concat({_Y}, '-', {_M}, '-', {_D})
  when 5 then concat({_D}, '-', {_M}, '-', {_Y})
  when 6 then concat({_Y}, {_M}, {_D})
  else concat({_D}, {_M}, {_Y}) end"""

_PAGE_PATH = "trim(trailing '/' from split_part(split_part(split_part(url, '://', 2), '?', 1), '#', 1))"

INVENTORIES = {
    # Names with dates in eight shapes.
    "inv_orders": f"""
select file_id, '/data' as root, parent, name, concat(parent, name) as path, size from (
  select o_orderkey as file_id,
    concat('/data/c', cast(o_custkey % 7 as varchar(9)), '/') as parent,
    concat('order ', {_ORDER_DATE}, ' ', lower(o_orderpriority),
      case o_orderstatus when 'F' then '.pdf' when 'O' then '.txt' else '' end) as name,
    cast(floor(o_totalprice * 100) as bigint) as size
  from {{orders}}) files""",
    # Two sides with similar names.
    "inv_parts_a": """
select file_id, name, concat('/a/', relative_path) as path, relative_path, size from (
  select file_id, name, concat(cast(file_id as varchar(20)), '/', name) as relative_path, size from (
    select p_partkey as file_id,
      concat(p_name, ' ', p_type, ' ', p_brand, case when p_partkey % 3 = 0 then '.pdf' else '.TXT' end) as name,
      cast(p_size * 1024 as bigint) as size
    from {part} where p_partkey % 2 = 1) names) files""",
    "inv_parts_b": """
select file_id, name, concat('/b/', relative_path) as path, relative_path, size from (
  select file_id, name, concat(cast(file_id as varchar(20)), '/', name) as relative_path, size from (
    select p_partkey as file_id,
      concat(upper(p_name), '_', p_type, '-', p_brand, case when p_partkey % 3 = 0 then '.pdf' else '.txt' end) as name,
      cast(p_size * 1000 as bigint) as size
    from {part} where p_partkey % 2 = 0) names) files""",
    # Both sides' parts together.
    "inv_parts": """
select file_id, name, concat('/p/', relative_path) as path, relative_path, size from (
  select file_id, name, concat(cast(file_id as varchar(20)), '/', name) as relative_path, size from (
    select p_partkey as file_id,
      concat(upper(p_name), '_', p_type, '-', p_brand, case when p_partkey % 3 = 0 then '.pdf' else '.txt' end) as name,
      cast(p_size * 1000 as bigint) as size
    from {part}) names) files""",
    # Two sides whose files share an extension only within a customer.
    "inv_open": """
select file_id, name, concat('/open/', name) as path, name as relative_path, size from (
  select o_orderkey as file_id,
    concat('order ', lower(o_orderpriority), ' ', cast(o_orderkey as varchar(20)), '.c', cast(o_custkey as varchar(20))) as name,
    cast(floor(o_totalprice) as bigint) as size
  from {orders} where o_orderstatus = 'O') files""",
    "inv_closed": """
select file_id, name, concat('/closed/', name) as path, name as relative_path, size from (
  select o_orderkey as file_id,
    concat('closed ', lower(o_orderpriority), '_', cast(o_orderkey as varchar(20)), '.C', cast(o_custkey as varchar(20))) as name,
    cast(floor(o_totalprice) as bigint) as size
  from {orders} where o_orderstatus <> 'O') files""",
    # Numbered files, ten to a chain of renames, and a file that stays for each chain.
    "inv_numbered": """
select file_id, parent, name, concat(parent, name) as path, size from (
  select p_partkey as file_id, concat('/n/', cast(cast(floor(p_partkey / 10) as bigint) % 3 as varchar(9)), '/') as parent,
    concat('part ', cast(p_partkey as varchar(20)), '.txt') as name, cast(p_size as bigint) as size
  from {part}
  union all
  select p_partkey, concat('/n/', cast(cast(floor(p_partkey / 10) as bigint) % 3 as varchar(9)), '/'), concat('kept ', cast(p_partkey as varchar(20)), '.txt'), 0
  from {part} where p_partkey % 10 = 0) files""",
    # Nested paths: by host, and by language.
    "inv_pages": f"""
select page_id as file_id, concat('/web/', {_PAGE_PATH}) as path,
  cast(length(html) as bigint) as size
from {{pages}}""",
    "inv_pages_by_language": f"""
select page_id as file_id,
  concat('/web/', split_part({_PAGE_PATH}, '/', 2), '/',
    case when page_id % 2 = 0 then concat(split_part({_PAGE_PATH}, '/', 1), '/') else '' end,
    split_part({_PAGE_PATH}, '/', 1), '_', cast(page_id as varchar(20)), '.HTML') as path,
  cast(length(html) as bigint) as size
from {{pages}}""",
    # Names in four languages.
    "inv_docs": """
select doc_id as file_id,
  concat(source, '.', lang, ' ', replace(text, '/', ' '),
    case doc_id % 3 when 0 then '.Docx' when 1 then '.' else '' end) as name,
  n_chars as size
from {documents}""",
}

#: New names for numbered files: chains that end free, at a file that stays, in a
#: cycle, or at a name that differs in case only.
RENUMBERED = f"""
select parent, name as original, case
    when file_id % 10 = 9 and series % 4 = 0 then concat('part ', cast(file_id - 9 as varchar(20)), '.txt')
    when file_id % 10 = 9 and series % 4 = 1 then concat('part ', cast(file_id as varchar(20)), ' last.txt')
    when file_id % 10 = 9 and series % 4 = 2 then concat('kept ', cast(file_id - 9 as varchar(20)), '.txt')
    when file_id % 10 = 9 or (file_id % 10 = 4 and series % 5 = 0) then concat('PART ', cast(file_id as varchar(20)), '.txt')
    else concat('part ', cast(file_id + 1 as varchar(20)), '.txt') end as new_name
from (select *, cast(floor(file_id / 10) as bigint) as series from ({INVENTORIES["inv_numbered"]}) numbered) files
where name like 'part %'"""

TABLES = ("orders", "part", "pages", "documents")


def inventory(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named inventory over the Parquet tables of a folder."""
    sql = INVENTORIES[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes ``RENUMBERED`` of the inventory ``inv_numbered``."""
    return spark.sql(RENUMBERED, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def inventory_sql(name: str) -> str:
    """The same inventory as a parenthesized query over plain table names."""
    return "(" + INVENTORIES[name].format(**{t: t for t in TABLES}) + ")"
