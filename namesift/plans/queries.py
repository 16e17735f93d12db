"""Registered queries: one per operator or job, over whole tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import dates
from ..functions.scores import confidence
from ..operators import clean, folders, match, preview, rename, vectors
from ..operators.stored import shared_folder
from ..sources.directory import scan_inventory as scan_directory
from ..sources.inventory import scan_table, with_path_parts
from .inventories import inventory, renumbered

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

CLEANING = [
    {"type": "replace_string", "source": "-", "replacement": "_"},
    {"type": "camel_case", "upper_first": True},
    {"type": "regex", "pattern": r"order\s+", "replacement": "Doc "},
    {"type": "regex", "pattern": r"(?i)(order)\s+", "replacement": r"\L\1 "},
    {"type": "standardize_dates", "format": "%Y-%m-%d"},
    {"type": "unknown"},
]

PREVIEWING = [
    {"type": "replace_string", "source": "order ", "replacement": "o "},
    {"type": "standardize_dates"},
]

# Maps many names of a folder to one, and some to names already taken.
RENAMING = [
    {"type": "standardize_dates"},
    {"type": "regex", "pattern": r" [1-3]-[a-z]+$", "replacement": ""},
    {"type": "regex", "pattern": r"5-low$", "replacement": r"5-LOW"},
]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _named(name: str, source: str, **columns) -> None:
    """Register a projection of column functions over an inventory."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = inventory(spark, sf_dir, source)
        return files.select("file_id", *[f(F.col("name")).alias(c) for c, f in columns.items()])

    QUERIES[name] = run


# Names
_named("split_name_ext", "inv_docs", stem=fn.stem, ext=fn.extension)
_named("replace_string", "inv_docs", new_name=lambda n: fn.replace_string(n))
_named("replace_empty_source", "inv_docs", new_name=lambda n: fn.replace_string(n, "", "_"))
_named("camel_case", "inv_docs", new_name=lambda n: fn.to_camel_case(n))
_named("pascal_case", "inv_docs", new_name=lambda n: fn.to_camel_case(n, upper_first=True))
_named("title_case", "inv_docs", new_name=fn.title_case)
_named("tokenize", "inv_docs", tokens=lambda n: F.array_join(fn.tokenize(n), "|"))


@query
def replace_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = clean.replace_pairs([(" ", "_"), ("", "x"), ("e", "é"), ("é_", "-"), (".", "")])
    return clean.clean_names(inventory(spark, sf_dir, "inv_docs"), pairs).select("file_id", "new_name")


# Regular expressions
_named(
    "regex_groups", "inv_orders",
    new_name=lambda n: fn.regex_replace(n, r"(?P<a>\d{2})[ .-](\d{2})[ .-](\d{2})", r"\g<3>0\2-\g<a>"),
)
_named("regex_case_upper", "inv_orders", new_name=lambda n: fn.regex_replace(n, r"([a-z]+)", r"\U\1"))
_named("regex_case_lower", "inv_parts", new_name=lambda n: fn.regex_replace(n, r"([A-Z]+)_(\w)", r"\2+\L\1_\9"))
_named("regex_case_title", "inv_parts", new_name=lambda n: fn.regex_replace(n, r"([\w ]+)", r"\T\1"))
_named(
    "regex_whole_name", "inv_orders",
    new_name=lambda n: fn.regex_replace(n, r"\.(\w+)$", r"_\1.bak", preserve_extension=False),
)
_named("regex_anchors", "inv_docs", new_name=lambda n: fn.regex_replace(n, r"^", "new_"))
_named("regex_empty_matches", "inv_orders", new_name=lambda n: fn.regex_replace(n, r"[0-9]*", "#"))
_named("regex_invalid_identity", "inv_orders", new_name=lambda n: fn.regex_replace(n, r"[invalid(", "test"))
_named("regex_missing_group_identity", "inv_orders", new_name=lambda n: fn.regex_replace(n, r"(o)(r)", r"\3"))


# Dates
def _dates(name: str, passes, fmt: str = dates.DEFAULT_FORMAT) -> None:
    _named(
        name, "inv_orders",
        new_name=lambda n: fn.names.edit_stem(n, lambda text: dates.rewrite_dates(text, fmt, passes)),
    )


_dates("dates_ymd_space", dates.SPACED_YEAR_FIRST)
_dates("dates_year_end", dates.SPACED_YEAR_LAST)
_dates("dates_two_digit", dates.SPACED_SHORT_YEAR)
_dates("dates_dot", dates.DOTTED)
_dates("dates_common", dates.COMMON)
_dates("dates_all", dates.ALL_PASSES)
_dates("dates_flip_quirk", dates.ALL_PASSES, "%d-%m-%Y")
_dates("dates_named_month", dates.ALL_PASSES, "%d %b %Y")


_dates("dates_week_numbers", dates.ALL_PASSES, "%Y week %U or %W")
_dates("dates_without_padding", dates.ALL_PASSES, "%-d.%-m.%Y")


@query
def dates_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select("doc_id", fn.standardize_dates(F.col("text"), scope="text").alias("text"))


# Cleaning and previews
@query
def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_names(inventory(spark, sf_dir, "inv_orders"), CLEANING).select("file_id", "new_name")


@query
def preview_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.preview_changes(inventory(spark, sf_dir, "inv_orders"), PREVIEWING)


def _selection(files: DataFrame) -> DataFrame:
    return files.filter("size % 3 = 0").select("parent", "name")


@query
def preview_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inventory(spark, sf_dir, "inv_orders")
    return preview.preview_table(files, PREVIEWING, _selection(files))


@query
def preview_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.preview_summary(preview_table(spark, sf_dir))


def _changes(files: DataFrame) -> DataFrame:
    cleaned = clean.clean_names(files, RENAMING)
    return preview.altered_only(cleaned.select("parent", F.col("name").alias("original"), "new_name"))


@query
def apply_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inventory(spark, sf_dir, "inv_orders")
    return rename.apply_selection(_changes(files), _selection(files))


@query
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inventory(spark, sf_dir, "inv_orders")
    return rename.rename_plan(_changes(files), files)


@query
def rename_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_counts(rename_plan(spark, sf_dir))


@query
def rename_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_summary(rename_plan(spark, sf_dir))


@query
def rename_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_errors(rename_plan(spark, sf_dir))


@query
def rename_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan, written twice and read back; the second write adds nothing."""
    plan = rename_plan(spark, sf_dir)
    path = f"{shared_folder(spark)}/namesift-plans-{uuid.uuid4().hex}"
    for _ in range(2):
        rename.write_plan(plan, path)
    return rename.read_plans(spark, path).select(*plan.columns)


@query
def rename_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename.rename_steps(renumbered(spark, sf_dir), inventory(spark, sf_dir, "inv_numbered"))


# Inventories
@query
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_path_parts(inventory(spark, sf_dir, "inv_pages"), "/web")


@query
def scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(inventory(spark, sf_dir, "inv_pages_by_language"), "/web/en")


@query
def scan_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_table(inventory(spark, sf_dir, "inv_pages_by_language"), "/web/en", include_subdirs=False)


@query
def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data files per folder of a real tree, as Spark writes it: a folder for each brand and class of sizes."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", F.expr("p_size % 3").alias("class"))
    path = f"{shared_folder(spark)}/namesift-tree-{uuid.uuid4().hex}"
    part.repartition("p_brand", "class").write.partitionBy("p_brand", "class").parquet(path)
    files = scan_directory(spark, re.sub("^file:/*", "/", path)).filter("extension = '.parquet'")
    folder = F.regexp_extract("relative_path", "^(.*)/", 1).alias("folder")
    return files.groupBy(folder).agg(F.count("*").alias("files"))


@query
def child_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.child_folders(inventory(spark, sf_dir, "inv_pages"), "/web")


@query
def child_folders_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list of limited length shows, and how many folders it leaves over."""
    return folders.child_folders(inventory(spark, sf_dir, "inv_pages"), "/web", limit=20)


@query
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folders.inventory_counts(*_sides(spark, sf_dir))


# Matching
def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return inventory(spark, sf_dir, "inv_parts_a"), inventory(spark, sf_dir, "inv_parts_b")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return left.select("path", "name").unionAll(right.select("path", "name"))


@query
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return left.select("name").unionAll(right.select("name"))


@query
def tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.term_frequencies(_corpus(spark, sf_dir), ["path"])


@query
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.inverse_document_frequencies(_corpus(spark, sf_dir))
    return out.withColumn("idf", F.round("idf", 6))


@query
def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.vector_norms(_corpus(spark, sf_dir), ["path"])
    return out.withColumn("norm", F.round("norm", 6))


@query
def vector_norm_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are one inventory, so each path is there twice."""
    files = inventory(spark, sf_dir, "inv_parts").select("path", "name")
    out = vectors.vector_norms(files.unionAll(files), ["path"])
    return out.withColumn("norm", F.round("norm", 6))


@query
def token_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    both = F.array_union(fn.tokenize(F.col("p_name")), fn.tokenize(F.concat("p_brand", F.lit(" "), "p_name", F.lit(" x"))))
    return part.select("p_partkey", F.array_join(F.sort_array(both), " ").alias("tokens"))


@query
def extension_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs the extension block admits, counted without forming them."""
    left, right = (match.with_file_columns(side) for side in _sides(spark, sf_dir))
    counts = [side.groupBy("extension").agg(F.count("*").alias(n)) for side, n in ((left, "l"), (right, "r"))]
    return counts[0].join(counts[1], "extension").select("extension", (F.col("l") * F.col("r")).alias("pairs"))


def _order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes with zeros and equal values among them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        "o_orderkey",
        F.expr("cast(case when o_orderkey % 5 = 0 then 0 else floor(o_totalprice) end as bigint)").alias("size1"),
        F.expr(
            "cast(case when o_orderkey % 7 = 0 then 0 when o_orderkey % 3 = 0 then floor(o_totalprice)"
            " else floor(o_totalprice) + o_custkey * 11 end as bigint)"
        ).alias("size2"),
        F.expr("(o_custkey % 101) / 100.0d").alias("name_sim"),
    )


@query
def size_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _order_sizes(spark, sf_dir)
    score = fn.size_similarity(F.col("size1"), F.col("size2"))
    return sizes.select("o_orderkey", F.round(score, 6).alias("size_similarity"))


def _scored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_sizes(spark, sf_dir).withColumn(
        "size_sim", fn.size_similarity(F.col("size1"), F.col("size2"))
    )


@query
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    name_sim, size_sim = F.col("name_sim"), F.col("size_sim")
    return _scored_sizes(spark, sf_dir).select(
        "o_orderkey",
        F.round(confidence(name_sim, size_sim), 6).alias("weighted"),
        F.round(confidence(name_sim, size_sim, "name"), 6).alias("by_name"),
    )


@query
def match_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_sizes(spark, sf_dir).select(
        "o_orderkey", fn.match_reasons(F.col("name_sim"), F.col("size_sim")).alias("reasons")
    )


@query
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    size = F.expr("cast(floor(o_totalprice) * power(32, o_orderkey % 8) as bigint)")
    return orders.select("o_orderkey", fn.format_size(size).alias("size"))


@query
def format_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    shares = {
        "percent": "(l_orderkey % 1024) / 1024.0d",
        "of_thousands": "(l_partkey % 2001) / 2000.0d",
        "of_ten_thousands": "(l_orderkey % 10001) / 10000.0d",
        "ratio": "l_linenumber / (l_linenumber + l_quantity)",
    }
    return lineitem.select("l_orderkey", "l_linenumber", *[fn.format_percent(F.expr(s)).alias(c) for c, s in shares.items()])


def _rounded(matches: DataFrame) -> DataFrame:
    scored = ("name_similarity", "size_similarity", "confidence")
    return matches.withColumns({c: F.round(c, 6) for c in scored})


@query
def find_duplicates_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.find_duplicates(*_sides(spark, sf_dir)))


@query
def find_duplicates_tfidf_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.find_duplicates(*_sides(spark, sf_dir), name_threshold=0.9))


@query
def find_duplicates_name_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.find_duplicates(*_sides(spark, sf_dir), confidence="name"))


@query
def find_duplicates_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inventory(spark, sf_dir, "inv_parts")
    return _rounded(match.find_duplicates(files, files, name_threshold=0.95))


@query
def find_duplicates_zero_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of one extension; extensions stay small here however many files there are."""
    left, right = inventory(spark, sf_dir, "inv_open"), inventory(spark, sf_dir, "inv_closed")
    return _rounded(match.find_duplicates(left, right, name_threshold=0.0))


@query
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_report(match.find_duplicates(*_sides(spark, sf_dir)))


@query
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = match.find_duplicates(*_sides(spark, sf_dir), ordered=False)
    return matches.groupBy("reasons").agg(F.count("*").alias("matches"))


@query
def find_duplicates_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.find_duplicates(*_sides(spark, sf_dir), use_tfidf=False))


@query
def find_duplicates_sequence_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(match.find_duplicates(*_sides(spark, sf_dir), name_threshold=0.9, use_tfidf=False))


@query
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    score = fn.name_similarity(F.concat("p_name", F.lit(".txt")), F.concat("p_type", F.lit(" "), "p_brand"))
    return part.select("p_partkey", F.round(score, 6).alias("name_similarity"))
