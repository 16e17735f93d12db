"""Rename plans: what applying a set of changes would do, as a table."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import split_lookup
from .stored import delete_folder, path_exists, stored

#: How temporary names begin (fixed value).
TEMPORARY = "_temp_"


def apply_selection(changes: DataFrame, selection: DataFrame) -> DataFrame:
    """Changes of the selected files; empty new names are left out.

    ``selection`` holds original names as ``name``, or those with ``parent``. A
    name that very many files share is looked up in several tasks; counting the
    names runs a job.
    """
    keys = {"original": "name"} | ({"parent": "parent"} if "parent" in selection.columns else {})
    chosen = selection.select(*[F.col(c).alias(k) for k, c in keys.items()]).distinct()
    eligible = changes.filter((F.col("new_name") != "") & (F.col("new_name") != F.col("original")))
    # Counted before the filter, so that no new name has to be computed for it.
    counts = changes.groupBy(*keys).agg(F.count("*").alias("_rows"))
    spread = [c for c in changes.columns if c not in ("new_name", *keys)] or ["new_name"]
    return split_lookup(eligible, chosen, list(keys), counts, "_rows", spread, how="left_semi")


def _with_parent(changes: DataFrame) -> DataFrame:
    if "parent" in changes.columns:
        return changes.select("parent", "original", "new_name")
    parent = F.left("path", F.length("path") - F.length("original"))
    return changes.select(parent.alias("parent"), "original", "new_name")


def _names(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """What each name in a folder is: a file, a wanted target, a source.

    One aggregate over the inventory and both ends of all changes, so that the
    inventory is shuffled once, summed up before.
    """
    no, yes = F.lit(False), F.lit(True)
    nobody = F.lit(None).cast("string").alias("claimant")
    roles = (
        inventory.select(_folder("parent"), "name", yes.alias("exists"), nobody, no.alias("source"))
        .unionAll(wanted.select("_folder", "new_name", no, "original", no))
        .unionAll(wanted.select("_folder", "original", no, nobody, yes))
    )
    return roles.groupBy("_folder", "name").agg(
        F.max("exists").alias("exists"), F.min("claimant").alias("first"),
        F.count("claimant").alias("claims"), F.max("source").alias("source"),
    ).filter((F.col("claims") > 0) | F.col("source"))


def _folder(column: str):
    # No path holds NUL, so a missing folder gets a key of its own.
    return F.coalesce(column, F.lit("\0")).alias("_folder")


def rename_plan(changes: DataFrame, inventory: DataFrame) -> DataFrame:
    """(parent, original, new_name, status, message) for every change.

    All changes are judged against the same snapshot, the inventory. If several
    want one new name in a folder, the first by original name gets it. ``ok``,
    ``case_only`` and ``case_only_overwrites`` would be carried out. Files and
    changes without a folder form one of their own.
    """
    wanted = stored(_with_parent(changes).select("*", _folder("parent")))
    names = stored(_names(wanted, inventory))
    targets = names.filter("claims > 0").select("_folder", F.col("name").alias("new_name"), F.col("exists").alias("taken"), "first", "claims")
    sources = names.filter("source").select("_folder", F.col("name").alias("original"), F.col("exists").alias("present"))
    judged = split_lookup(wanted, targets.drop("claims"), ["_folder", "new_name"], targets, "claims", ["original"])
    judged = judged.join(sources, ["_folder", "original"])

    original, new = F.col("original"), F.col("new_name")
    case_only = (F.lower(original) == F.lower(new)) & (original != new)
    status = (
        F.when(~F.col("present"), "source_missing")
        .when(new == "", "empty_name")
        .when(F.contains(new, F.lit("/")) | new.isin(".", ".."), "invalid_name")
        # Nothing checks the target of a rename that only changes case.
        .when(case_only & (F.col("taken") | (original != F.col("first"))), "case_only_overwrites")
        .when(case_only, "case_only")
        .when(F.col("taken"), "target_exists")
        .when(original != F.col("first"), "duplicate_target")
        .otherwise("ok")
    )
    # The texts of messages are fixed values.
    failed = F.concat(F.lit("Error renaming '"), original, F.lit("': "))
    message = (
        F.when(
            F.col("status").isin("target_exists", "duplicate_target"),
            F.concat(F.lit("Cannot rename '"), original, F.lit("': '"), new, F.lit("' already exists")),
        )
        .when(F.col("status") == "source_missing", F.concat(failed, F.lit("no such file")))
        .when(F.col("status") == "empty_name", F.concat(failed, F.lit("the new name is empty")))
        .when(F.col("status") == "invalid_name", F.concat(failed, F.lit("the new name is not a file name")))
        .otherwise("")
    )
    return (
        judged.withColumn("status", status)
        .withColumn("message", message)
        .select("parent", "original", "new_name", "status", "message")
    )


RENAMED = ("ok", "case_only", "case_only_overwrites")


def rename_counts(plan: DataFrame) -> DataFrame:
    """Changes per status."""
    return plan.groupBy("status").agg(F.count("*").alias("changes"))


def rename_summary(plan: DataFrame) -> DataFrame:
    """One row: how many changes would succeed and how many would not."""
    done = F.col("status").isin(*RENAMED)
    return plan.agg(F.count_if(done).alias("success_count"), F.count_if(~done).alias("error_count"))


def rename_errors(plan: DataFrame) -> DataFrame:
    """The changes that would fail, with the reason."""
    return plan.filter(~F.col("status").isin(*RENAMED)).select("parent", "original", "message")


def write_plan(plan: DataFrame, path: str) -> str:
    """Add a plan to the Parquet table of plans at ``path`` and return its number; a plan that is there adds nothing.

    Plans are folders ``plan=<number>``, where the number follows from the rows
    alone. The rows are computed once, into a folder that readers of the table
    don't see, and numbered from there. Then they are written to the plan's
    folder, which Spark's committer fills at once; a folder that an attempt left
    without its mark of success is written anew. So a plan is there whole or not
    at all, and repeating a write, or two writes at a time, changes nothing.
    """
    spark = plan.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    try:
        plan.write.parquet(staged)
        rows = spark.read.schema(plan.schema).parquet(staged)
        hashes = [F.sum(F.xxhash64(F.lit(i), *plan.columns).cast("decimal(20,0)")).cast("string") for i in range(2)]
        count, *sums = rows.agg(F.count("*"), *hashes).first()
        number = hashlib.sha256(f"{plan.columns} {count} {sums}".encode()).hexdigest()[:32]
        final = f"{path}/plan={number}"
        if not path_exists(spark, f"{final}/_SUCCESS"):
            rows.write.mode("overwrite").parquet(final)
    finally:
        delete_folder(spark, staged)
    return number


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all plans at ``path``, with their number as ``plan``."""
    return spark.read.parquet(path)


def _linked(nodes: DataFrame, longest: int) -> DataFrame:
    """``hops`` to the last node that ``to`` leads to from each one, its ``stuck``, and the ``least`` name on the way.

    Pointers are doubled until they all end or, on cycles, which don't, until
    they have gone around once. Each round is a written table.
    """
    reach = 1
    while True:
        ahead = nodes.select(
            "_folder", F.col("original").alias("to"), F.col("to").alias("_to"), F.col("hops").alias("_hops"),
            F.col("stuck").alias("_stuck"), F.col("least").alias("_least"),
        )
        if reach > longest or nodes.filter("to is not null").isEmpty():
            return nodes
        follow = F.col("_hops").isNotNull()
        nodes = stored(nodes.join(ahead, ["_folder", "to"], "left").select(
            "_folder", "original", "new_name", F.col("_to").alias("to"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.when(follow, F.col("_stuck")).otherwise(F.col("stuck")).alias("stuck"), F.least("least", "_least").alias("least"),
        ))
        reach *= 2


def rename_steps(changes: DataFrame, inventory: DataFrame) -> DataFrame:
    """(parent, step, from_name, to_name): renames that carry out changes in ascending order of step.

    Unlike ``rename_plan``, which judges every change against one snapshot, this
    lets a file take a name that another change gives up first. Within a folder
    changes form chains, original to new name. The end of a chain is renamed
    first, in step 1, and each file before it a step later; nothing is ever
    overwritten. Files that exchange their names form a cycle: one of them, the
    first by name, gets a temporary name in step 0 and its new one in the last
    step. Renames that only change case go by a temporary name as well.

    Left out are changes of missing files, to no or no valid name, to the name
    of a file that stays, those that wait for one of these, and all but the first by
    original name of those that want the same name; of a file with several new
    names the first. Renames of one step may be carried out side by side.
    """
    wanted = _with_parent(changes).select("*", _folder("parent")).filter(
        (F.col("new_name") != F.col("original")) & (F.col("new_name") != "") & ~F.contains("new_name", F.lit("/")) & ~F.col("new_name").isin(".", "..")
    )
    files = inventory.select(_folder("parent"), "name").distinct()
    # A file's one new name, then a name's one file.
    moves = wanted.groupBy("_folder", "original").agg(F.min("new_name").alias("new_name"))
    moves = moves.join(files.withColumnRenamed("name", "original"), ["_folder", "original"], "left_semi")
    moves = stored(moves.groupBy("_folder", "new_name").agg(F.min("original").alias("original")))
    leaving = moves.select("_folder", F.col("original").alias("new_name"), F.lit(True).alias("leaves"))
    targets = files.select("_folder", F.col("name").alias("new_name"), F.lit(True).alias("taken"))
    joined = moves.join(leaving, ["_folder", "new_name"], "left").join(targets, ["_folder", "new_name"], "left")
    to = F.when(F.col("leaves"), F.col("new_name"))
    nodes = stored(joined.select(
        "_folder", "original", "new_name", to.alias("to"), F.when(to.isNotNull(), 1).otherwise(0).cast("long").alias("hops"),
        (F.col("taken").isNotNull() & to.isNull()).alias("stuck"), F.col("original").alias("least"),
    ))
    longest = nodes.filter("to is not null").groupBy("_folder").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    walked = _linked(nodes, longest)
    chained = walked.filter("to is null and not stuck").select("_folder", "original", "new_name", (F.col("hops") + 1).alias("step"), F.lit(False).alias("first"))

    # Cut before its first file a cycle is a chain that ends there.
    round_trip = walked.filter("to is not null").select("_folder", "original", "new_name", "least")
    first = F.col("original") == F.col("least")
    cut = stored(round_trip.select(
        "_folder", "original", "new_name", F.when(~first, F.col("new_name")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("hops"),
        F.lit(False).alias("stuck"), "least",
    ))
    lengths = round_trip.groupBy("_folder", "least").agg(F.count("*").alias("length"))
    cycled = _linked(cut, longest).select("_folder", "original", "new_name", "hops").join(round_trip.select("_folder", "original", "least"), ["_folder", "original"])
    cycled = cycled.join(lengths, ["_folder", "least"]).select(
        "_folder", "original", "new_name", F.when(first, F.col("length")).otherwise(F.col("hops")).alias("step"), first.alias("first")
    )

    by_way = F.col("first") | (F.lower("original") == F.lower("new_name"))
    temporary = F.concat(F.lit(TEMPORARY), F.left(F.sha2(F.concat("_folder", "original"), 256), F.lit(16)))
    parent = F.when(F.col("_folder") != "\0", F.col("_folder")).alias("parent")
    steps = stored(chained.union(cycled)).withColumn("by", F.when(by_way, temporary))
    step = F.col("step").cast("long")
    return steps.select(parent, F.explode(F.when(by_way, F.array(
        F.struct(F.lit(0).cast("long").alias("step"), F.col("original").alias("from_name"), F.col("by").alias("to_name")),
        F.struct(step.alias("step"), F.col("by").alias("from_name"), F.col("new_name").alias("to_name")),
    )).otherwise(F.array(F.struct(step.alias("step"), F.col("original").alias("from_name"), F.col("new_name").alias("to_name"))))).alias("do")).select(
        "parent", "do.step", "do.from_name", "do.to_name"
    )
