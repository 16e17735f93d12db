import os
import random

import pytest
from pyspark.sql import functions as F

from namesift.operators import folders, rename, skew
from namesift.operators.ordering import with_sorted_index
from namesift.operators.preview import preview_changes, preview_summary, preview_table
from namesift.sources import directory
from namesift.sources.directory import scan_inventory, scan_names
from namesift.sources.inventory import scan_table, with_path_parts
from namesift.streaming.preview import write_changes

SPACES = [{"type": "replace_string", "source": " ", "replacement": "_"}]


def inventory(spark, paths, root=""):
    return with_path_parts(spark.createDataFrame([(p, 1) for p in paths], "path string, size long"), root)


def test_path_parts(spark):
    row = inventory(spark, ["/r/a/B.TXT"], "/r").first().asDict()
    assert row == {
        "root": "/r", "parent": "/r/a/", "path": "/r/a/B.TXT", "relative_path": "a/B.TXT",
        "name": "B.TXT", "size": 1, "extension": ".txt",
    }


def test_scan_table(spark):
    files = spark.createDataFrame([("/r/a", 1), ("/r/s/b", 1), ("/rx/c", 1)], "path string, size long")
    assert {r["path"] for r in scan_table(files, "/r").collect()} == {"/r/a", "/r/s/b"}
    assert {r["name"] for r in scan_table(files, "/r/", include_subdirs=False).collect()} == {"a"}


@pytest.fixture
def tree(tmp_path):
    for path in ("a b.txt", ".hidden", "_x", "sub/deep/c.PDF", "sub/d", "other/e.tar.gz"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("12345" if "b" in path else "")
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "a b.txt", tmp_path / "link.txt")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    os.symlink(tmp_path / "sub", tmp_path / "loop")
    return tmp_path


def test_directory_scan(spark, tree):
    rows = {r["relative_path"]: r for r in scan_inventory(spark, f"{tree}/").collect()}
    assert set(rows) == {"a b.txt", ".hidden", "_x", "sub/deep/c.PDF", "sub/d", "other/e.tar.gz", "link.txt"}
    assert (rows["a b.txt"]["size"], rows["link.txt"]["size"], rows["_x"]["size"]) == (5, 5, 0)
    assert rows["sub/deep/c.PDF"]["extension"] == ".pdf" and rows["other/e.tar.gz"]["extension"] == ".gz"
    assert rows["sub/d"]["path"] == str(tree / "sub" / "d")
    flat = {r["name"] for r in scan_names(spark, str(tree)).collect()}
    assert flat == {"a b.txt", ".hidden", "_x", "link.txt"}
    assert scan_inventory(spark, str(tree / "missing")).count() == 0


def test_only_tasks_open_folders(spark, tree, monkeypatch):
    opened = []
    scandir = os.scandir
    monkeypatch.setattr(directory.os, "scandir", lambda path: opened.append(path) or scandir(path))
    assert scan_inventory(spark, str(tree)).count() == 7
    assert scan_names(spark, str(tree)).count() == 4
    assert not opened  # by this process, the driver


def test_folders_larger_than_a_batch(tmp_path, monkeypatch):
    monkeypatch.setattr(directory, "BATCH_ENTRIES", 7)
    for i in range(30):
        (tmp_path / f"f{i}").touch()
    batches = list(directory.list_folder(str(tmp_path)))
    assert [b.num_rows for b in batches] == [7, 7, 7, 7, 2]
    assert list(directory.list_folder(str(tmp_path / "missing"))) == []


def test_deep_and_wide_trees(spark, tmp_path):
    deep = tmp_path.joinpath(*"abcdefgh")
    deep.mkdir(parents=True)
    for i in range(8):
        tmp_path.joinpath(*"abcdefgh"[: i + 1], "file").touch()
    for i in range(60):
        (tmp_path / f"w{i}").mkdir()
        (tmp_path / f"w{i}" / f"x{i}").touch()
    want = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()}
    assert {r.relative_path for r in scan_inventory(spark, str(tmp_path)).collect()} == want
    assert len(want) == 68


def test_preview_changes(spark, tree):
    changes = preview_changes(scan_names(spark, str(tree)), SPACES).collect()
    assert [tuple(r) for r in changes] == [("a b.txt", "a_b.txt", str(tree / "a b.txt"))]
    nothing = [{"type": "replace_string", "source": "notfound"}]
    assert preview_changes(scan_names(spark, str(tree)), nothing).count() == 0


def test_preview_table_and_summary(spark):
    files = inventory(spark, ["/d/b c", "/d/a", "/e/z z", "/d/C"])
    selection = spark.createDataFrame([("b c",), ("a",)], "name string")
    table = preview_table(files, SPACES, selection)
    rows = {(r["parent"], r["idx"]): (r["selected"], r["current"], r["new"], r["altered"]) for r in table.collect()}
    assert rows == {
        ("/d/", 1): (False, "C", "C", False), ("/d/", 2): (True, "a", "a", False),
        ("/d/", 3): (True, "b c", "b_c", True), ("/e/", 1): (False, "z z", "z_z", True),
    }
    assert tuple(preview_summary(table).first()) == (4, 2, 2, 1)
    assert tuple(preview_summary(preview_table(files, [])).first()) == (4, 0, 0, 0)


def test_sorted_index_with_one_large_group(spark):
    rng = random.Random(5)
    names = ["".join(rng.choices("abcé😀Z", k=rng.randint(1, 6))) for _ in range(6000)]
    rows = [("big" if i % 3 else f"g{i % 7}", n) for i, n in enumerate(names)]
    got = with_sorted_index(spark.createDataFrame(rows, "grp string, name string"), "grp", "name").collect()
    expected = []
    for group in {g for g, _ in rows}:
        expected += [(group, n, i) for i, n in enumerate(sorted(n for g, n in rows if g == group), 1)]
    assert sorted(tuple(r) for r in got) == sorted(expected)


def plan(spark, paths, changes):
    files = inventory(spark, paths)
    table = spark.createDataFrame(changes, "original string, new_name string, path string")
    return {(r["original"], r["new_name"]): (r["status"], r["message"]) for r in rename.rename_plan(table, files).collect()}


def test_rename_plan(spark):
    paths = ["/d/" + n for n in ("old", "file", "file1", "file2", "x", "y", "case", "CASE", "e", "s")] + ["/e/free"]
    got = plan(spark, paths, [
        ("old", "new", "/d/old"), ("file", "FILE", "/d/file"), ("file1", "file2", "/d/file1"), ("gone", "g", "/d/gone"),
        ("x", "same", "/d/x"), ("y", "same", "/d/y"), ("case", "CASE", "/d/case"), ("e", "", "/d/e"), ("s", "a/b", "/d/s"),
        ("file2", "free", "/d/file2"),
    ])
    assert {k[0]: v[0] for k, v in got.items()} == {
        "old": "ok", "file": "case_only", "file1": "target_exists", "gone": "source_missing", "x": "ok",
        "y": "duplicate_target", "case": "case_only_overwrites", "e": "empty_name", "s": "invalid_name", "file2": "ok",
    }
    assert got["file1", "file2"][1] == "Cannot rename 'file1': 'file2' already exists"
    assert got["gone", "g"][1].startswith("Error renaming 'gone': ")
    assert got["old", "new"][1] == ""


def test_rename_summaries(spark):
    files = inventory(spark, ["/d/a", "/d/b", "/d/c"])
    changes = spark.createDataFrame([("a", "z", "/d/a"), ("b", "z", "/d/b"), ("c", "", "/d/c")], "original string, new_name string, path string")
    made = rename.rename_plan(changes, files)
    assert tuple(rename.rename_summary(made).first()) == (1, 2)
    assert {tuple(r) for r in rename.rename_counts(made).collect()} == {("ok", 1), ("duplicate_target", 1), ("empty_name", 1)}
    assert {r["original"] for r in rename.rename_errors(made).collect()} == {"b", "c"}
    chosen = spark.createDataFrame([("a",), ("c",)], "name string")
    assert [r["original"] for r in rename.apply_selection(changes, chosen).collect()] == ["a"]


def test_plan_is_written(spark, tmp_path):
    files = inventory(spark, ["/d/a"])
    changes = spark.createDataFrame([("a", "b", "/d/a")], "original string, new_name string, path string")
    rename.write_plan(rename.rename_plan(changes, files), str(tmp_path / "plan"))
    assert spark.read.parquet(str(tmp_path / "plan")).first()["status"] == "ok"


def test_writing_a_plan_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "plans")
    files = inventory(spark, [f"/d/{i}" for i in range(9)])
    table = lambda n: spark.createDataFrame([(str(i), f"n{i}", f"/d/{i}") for i in range(n)], "original string, new_name string, path string")
    one, two = (rename.rename_plan(table(n), files) for n in (5, 9))
    first = rename.write_plan(one, path)
    assert rename.write_plan(one.repartition(3), path) == first
    os.remove(tmp_path / "plans" / f"plan={first}" / "_SUCCESS")  # as if the writer had been stopped
    assert rename.write_plan(one, path) == first != rename.write_plan(two, path)
    found = rename.read_plans(spark, path)
    assert {(r.plan == first, r["count"]) for r in found.groupBy("plan").count().collect()} == {(True, 5), (False, 9)}
    assert sorted(os.listdir(path)) == sorted(f"plan={p.plan}" for p in found.select("plan").distinct().collect())


def carried_out(names, steps):
    """The names after the steps, each of which must find its file and not overwrite another."""
    now = {n: n for n in names}  # name now by name at first
    for step in sorted({s for s, _, _ in steps}):
        moving = {a: b for s, a, b in steps if s == step}
        assert len(moving) == sum(s == step for s, _, _ in steps)
        there = {n: first for first, n in now.items()}
        for a, b in moving.items():
            assert a in there and (b not in there), (step, a, b)
        now = {first: moving.get(n, n) for first, n in now.items()}
        assert len(set(now.values())) == len(now)
    return now


def moved(spark, names, changes):
    files = inventory(spark, [f"/d/{n}" for n in names])
    table = spark.createDataFrame([(a, b, f"/d/{a}") for a, b in changes], "original string, new_name string, path string")
    rows = rename.rename_steps(table, files).collect()
    assert {r.parent for r in rows} <= {"/d/"}
    return carried_out(names, [(r.step, r.from_name, r.to_name) for r in rows])


def test_steps_of_chains_cycles_and_cases(spark):
    names = ["a", "b", "c", "x", "y", "z", "one", "two", "case", "Q", "q", "stays", "to stay", "waits", "p1", "p2", "odd"]
    changes = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("one", "two"), ("two", "one"), ("case", "CASE"), ("Q", "q"),
               ("q", "Q"), ("to stay", "stays"), ("waits", "to stay"), ("p1", "new"), ("p2", "new"), ("gone", "g"), ("odd", ""), ("odd", "a/b"), ("stays", "stays")]
    now = moved(spark, names, changes)
    want = dict(changes[:11]) | {"p1": "new"}
    assert {a: b for a, b in now.items() if a != b} == want


def test_steps_of_random_changes(spark):
    rng = random.Random(8)
    for size in (12, 80):
        names = [f"n{i}" for i in range(size)]
        targets = rng.sample([f"n{i}" for i in range(size + size // 4)], size)
        changes = [(a, b) for a, b in zip(names, targets, strict=True) if rng.random() < 0.9]
        now = moved(spark, names, changes)
        wanted = {a: b for a, b in changes if a != b}
        left = {a for a in wanted if now[a] != wanted[a]}
        stay = set(names) - set(wanted) | left
        # What is left waits for a file that stays.
        assert all(wanted[a] in stay for a in left)
        assert all(now[a] == a for a in stay)


def test_steps_of_one_long_chain(spark):
    names = [f"n{i:03}" for i in range(300)]
    now = moved(spark, names, [(a, f"n{int(a[1:]) + 1:03}") for a in names])
    assert now == {a: f"n{int(a[1:]) + 1:03}" for a in names}
    ring = moved(spark, names, [(a, f"n{(int(a[1:]) + 7) % 300:03}") for a in names])
    assert ring == {a: f"n{(int(a[1:]) + 7) % 300:03}" for a in names}
    assert moved(spark, ["a"], []) == {"a": "a"}


def test_selection_of_a_name_that_many_files_share(spark, monkeypatch):
    from namesift.operators import preview

    spread = []
    original = skew.split_lookup

    def low(*args, **kw):
        out = original(*args, **kw, min_rows=5)
        spread.append(kw["how"])
        return out

    for module in (rename, preview):
        monkeypatch.setattr(module, "split_lookup", low)
    files = inventory(spark, [f"/d{i}/same name" for i in range(60)] + ["/e/b c", "/e/x y", "/e/z"])
    changes = preview_changes(files, SPACES)
    selection = spark.createDataFrame([("same name",), ("same name",), ("b c",), ("none",), (None,)], "name string")
    chosen = rename.apply_selection(changes, selection)
    assert sorted(r.path for r in chosen.collect()) == sorted([f"/d{i}/same name" for i in range(60)] + ["/e/b c"])
    table = preview_table(files, SPACES, selection)
    assert tuple(preview_summary(table).first()) == (63, 62, 61, 61)
    assert spread == ["left_semi", "left"]


def test_child_folders(spark):
    files = inventory(spark, [f"/r/f{i:02}/x" for i in range(25)] + ["/r/top", "/q/z/x"])
    assert [tuple(r) for r in folders.child_folders(files, "/r").collect()] == [(f"f{i:02}", 0) for i in range(25)]
    rows = folders.child_folders(files, "/r", limit=20).collect()
    assert [r["folder"] for r in rows] == [f"f{i:02}" for i in range(20)]
    assert {r["more_folders"] for r in rows} == {5}
    assert folders.child_folders(files, "/r/f01").count() == 0
    counts = folders.inventory_counts(files, files.filter("false").unionByName(files.limit(2)))
    assert {tuple(r) for r in counts.collect()} == {("left", 27), ("right", 2)}


def test_changes_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a b", "/d/a b"), ("c", "/d/c")], "name string, path string").write.parquet(source)
    stream = spark.readStream.schema("name string, path string").parquet(source)
    operations = SPACES + [{"type": "standardize_dates"}]
    query = write_changes(stream, operations, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(60)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a b", "a_b", "/d/a b")]
