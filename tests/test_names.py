import random
import re

import pytest
from pyspark.sql import functions as F

from namesift import functions as fn
from namesift.operators.clean import clean_names, parse_operations, replace_pairs


def split(name):
    i = name.rfind(".")
    return (name[:i], name[i:]) if 0 < i < len(name) - 1 else (name, "")


def raised(word):
    """Lower case but for the first letter."""
    at = next((i for i, c in enumerate(word) if c.isalpha()), len(word))
    return "".join(c.upper() if i == at else c.lower() for i, c in enumerate(word))


def recased(text, upper_first):
    """Words between separators begin with a capital, the very first one only on demand."""
    words = re.split(r"([_. -]+)", text)
    first = words[0] if upper_first else None
    return "".join([raised(first) if first is not None else "".join(map(str.lower, words[0])), *map(raised, words[1:])])


ALPHABET = "aB9.-_ éÉßΣ中ǆ😀(ñ"


@pytest.fixture(scope="module")
def random_names():
    rng = random.Random(7)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(1, 12))) for _ in range(1500)]


def test_split(apply, random_names):
    fixed = ["plan.ods", "v1.2.tar.gz", "LICENCE", ".profile", "open.", "..up", "x..y"]
    names = fixed + random_names
    got = apply(lambda n: F.array(fn.stem(n), fn.extension(n)), names)
    assert got == [list(split(n)) for n in names]


def test_split_drops_folders(apply):
    assert apply(lambda n: F.array(fn.stem(n), fn.extension(n)), ["a/b.c", "a.x/b/"]) == [["b", ".c"], ["b", ""]]


def test_canonical_paths(apply):
    paths = ["/a//b/./c", "/a/b/../c/", "a/../../b", "/..", "x", "./", "", "/", None]
    assert apply(fn.canonical_path, paths) == ["/a/b/c", "/a/c", "../b", "/", "x", ".", "", "/", None]


def test_null_names(apply):
    for f in (fn.stem, fn.extension, fn.replace_string, fn.to_camel_case, fn.standardize_dates, fn.tokenize,
              lambda n: fn.regex_replace(n, "a", "b"), lambda n: fn.regex_replace(n, "(a)", r"\U\1")):
        assert apply(f, [None]) == [None]


@pytest.mark.parametrize("source, replacement, name, expected", [
    ("+", "-", "sum+total+v2.csv", "sum-total-v2.csv"),
    ("an", "", "banana.an", "ba.an"),
    ("[", "<", "list[0].json", "list<0].json"),
    (".", "", "v1.2.3.tar", "v123.tar"),
    ("", "~", "x😀.md", "~x~😀~.md"),
])
def test_replace_string(apply, source, replacement, name, expected):
    assert apply(lambda n: fn.replace_string(n, source, replacement), [name]) == [expected]


@pytest.mark.parametrize("upper_first", [False, True])
def test_camel_case(apply, random_names, upper_first):
    names = ["q3 sales PLAN.ods", "north-east_ROUTE.gpx", "v_2BETA", "-dash", "7up", "a._-b"] + random_names
    expected = [recased(split(n)[0], upper_first) + split(n)[1] for n in names]
    assert apply(lambda n: fn.to_camel_case(n, upper_first), names) == expected


def test_title_case(apply, random_names):
    texts = ["o'clock x9y"] + [n for n in random_names if "Σ" not in n]
    assert apply(fn.title_case, texts) == [t.title() for t in texts]


def test_operations_chain(spark):
    files = spark.createDataFrame([("minutes 2019 07 04 FINAL.odt",), ("x.odt",)], "name string")
    operations = [
        {"type": "replace_string", "source": " ", "replacement": "_"},
        {"type": "standardize_dates", "format": "%Y-%m-%d"},
        {"type": "rotate"},
        {"type": "camel_case"},
    ]
    got = {r["name"]: r["new_name"] for r in clean_names(files, operations).collect()}
    assert got == {"minutes 2019 07 04 FINAL.odt": "minutes_2019_07_04_Final.odt", "x.odt": "x.odt"}


def test_later_operations_see_new_extensions(spark):
    files = spark.createDataFrame([("a b",)], "name string")
    operations = [
        {"type": "regex", "pattern": " ", "replacement": ".", "preserve_extension": False},
        {"type": "replace_string", "source": "b", "replacement": "c"},
    ]
    assert clean_names(files, operations).first()["new_name"] == "a.b"


def test_operation_defaults_and_pairs():
    replace, regex, dates = parse_operations([{"type": "replace_string"}, {"type": "regex"}, {"type": "standardize_dates"}])
    assert (replace.source, replace.replacement) == (".", "_")
    assert (regex.pattern, regex.replacement, regex.preserve_extension) == ("", "", True)
    assert dates.format == "%Y.%m.%d"
    assert [p.source for p in replace_pairs([("a", "b"), ("", "c")])] == ["a"]


def test_chain_stays_in_one_stage(spark):
    files = spark.range(10).select(F.concat(F.lit("f "), F.col("id").cast("string")).alias("name"))
    changed = clean_names(files, [{"type": "camel_case"}, {"type": "replace_string"}] * 5).filter("new_name != name")
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(plan) < 60_000
