import random
import re

import pytest
from pyspark.sql import functions as F

from namesift import functions as fn
from namesift.functions.regex import compile_pattern
from namesift.operators.clean import RegexReplace

NAMES = [
    "room12-b7.csv", "aa--bb{1}{2}.md", "ab cd.txt", "o'clock x9y", "x  <1>  <copy>", "zz top.pdf", "été ΑΒΓ-٢٥",
    "a\nb\n", "$1 \\ {x}", "😀a😀", "😀😀b𝒳", "", "naïve café", "A_b-C.d", "aa bb aa", "foo bar\x1fx",
]

# A case for each feature of the dialect.
PATTERNS = [
    (r"[0-9]{2,}", "no"), (r"([a-z]+)(\d+)", r"\2\1"), (r"(?P<q>a)(b)", r"\g<2>0\g<q>"), (r"(\w+)", r"<\1>"),
    (r"\{.*?\}", "{}"), (r"[\t ]{2,}", " "), (r"\A", "new "), (r"\Z", " old"), (r"^a+", "A"), (r"[-<>,;]+", "."),
    ("^", "in "), ("$", " out"),
    (r"x*", "-"), (r"(.*)", r"[\1]"), (r"\b", "|"), (r"\bа?\w", "#"), (r"(?i)AB", "$1"), (r"(a)|(b)", r"\1x\2"),
    (r"(?<=a)b|(?!z)c", r"\\"), (r"(\w)\1", r"\1"), (r"[^\w\s]", r"\."), (r"[[a&&b]", "?"), (r"(a)?(?(1)b|c)", "!"),
    (r".", "."), (r"(?s).", ","), (r"(?m)^", ">"), (r"\W+", r"\t"), (r"\D", "d"), (r"\S{2,3}?", "s"), (r"a{,1}b", "r"),
    (r"(?:a|b)++", "p"), (r"\Aa|b\Z", "e"), (r"(a)(b)", r"\3"), (r"a", r"\q"), (r"a", r"\g<name>"), (r"(é)", r"\g<0>\060"),
    ("(open", "x"), ("[z-a]", ""), (r"(?P<n>a)(?P=n)", r"\g<n>"), (r"(?a)\w", "w"), (r"(?x) a b # c", "x"),
    (r"\d*", "~"), (r"a??", "="), (r"(?=a)", "^"), (r"\B", "_"), (r"(?:b|)", "o"),
    (r"a?b?", "+"), (r"(?:|a)", "+"), (r"(?:x*|b)", "+"), (r"(a|b*)*", "+"), (r"(?>a*)", "+"), (r"(?:a*)++", "+"), (r"a*?b?", "+"),
    (r"(a)?(b)?", r"<\2>"), (r"(?i)B*", "+"), (r"(?m)$", ";"), (r"[^a]*", "+"), (r"(?<=😀)", "+"), ("😀*", "+"), (r"(?<!a)", "+"),
    (r"(a??)(b*)", "+"), (r"(?=(a)?)", "+"), (r"\b|a", "+"), (r"(?:a|\b)", "+"), ("", "+"),
]


def substituted(name, pattern, replacement):
    try:
        return re.sub(pattern, replacement, name)
    except (re.error, IndexError):
        return name


@pytest.mark.parametrize("pattern, replacement", PATTERNS)
def test_plain_templates_match_python(apply, pattern, replacement):
    got = apply(lambda n: fn.regex_replace(n, pattern, replacement, preserve_extension=False), NAMES)
    assert got == [substituted(n, pattern, replacement) for n in NAMES]


def cased(name, pattern, replacement):
    """The rule for case templates, by scanning the template."""
    def one(match):
        out, i = "", 0
        while i < len(replacement):
            part = re.match(r"(?s)\\([ULT])\\(\d)|\\(\d)|.", replacement[i:])
            group = part[2] or part[3]
            if group is None or int(group) > len(match.groups()):
                out += part[0]
            else:
                text = match[int(group)] or ""
                text = {"U": text.upper(), "L": text.lower(), "T": text.title(), None: text}[part[1]]
                out += re.sub("once", text, "once") if "\\" in text else text  # the text is a template again
            i += part.end()
        return out
    try:
        return re.sub(pattern, one, name)
    except re.error:
        return name


@pytest.mark.parametrize("pattern, replacement", [
    (r"(\w+)", r"\U\1"), (r"(\w+)", r"\L\1"), (r"([\w' ]+)", r"\T\1"), (r"(\w+)", r"\U\10"), (r"(a)|(b)", r"\U\1-\2\L\2"),
    (r"(\w)(\w)", r"\2\U\1$\9\\"), (r"\w+", r"\U\0"), (r"(x*)", r"<\U\1>"), (r"(\w+)", r"\T\U\1"),
    (r"(\S+)", r"\L\1"), (r"(\S+) ?(.*)", r"\U\1+\2"), (r"([\\\w]+)", r"<\1\T\1>"), (r"(.+)", r"\U\1"), (r"(\\?.??)", r"\L\1"),
])
def test_case_templates(apply, pattern, replacement):
    names = NAMES + [r"a\nb c", r"tab\t end", r"\x bad", r"one\ two", "end\\", r"\60 \101 \7", r"a\-b", r"\0 z", r"A\NB", r"two\\ of them", "a\\é b"]
    got = apply(lambda n: fn.regex_replace(n, pattern, replacement, preserve_extension=False), names)
    assert got == [cased(n, pattern, replacement) for n in names]


def test_extension_is_kept(apply):
    assert apply(lambda n: fn.regex_replace(n, "plan", "map"), ["plan.plan"]) == ["map.plan"]
    assert apply(lambda n: fn.regex_replace(n, "(open", "x"), ["a(open.md"]) == ["a(open.md"]


def test_random_character_classes(apply):
    rng = random.Random(3)
    for _ in range(25):
        body = "".join(rng.choices([r"\w", r"\s", r"\d", "a-c", "é", r"\]", "[", "&&", "^", "-", r"\W", "~"], k=3))
        pattern = f"[a{body}]+"
        try:
            re.compile(pattern)
        except re.error:
            continue
        got = apply(lambda n: fn.regex_replace(n, pattern, "#", False), NAMES)
        assert got == [re.sub(pattern, "#", n) for n in NAMES], pattern


def test_native_where_possible():
    assert compile_pattern(r"([a-z]+)=(.+)").java is not None
    assert compile_pattern("$").java is not None
    assert compile_pattern(r"(a)?(?(1)b|c)").java is None
    for pattern in ("[0-9]*", "x*", r"\b", "(?=a)", "(a)?(b)?", "(?m)^", ""):
        assert compile_pattern(pattern).java is not None
    for pattern in ("a??", "(?:|a)", "(?:x*|b)"):
        assert compile_pattern(pattern).java is None


def test_validation():
    assert fn.validate_regex(r"\d+") is None
    assert "Invalid regex" in fn.validate_regex("[z-a]")


def test_invalid_pattern_warns(spark):
    with pytest.warns(UserWarning, match="Invalid regex"):
        RegexReplace("[z-a]", "x").apply(F.col("name"))
