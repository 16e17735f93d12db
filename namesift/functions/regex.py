"""User-written Python regular expressions as Spark columns.

Users write patterns and replacement templates in Python's dialect. Both are
checked and rewritten for Spark's built-in regular expressions once, while the
plan is built. A pattern or template Python would reject leaves names as they
are, since Spark would otherwise fail the job at run time. The few patterns
with no Java form go to an Arrow function; the choice depends on the pattern
alone.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import MARK, convert_marked, edit_stem, title_case

try:  # where Python keeps the parser of its patterns differs between versions
    from re import _constants as _c
    from re import _parser
except ImportError:
    import sre_constants as _c
    import sre_parse as _parser

# Python's character categories spelled out for Java (fixed values).
_CATEGORIES = {
    _c.CATEGORY_DIGIT: r"\p{Nd}",
    _c.CATEGORY_SPACE: r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}",
    _c.CATEGORY_WORD: r"\p{L}\p{N}_",
}
_ASCII_CATEGORIES = {
    _c.CATEGORY_DIGIT: "0-9",
    _c.CATEGORY_SPACE: r"\t-\r\x{20}",
    _c.CATEGORY_WORD: "a-zA-Z0-9_",
}
_NEGATED = {
    _c.CATEGORY_NOT_DIGIT: _c.CATEGORY_DIGIT,
    _c.CATEGORY_NOT_SPACE: _c.CATEGORY_SPACE,
    _c.CATEGORY_NOT_WORD: _c.CATEGORY_WORD,
}
_EDGES = {_c.AT_BEGINNING, _c.AT_BEGINNING_STRING, _c.AT_END, _c.AT_END_STRING}
_REPEATS = {_c.MAX_REPEAT: "", _c.MIN_REPEAT: "?", _c.POSSESSIVE_REPEAT: "+"}


class _NoJavaForm(Exception):
    pass


def _char(code: int) -> str:
    char = chr(code)
    return char if char.isascii() and char.isalnum() else f"\\x{{{code:X}}}"


def _category(kind, flags: int) -> str:
    table = _ASCII_CATEGORIES if flags & re.ASCII else _CATEGORIES
    return f"[^{table[_NEGATED[kind]]}]" if kind in _NEGATED else f"[{table[kind]}]"


def _char_class(items, flags: int) -> str:
    negated = items[0][0] is _c.NEGATE
    body = ""
    for kind, value in items[1:] if negated else items:
        if kind is _c.LITERAL:
            body += _char(value)
        elif kind is _c.RANGE:
            body += f"{_char(value[0])}-{_char(value[1])}"
        else:
            body += _category(value, flags)
    return f"[{'^' if negated else ''}{body}]"


def _anchor(kind, flags: int) -> str:
    multiline = flags & re.MULTILINE
    if kind in (_c.AT_BOUNDARY, _c.AT_NON_BOUNDARY):
        w = _category(_c.CATEGORY_WORD, flags)
        if kind is _c.AT_BOUNDARY:
            return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
        # An empty text has no place between two characters of a kind.
        return rf"(?:(?<={w})(?={w})|(?!\A\z)(?<!{w})(?!{w}))"
    if kind is _c.AT_BEGINNING:
        return r"(?:\A|(?<=\n))" if multiline else r"\A"
    if kind is _c.AT_BEGINNING_STRING:
        return r"\A"
    if kind is _c.AT_END:
        return r"(?=\n|\z)" if multiline else r"(?=\n?\z)"
    return r"\z"


def _java(tree, flags: int) -> str:
    """Java text of a parsed pattern."""
    out = ""
    for kind, value in tree:
        if kind is _c.LITERAL:
            out += _char(value)
        elif kind is _c.NOT_LITERAL:
            out += f"[^{_char(value)}]"
        elif kind is _c.ANY:
            out += "(?s:.)" if flags & re.DOTALL else r"[^\n]"
        elif kind is _c.IN:
            out += _char_class(value, flags)
        elif kind is _c.AT:
            out += _anchor(value, flags)
        elif kind is _c.BRANCH:
            out += "(?:" + "|".join(_java(branch, flags) for branch in value[1]) + ")"
        elif kind is _c.SUBPATTERN:
            group, add, drop, body = value
            inner = _java(body, (flags | add) & ~drop)
            if (add | drop) & re.IGNORECASE:
                inner = f"(?{'iu' if add & re.IGNORECASE else '-iu'}:{inner})"
            out += f"({inner})" if group else f"(?:{inner})"
        elif kind in _REPEATS:
            low, high, body = value
            count = f"{{{low},{'' if high is _c.MAXREPEAT else high}}}"
            out += f"(?:{_java(body, flags)}){count}{_REPEATS[kind]}"
        elif kind is _c.ATOMIC_GROUP:
            out += f"(?>{_java(value, flags)})"
        elif kind is _c.GROUPREF:
            out += f"(?:\\{value})"
        elif kind in (_c.ASSERT, _c.ASSERT_NOT):
            direction, body = value
            sign = "=" if kind is _c.ASSERT else "!"
            out += f"(?{'<' if direction < 0 else ''}{sign}{_java(body, flags)})"
        else:
            raise _NoJavaForm(str(kind))
    return out


#: A place between the halves of a character outside the basic plane, where Java
#: looks for empty matches and Python does not. No text has a second half alone.
_WHOLE_CHARACTERS = r"(?![\x{DC00}-\x{DFFF}])"

#: Matches nothing more. Java looks behind by halves of characters, and by whole
#: ones only if the pattern's text has a character outside the basic plane.
_BY_CHARACTERS = "(?:\U00010400){0}"


def _longest_first(tree) -> bool:
    """Whether a pattern that can match empty text does so only where it can't match more.

    After an empty match Python looks for a longer one at the same place, Java
    goes on behind it. Where longer matches are tried first there is none.
    """
    for kind, value in tree:
        if kind is _c.MIN_REPEAT:
            return False
        if kind is _c.BRANCH:
            *others, last = value[1]
            if any(branch.getwidth()[0] == 0 for branch in others) or not all(map(_longest_first, [*others, last])):
                return False
        elif kind is _c.SUBPATTERN:
            if not _longest_first(value[3]):
                return False
        elif kind in _REPEATS:
            if not _longest_first(value[2]):
                return False
        elif kind is _c.ATOMIC_GROUP and not _longest_first(value):
            return False
    return True


@dataclass(frozen=True)
class CompiledPattern:
    """A checked pattern. ``java`` is None where only Python can run it."""

    python: re.Pattern
    java: str | None


def compile_pattern(pattern: str) -> CompiledPattern | None:
    """Check a Python pattern and translate it; None if Python rejects it."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compiled = re.compile(pattern)
            tree = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    empty = tree.getwidth()[0] == 0
    if empty and not _longest_first(tree):
        return CompiledPattern(compiled, None)
    try:
        java = _java(tree, compiled.flags)
    except _NoJavaForm:
        return CompiledPattern(compiled, None)
    if "(?<" in java:
        java += _BY_CHARACTERS
    flags = "(?iu)" if compiled.flags & re.IGNORECASE else ""
    return CompiledPattern(compiled, flags + (f"{_WHOLE_CHARACTERS}(?:{java})" if empty else java))


def validate_regex(pattern: str) -> str | None:
    """Message on what is wrong with a pattern, or None if it is fine."""
    try:
        re.compile(pattern)
    except (re.error, RecursionError, OverflowError) as error:
        return f"Invalid regex pattern: {error}"
    return None


# Escapes Python's templates know (fixed values).
_TEMPLATE_ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}
_TEMPLATE_PART = re.compile(
    r"(?s)\\g<(?P<name>[^>]*)>"
    r"|\\(?P<octal>0[0-7]{0,2}|[0-3][0-7]{2})"
    r"|\\(?P<number>[1-9][0-9]?)"
    r"|\\(?P<escape>.?)"
    r"|(?P<literal>[^\\])"
)


def _escape(text: str) -> str:
    # Digits are escaped too, so that none can extend a group number.
    return re.sub(r"([0-9$\\])", r"\\\1", text)


def java_template(template: str, pattern: re.Pattern) -> str | None:
    """Replacement template for Spark, or None if Python rejects it."""
    out = ""
    for part in _TEMPLATE_PART.finditer(template):
        group, escape = None, part["escape"]
        if part["name"] is not None:
            name = part["name"]
            group = int(name) if name.isascii() and name.isdigit() else pattern.groupindex.get(name, -1)
        elif part["octal"] is not None:
            out += _escape(chr(int(part["octal"], 8)))
        elif part["number"] is not None:
            group = int(part["number"])
        elif part["literal"] is not None:
            out += _escape(part["literal"])
        elif escape in _TEMPLATE_ESCAPES:
            out += _escape(_TEMPLATE_ESCAPES[escape])
        elif not escape or (escape.isascii() and escape.isalpha()):
            return None
        else:
            out += _escape("\\" + escape)
        if group is not None:
            if not 0 <= group <= pattern.groups:
                return None
            out += f"${group}"
    return out


CASE_REFERENCE = re.compile(r"\\[ULT]\\\d+")
_CASE_PART = re.compile(r"(?s)\\(?P<case>[ULT])\\(?P<of>[0-9])|\\(?P<plain>[0-9])|(?P<literal>.)")


def _case_pieces(template: str, groups: int) -> list[tuple[str, str]]:
    """Split a case template into (kind, value); kinds are U, L, T, plain, text.

    References to groups the pattern does not have stay in the text. Only one
    digit counts.
    """
    pieces = []
    for part in _CASE_PART.finditer(template):
        number = part["of"] or part["plain"]
        if number is None or int(number) > groups:
            pieces.append(("text", part[0]))
        else:
            pieces.append((part["case"] or "plain", number))
    return pieces


def _convert_case(span: Column) -> Column:
    # The first character of a span names the conversion.
    kind, text = F.left(span, F.lit(1)), F.substr(span, F.lit(2))
    return F.when(kind == "U", F.upper(text)).when(kind == "L", F.lower(text)).otherwise(title_case(text))


# What a converted group's text may hold where it has backslashes: once inserted it
# is read as a template without groups.
_GOOD_TEXT = r"(?s)\A(?:[^\\]++|\\(?:0|[1-3][0-7]{2}|[abfnrtv\\]|[^a-zA-Z0-9]))*+\z"
_TEXT_PART = r"(?s)\\(?:0[0-7]{0,2}|[1-3][0-7]{2}|.)|[^\\]+"


def _expanded_text(text: Column) -> Column:
    """A group's text with its escapes taken as such; null if one is bad."""

    def part_of(part: Column) -> Column:
        known = F.substr(part, F.lit(2))
        out = F.when(~F.startswith(part, F.lit("\\")), part)
        for letter, char in _TEMPLATE_ESCAPES.items():
            out = out.when(known == letter, F.lit(char))
        return out.when(known.rlike("^[0-9]"), F.chr(F.conv(known, 8, 10).cast("int"))).otherwise(part)

    parts = F.transform(F.regexp_extract_all(text, F.lit(_TEXT_PART), F.lit(0)), part_of)
    return F.when(text.rlike(_GOOD_TEXT), F.array_join(parts, ""))


def _sub_with_case(text: Column, java: str, pieces) -> Column:
    # One replacement writes the groups to convert between marks; converting
    # the marked spans afterwards needs no second matching.
    def template(mark_all: bool) -> str:
        out = ""
        for kind, value in pieces:
            if kind == "text":
                out += _escape(value)
            elif kind == "plain" and not mark_all:
                out += f"${value}"
            else:
                out += f"{MARK}{kind[0]}${value}{MARK}"
        return out

    marked = F.regexp_replace(text, java, template(False))
    plain = F.when(F.contains(marked, F.lit(MARK)), convert_marked(marked, _convert_case)).otherwise(marked)

    def converted(span: Column, i: Column) -> Column:
        cased = F.when(F.startswith(span, F.lit("p")), F.substr(span, F.lit(2))).otherwise(_convert_case(span))
        return F.when(i % 2 == 0, span).otherwise(_expanded_text(cased))

    spans = F.transform(F.split(F.regexp_replace(text, java, template(True)), MARK, -1), converted)
    # A bad escape leaves the name as it is.
    escaped = F.when(F.exists(spans, lambda s: s.isNull()), text).otherwise(F.array_join(spans, ""))
    return F.when(F.contains(text, F.lit("\\")), escaped).otherwise(plain)


def _expand_case(match: re.Match, pieces) -> str:
    convert = {"U": str.upper, "L": str.lower, "T": str.title, "plain": str}

    def text_of(kind: str, value: str) -> str:
        text = convert[kind](match[int(value)] or "")
        return re.sub("x", text, "x") if "\\" in text else text

    return "".join(value if kind == "text" else text_of(kind, value) for kind, value in pieces)


def _substituted(compiled: re.Pattern, replacement, value: str) -> str:
    if isinstance(replacement, str):
        return compiled.sub(replacement, value)
    try:
        return compiled.sub(lambda m: _expand_case(m, replacement), value)
    except (re.error, IndexError):
        return value


def _sub_in_python(text: Column, pattern: re.Pattern, replacement) -> Column:
    source, flags = pattern.pattern, pattern.flags

    @F.pandas_udf("string")
    def substitute(values: pd.Series) -> pd.Series:
        compiled = re.compile(source, flags)
        return values.map(lambda v: _substituted(compiled, replacement, v), na_action="ignore")

    return substitute(text)


def regex_replace(
    name: Column, pattern: str = "", replacement: str = "", preserve_extension: bool = True
) -> Column:
    r"""Replace all matches of a Python pattern in the stem or the whole name.

    The replacement may refer to groups as ``\1``, ``\g<1>`` and ``\g<name>``,
    or change their case: ``\U\1`` upper, ``\L\1`` lower, ``\T\1`` title. In
    templates with case changes, escapes in a group's own text count as such once
    it is inserted, and a bad one leaves the name as it is; a reference that they
    make up is not followed.
    """
    compiled = compile_pattern(pattern)
    if compiled is None:
        return name
    if CASE_REFERENCE.search(replacement):
        pieces = _case_pieces(replacement, compiled.python.groups)

        def edit(text: Column) -> Column:
            if compiled.java is None:
                return _sub_in_python(text, compiled.python, pieces)
            return _sub_with_case(text, compiled.java, pieces)

    else:
        template = java_template(replacement, compiled.python)
        if template is None:
            return name

        def edit(text: Column) -> Column:
            if compiled.java is None:
                return _sub_in_python(text, compiled.python, replacement)
            return F.regexp_replace(text, compiled.java, template)

    return edit_stem(name, edit) if preserve_extension else edit(name)
