"""Find dates inside names or free text and rewrite them in one format.

Each pass is a shape plus one or more readings of it. A reading is a regular
expression that accepts real calendar dates only, leap years included, so no
date has to be parsed row by row: a pass is a few ``regexp_replace`` calls that
stay in generated code. A shape is marked first and read afterwards; a shape
that is no date keeps its text, and the characters it covers are not offered to
a shorter match inside it.

Passes run in a fixed order, each on the text the previous one wrote.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import MARK, edit_stem

DEFAULT_FORMAT = "%Y.%m.%d"

# Python's word characters are letters, numbers and the underscore, in any
# script. Spelling them out keeps combining marks on the non-word side.
WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"

# Every shape holds three digit pairs this close together. Names without them,
# most names, skip all passes.
ANY_SHAPE = r"[0-9]{2}[ ./-]?[0-9]{2}[ ./-]?[0-9]{2}"


@dataclass(frozen=True)
class Shape:
    """One kind of date text: digit groups joined by a separator."""

    groups: tuple[int, ...]
    separator: str
    bounded: bool
    readings: tuple[str, ...]

    @property
    def pattern(self) -> str:
        digits = self.separator.join(f"{DIGIT}{{{n}}}" for n in self.groups)
        # Looking for a digit first is quicker than looking back everywhere.
        return f"(?={DIGIT})(?<!{WORD}){digits}(?!{WORD})" if self.bounded else digits


# The shapes by name (fixed values). Readings name the order of the parts;
# those of one shape exclude each other.
SHAPES: dict[str, Shape] = {
    "space_yyyy_mm_dd": Shape((4, 2, 2), " ", True, ("ymd",)),
    "space_nn_nn_yyyy": Shape((2, 2, 4), " ", True, ("dmy", "mdy_late_day")),
    "space_yy_mm_dd": Shape((2, 2, 2), " ", True, ("short_ymd", "short_mdy")),
    "dot_dd_mm_yyyy": Shape((2, 2, 4), r"\.", True, ("dmy", "mdy_late_day")),
    "iso_date": Shape((4, 2, 2), "-", False, ("ymd",)),
    "dash_dd_mm_yyyy": Shape((2, 2, 4), "-", False, ("mdy", "dmy_late_day")),
    "iso_slash": Shape((4, 2, 2), "/", False, ("ymd",)),
    "slash_dd_mm_yyyy": Shape((2, 2, 4), "/", False, ("mdy", "dmy_late_day")),
    "yyyymmdd": Shape((8,), "", False, ("ymd",)),
    "ddmmyyyy": Shape((8,), "", False, ("ymd",)),
}

SPACED_YEAR_FIRST = ("space_yyyy_mm_dd",)
SPACED_YEAR_LAST = ("space_nn_nn_yyyy",)
SPACED_SHORT_YEAR = ("space_yy_mm_dd",)
DOTTED = ("dot_dd_mm_yyyy",)
COMMON = ("iso_date", "dash_dd_mm_yyyy", "iso_slash", "slash_dd_mm_yyyy", "yyyymmdd", "ddmmyyyy")
ALL_PASSES = SPACED_YEAR_FIRST + SPACED_YEAR_LAST + SPACED_SHORT_YEAR + DOTTED + COMMON

# Calendar parts. "late" days are those above 12, which cannot be months.
_MONTH = "(?:0[1-9]|1[0-2])"
_EARLY = "(?:0[1-9]|1[0-2])"
_LATE_IN_ANY = "(?:1[3-9]|2[0-8])"
_YEAR = "(?!0000)[0-9]{4}"
_LEAP_PAIR = "(?:0[48]|[2468][048]|[13579][26])"
_LEAP_YEAR = f"(?:[0-9]{{2}}{_LEAP_PAIR}|(?:{_LEAP_PAIR})00)"
_LEAP_SHORT = f"(?:00|{_LEAP_PAIR})"
_ABOVE_12 = "(?:1[3-9]|[2-9][0-9])"


def _calendar(order: str, sep: str, year: str, leap: str, day_kinds=("early", "late")) -> str:
    """Alternation of all real dates whose parts come in ``order``."""

    def row(year_: str, month: str, day: str) -> str:
        return sep.join({"y": year_, "m": month, "d": day}[part] for part in order)

    rows = []
    if "early" in day_kinds:
        rows.append(row(year, _MONTH, _EARLY))
    if "late" in day_kinds:
        rows += [
            row(year, _MONTH, _LATE_IN_ANY),
            row(year, "(?:0[13-9]|1[0-2])", "(?:29|30)"),
            row(year, "(?:0[13578]|1[02])", "31"),
            row(leap, "02", "29"),
        ]
    return "(?:" + "|".join(rows) + ")"


def _reading(name: str, sep: str) -> tuple[str, str]:
    """The regular expression a reading accepts, and the order of its parts."""
    if name == "ymd":
        return _calendar("ymd", sep, _YEAR, _LEAP_YEAR), "ymd"
    if name in ("dmy", "mdy"):
        return _calendar(name, sep, _YEAR, _LEAP_YEAR), name
    if name in ("dmy_late_day", "mdy_late_day"):
        order = name[:3]
        return _calendar(order, sep, _YEAR, _LEAP_YEAR, ("late",)), order
    if name == "short_ymd":
        # A last number above 12 makes this reading certain only if the first
        # number cannot be a month.
        certain = f"(?={_ABOVE_12})" + _calendar("ymd", sep, "[0-9]{2}", _LEAP_SHORT)
        early = _calendar("ymd", sep, "[0-9]{2}", _LEAP_SHORT, ("early",))
        return f"(?:{certain}|{early})", "ymd"
    # Month first is for what year first could not read.
    return _calendar("mdy", sep, "[0-9]{2}", _LEAP_SHORT), "mdy"


def _capture(order: str, sep: str, year_digits: int) -> tuple[str, dict[str, str]]:
    """Capture groups for the parts, and the group reference that holds each."""
    parts = []
    for part in order:
        if part == "y" and year_digits == 4:
            parts.append("century")
        parts.append(part)
    groups = sep.join(
        "([0-9]{2})([0-9]{2})" if part == "y" and year_digits == 4 else "([0-9]{2})"
        for part in order
    )
    return groups, {part: f"${i}" for i, part in enumerate(parts, start=1)}


def _iso_week_year(date: Column) -> Column:
    # The week belongs to the year its Thursday lies in.
    return F.date_format(F.date_add(date, 3 - F.weekday(date)), "yyyy")


# strftime directives by how their value comes about (fixed values): copied
# from the matched digits, constant as a date has no time of day, short for
# others, or computed from the date.
_COPIED = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd"}
_MIDNIGHT = {
    "H": "00", "M": "00", "S": "00", "I": "12", "p": "AM", "f": "000000", "z": "", "Z": "",
    "k": " 0", "l": "12", "P": "am",
}
_SHORTHAND = {
    "F": "%Y-%m-%d",
    "D": "%m/%d/%y",
    "x": "%m/%d/%y",
    "T": "%H:%M:%S",
    "X": "%H:%M:%S",
    "R": "%H:%M",
    "c": "%a %b %e %H:%M:%S %Y",
    "n": "\n",
    "t": "\t",
    "%": "%",
}
_FLAGS = "-_0^"


def _week(first_day):
    """Weeks of the year so far, for the days since the last first day of a week."""

    def number(date: Column) -> Column:
        return F.lpad(F.floor((F.dayofyear(date) + 6 - first_day(date)) / 7).cast("string"), 2, "0")

    return number


_COMPUTED = {
    "U": _week(lambda date: F.dayofweek(date) - 1),
    "W": _week(F.weekday),
    "C": lambda date: F.substring(F.date_format(date, "yyyy"), 1, 2),
    "g": lambda date: F.substring(_iso_week_year(date), 3, 2),
    "s": lambda date: (F.unix_date(date).cast("bigint") * 86_400).cast("string"),
    "b": lambda date: F.date_format(date, "MMM"),
    "h": lambda date: F.date_format(date, "MMM"),
    "B": lambda date: F.date_format(date, "MMMM"),
    "a": lambda date: F.date_format(date, "EEE"),
    "A": lambda date: F.date_format(date, "EEEE"),
    "j": lambda date: F.date_format(date, "DDD"),
    "e": lambda date: F.lpad(F.dayofmonth(date).cast("string"), 2, " "),
    "u": lambda date: (F.weekday(date) + 1).cast("string"),
    "w": lambda date: (F.dayofweek(date) - 1).cast("string"),
    "V": lambda date: F.lpad(F.weekofyear(date).cast("string"), 2, "0"),
    "G": _iso_week_year,
}


def _format_pieces(fmt: str) -> list[tuple[str, str]]:
    """Split a strftime format into ("text", literal) and ("part", letter).

    A flag stands before its letter: ``-`` for no padding, ``_`` for blanks,
    ``0`` for zeros, ``^`` for capitals. What is no directive stays as it is.
    """
    pieces: list[tuple[str, str]] = []
    for flag, letter, literal in re.findall(rf"(?s)%([{_FLAGS}]?)(.)|(.)", fmt):
        if literal:
            pieces.append(("text", literal))
        elif letter in ("n", "t", "%"):
            pieces.append(("text", _SHORTHAND[letter]))
        elif letter in _SHORTHAND:
            pieces += _format_pieces(_SHORTHAND[letter])
        elif letter in _MIDNIGHT:
            pieces.append(("text", _flagged_text(_MIDNIGHT[letter], flag)))
        elif letter in _COPIED or letter in _COMPUTED:
            pieces.append(("part", flag + letter))
        else:
            pieces.append(("text", f"%{flag}{letter}"))
    return pieces


def _flagged_text(text: str, flag: str) -> str:
    bare = text.lstrip("0 ") or text[-1:]
    if flag == "^":
        return text.upper()
    return text if not flag or not bare.isdigit() else bare if flag == "-" else bare.rjust(len(text), " " if flag == "_" else "0")


def _flagged(value: Column, flag: str) -> Column:
    if flag == "^":
        return F.upper(value)
    if not flag:
        return value
    bare = F.regexp_replace(value, r"^[0 ]+(?=[0-9])", "")
    if flag == "-":
        return bare
    padded = F.lpad(bare, F.length(value), F.lit(" " if flag == "_" else "0"))
    return F.when(F.rlike(value, F.lit("^[0-9 ]+$")), padded).otherwise(value)


def _century(holds: dict[str, str]) -> str:
    # Two-digit years always belong to this century.
    return holds.get("century", r"\2\0")


def _template(pieces, holds: dict[str, str]) -> str:
    """Replacement text that writes the captured date in the format."""
    values = {**holds, "Y": _century(holds) + holds["y"]}
    # Escaped, so that a digit cannot extend the number of a group reference.
    return "".join(
        values[value] if kind == "part" else re.sub(r"([0-9$\\])", r"\\\1", value)
        for kind, value in pieces
    )


def _rewrite_by_template(text: Column, shape: Shape, pieces) -> Column:
    """Marks in, readings applied, leftover marks out. Doubled marks are text."""
    out = F.regexp_replace(text, shape.pattern, f"{MARK}$0")
    for name in shape.readings:
        accepted, order = _reading(name, shape.separator)
        capture, holds = _capture(order, shape.separator, 2 if name.startswith("short") else 4)
        end = f"(?!{WORD})" if shape.bounded else ""
        out = F.regexp_replace(out, f"{MARK}(?={accepted}{end}){capture}", _template(pieces, holds))
    return F.regexp_replace(out, f"{MARK}({MARK}?)", "$1$1")


def _format_date(date: Column, pieces) -> Column:
    def piece(kind: str, value: str) -> Column:
        if kind == "text":
            return F.lit(value)
        flag, letter = value[:-1], value[-1]
        plain = F.date_format(date, _COPIED[letter]) if letter in _COPIED else _COMPUTED[letter](date)
        return _flagged(plain, flag)

    return F.concat(*[piece(kind, value) for kind, value in pieces])


def _rewrite_by_date(text: Column, shape: Shape, pieces) -> Column:
    """For formats with names of months or days: build the date per match."""

    def convert(match: Column) -> Column:
        out = match
        for name in reversed(shape.readings):
            accepted, order = _reading(name, shape.separator)
            capture, holds = _capture(order, shape.separator, 2 if name.startswith("short") else 4)
            iso = f"{_century(holds)}{holds['y']}-{holds['m']}-{holds['d']}"
            date = F.try_to_date(F.regexp_replace(match, f"^{capture}$", iso), "yyyy-MM-dd")
            out = F.when(F.rlike(match, F.lit(f"^{accepted}$")), _format_date(date, pieces)).otherwise(out)
        return out

    found = F.transform(F.regexp_extract_all(text, F.lit(shape.pattern), F.lit(0)), convert)
    gaps = F.split(text, shape.pattern, -1)
    return F.array_join(
        F.zip_with(gaps, found, lambda gap, date: F.concat(gap, F.coalesce(date, F.lit("")))), ""
    )


def _run_pass(text: Column, shape: Shape, rewrite) -> Column:
    """Rewrite texts that hold the shape, pass others on untouched.

    The test and the rewrite both read the text. Binding it to a lambda
    variable computes it once and keeps a chain of passes linear in size; a
    skipped rewrite saves more time than generated code would.
    """

    def guarded(bound: Column) -> Column:
        holds = F.rlike(bound, F.lit(shape.pattern))
        if shape.separator:
            holds = F.contains(bound, F.lit(shape.separator[-1])) & holds
        return F.when(holds, rewrite(bound)).otherwise(bound)

    return F.element_at(F.transform(F.array(text), guarded), 1)


def rewrite_dates(text: Column, fmt: str = DEFAULT_FORMAT, passes=ALL_PASSES) -> Column:
    """Run the named passes, in the order given, over whole texts."""
    pieces = _format_pieces(fmt)
    copied = all(kind == "text" or value in _COPIED for kind, value in pieces)
    # Marks already in the text are doubled so that they survive.
    out = F.replace(text, F.lit(MARK), F.lit(MARK * 2)) if copied else text
    rewrite = _rewrite_by_template if copied else _rewrite_by_date
    for key in passes:
        out = _run_pass(out, SHAPES[key], lambda bound, shape=SHAPES[key]: rewrite(bound, shape, pieces))
    if copied:
        out = F.replace(out, F.lit(MARK * 2), F.lit(MARK))
    return F.when(F.rlike(text, F.lit(ANY_SHAPE)), out).otherwise(text)


def standardize_dates(name: Column, fmt: str = DEFAULT_FORMAT, scope: str = "name") -> Column:
    """Rewrite all recognized dates.

    ``scope="name"`` edits the stem of a file name, ``scope="text"`` a whole
    free text, in which slashed dates can occur.
    """
    if scope == "text":
        return rewrite_dates(name, fmt)
    return edit_stem(name, lambda text: rewrite_dates(text, fmt))
