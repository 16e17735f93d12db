import random
import re
from datetime import datetime

import pytest

from namesift import functions as fn

try:
    from dateutil import parser as date_parser
except ImportError:
    date_parser = None

UNCHANGED = None
# One name for each shape, reading and way to stay as it is.
CASES = [
    ("scan 2019 07 04 b.png", "scan 2019.07.04 b.png"),
    ("scan 2019 02 30.png", UNCHANGED),
    ("tour 24 12 1998.gpx", "tour 1998.12.24.gpx"),
    ("tour 12 24 1998.gpx", "tour 1998.12.24.gpx"),
    ("tour 07 03 1998.gpx", "tour 1998.03.07.gpx"),
    ("memo 17 08 30.odt", "memo 2017.08.30.odt"),
    ("memo 88 02 29.odt", "memo 2088.02.29.odt"),
    ("memo 07 29 14.odt", "memo 2014.07.29.odt"),
    ("memo 04 05 06.odt", "memo 2004.05.06.odt"),
    ("memo 09 30 08.odt", "memo 2008.09.30.odt"),
    ("bill 19.11.2003.ods", "bill 2003.11.19.ods"),
    ("bill 08.09.2003.ods", "bill 2003.09.08.ods"),
    ("bill 19.11.2003", UNCHANGED),
    ("dump 1984-10-26.sql", "dump 1984.10.26.sql"),
    ("dump_1984-10-26_x.sql", "dump_1984.10.26_x.sql"),
    ("dump 1984-26-10.sql", UNCHANGED),
    ("dump 03-08-1984.sql", "dump 1984.03.08.sql"),
    ("dump 26-10-1984.sql", "dump 1984.10.26.sql"),
    ("cam20160229.jpg", "cam2016.02.29.jpg"),
    ("cam201602291830.jpg", "cam2016.02.291830.jpg"),
    ("cam29022016.jpg", UNCHANGED),
    ("part_2019 07 04_2.doc", UNCHANGED),
    ("16 06 1904 05 07.txt", "1904.06.16.05.07.txt"),
    ("1999 14 02 08.txt", "1999 2014.02.08.txt"),
    ("year 0000-03-04 0000 03 04.txt", UNCHANGED),
    ("leap 1900-02-29 1996-02-29.txt", "leap 1900-02-29 1996.02.29.txt"),
    ("plain name", UNCHANGED),
]


def test_fixed_cases(apply):
    got = apply(fn.standardize_dates, [c[0] for c in CASES])
    assert got == [c[1] or c[0] for c in CASES]


def test_day_first_output_is_read_again(apply):
    names = ["n 2010 05 09.md", "n 2010-05-09.md", "n 09.05.2010.md", "n 20100509.md", "n 2010 05 23.md"]
    got = apply(lambda n: fn.standardize_dates(n, "%d-%m-%Y"), names)
    assert got == ["n 05-09-2010.md"] * 3 + ["n 09-05-2010.md", "n 23-05-2010.md"]


def test_slashes_in_text(apply):
    text = "from 2011/10/09, 28/02/2013\x00 to \x002014-12-24\x00\x00"
    expected = "from 2011.10.09, 2013.02.28\x00 to \x002014.12.24\x00\x00"
    assert apply(lambda t: fn.standardize_dates(t, scope="text"), [text]) == [expected]


def test_several_dates(apply):
    names = ["from 2001 09 08 to 17.03.2002.tar", "v3 30 06 1990 (was 29-06-1990) 19900701.pdf"]
    got = apply(lambda n: fn.standardize_dates(n, "%Y-%m-%d"), names)
    assert got == ["from 2001-09-08 to 2002-03-17.tar", "v3 1990-06-30 (was 1990-06-29) 1990-07-01.pdf"]


def test_every_directive(apply):
    days = [datetime(y, m, d) for y, m, d in [(2024, 1, 1), (2024, 12, 30), (2021, 1, 3), (2023, 1, 1), (2020, 2, 29), (2017, 7, 9), (1999, 10, 10)]]
    letters = "aAbBcCdDeFgGhHIjklmMnpPrRStTuUVwWxXyY%"
    for fmt in [f"%{x}" for x in letters if x != "r"] + ["%-d.%-m.%-y", "%_d|%_j|%_H", "%0e %-j %-H %^a %^B %-e"]:
        got = apply(lambda t: fn.standardize_dates(t, fmt, scope="text"), [f"<{d:%Y-%m-%d}>" for d in days])
        assert got == [f"<{d.strftime(fmt)}>" for d in days], fmt


def test_unknown_directives_stay(apply):
    assert apply(lambda t: fn.standardize_dates(t, "%Q%Y%", scope="text"), ["2011-05-06"]) == ["%Q2011%"]
    assert apply(lambda t: fn.standardize_dates(t, "%s", scope="text"), ["1970-01-02"]) == ["86400"]


# The readings of each layout: the first whose condition holds, tried in its orders.
# ``a``, ``b`` and ``c`` are the numbers in a match, two digits mean 20xx.

ALWAYS = "True"
LAYOUTS = [
    ("w4 2 2", [(ALWAYS, "ymd")]),
    ("w2 2 4", [(ALWAYS, "dmy mdy")]),
    ("w2 2 2", [("a > 12", "ymd"), ("c > 12", "mdy"), (ALWAYS, "ymd mdy")]),
    ("w2.2.4", [(ALWAYS, "dmy mdy")]),
    ("4-2-2", [(ALWAYS, "ymd")]),
    ("2-2-4", [(ALWAYS, "mdy dmy")]),
    ("4/2/2", [(ALWAYS, "ymd")]),
    ("2/2/4", [(ALWAYS, "mdy dmy")]),
    ("422", [(ALWAYS, "ymd")]),
    ("422", [(ALWAYS, "ymd")]),
]


def pattern_of(layout):
    inner = "".join(rf"(\d{{{c}}})" if c.isdigit() else re.escape(c) for c in layout.removeprefix("w"))
    return rf"\b{inner}\b" if layout.startswith("w") else inner


def reading(numbers, readings):
    """The date, or None, that three numbers mean."""
    names = dict(zip("abc", map(int, numbers), strict=True))
    orders = next(o for condition, o in readings if eval(condition, {}, names))
    for order in orders.split():
        part = dict(zip(order, numbers, strict=True))
        try:
            return datetime.strptime("-".join((part["y"].rjust(4, "0") if len(part["y"]) == 4 else "20" + part["y"], part["m"], part["d"])), "%Y-%m-%d")
        except ValueError:
            continue
    return None


def standardized(text, fmt):
    for layout, readings in LAYOUTS:
        def written(match, readings=readings):
            date = reading(match.groups(), readings)
            return match[0] if date is None else date.strftime(fmt.replace("%Y", f"{date.year:04}"))

        text = re.sub(pattern_of(layout), written, text)
    return text


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(11)
    pieces = ["2025", "2024", "1999", "01", "02", "12", "13", "29", "30", "31", "00", "25", "20250131", "5", "x", "é", "_", "99"]
    texts = []
    for _ in range(4000):
        sep = rng.choice([" ", ".", "-", "/", "", " "])
        texts.append("".join(rng.choice(pieces) + (sep if rng.random() < 0.9 else rng.choice(" .-_")) for _ in range(rng.randint(2, 8))))
    return texts


@pytest.mark.parametrize("fmt", ["%Y.%m.%d", "%d-%m-%Y", "%Y%m%d", "%m %d %y", "%d %b %Y", "%Y/%j 7%%$1\\"])
def test_random_texts(apply, random_texts, fmt):
    got = apply(lambda t: fn.standardize_dates(t, fmt, scope="text"), random_texts)
    for text, result in zip(random_texts, got):
        assert result == standardized(text, fmt), text


@pytest.mark.skipif(date_parser is None, reason="needs dateutil")
def test_dash_rule_agrees_with_dateutil():
    for a in range(0, 33, 3):
        for b in range(0, 33):
            try:
                expected = date_parser.parse(f"{a:02}-{b:02}-2024", fuzzy=False)
            except ValueError:
                expected = None
            assert reading((f"{a:02}", f"{b:02}", "2024"), dict(LAYOUTS)["2-2-4"]) == expected


def test_shape_catalog():
    assert len(fn.SHAPES) == 10
    assert all(isinstance(shape.pattern, str) for shape in fn.SHAPES.values())
