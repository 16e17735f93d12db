"""Column functions over file names: splitting, literal replacement, casing.

Every function takes and returns Columns made of built-in expressions, so a
projection over an inventory stays in one stage with no shuffle and no Python
worker. A null name gives a null result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A file name can hold any character but "/" and NUL, so NUL is a safe mark
# inside names.
MARK = "\x00"

# Characters after which the next letter is capitalized (fixed values).
CASE_SEPARATORS = "_-. "

# Letters that have case, as Java regular expression properties.
CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"


def base_name(path: Column) -> Column:
    """Last component of a path; a plain file name comes back unchanged."""
    last = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return F.when(F.contains(path, F.lit("/")), last).otherwise(path)


def canonical_path(path: Column) -> Column:
    """A path without empty and ``.`` components, and with ``..`` taken back, as far as the text alone tells."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    absolute = F.startswith(path, F.lit("/"))
    none = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = (F.size(kept) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), kept), -1) != "..")
        return (
            F.when(part != "..", F.concat(kept, F.array(part)))
            .when(up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(absolute, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    kept = F.array_join(F.aggregate(parts, none, step), "/")
    taken_apart = F.when(absolute, F.concat(F.lit("/"), kept)).when((kept == "") & (path != ""), F.lit(".")).otherwise(kept)
    # Without these there is nothing to leave out.
    unclear = F.contains(path, F.lit("//")) | F.contains(path, F.lit("/.")) | F.endswith(path, F.lit("/")) | F.startswith(path, F.lit("."))
    return F.when(~unclear, path).otherwise(taken_apart)


def _extension_of(base: Column) -> Column:
    # The tail after the last dot makes an extension only if something
    # precedes the dot and something follows it.
    tail = F.substring_index(base, ".", -1)
    before = F.octet_length(base) - F.octet_length(tail)
    return F.when((before > 1) & (F.octet_length(tail) > 0), F.concat(F.lit("."), tail)).when(
        base.isNotNull(), F.lit("")
    )


def extension(name: Column) -> Column:
    """Extension with its dot, or an empty string."""
    return _extension_of(base_name(name))


def stem(name: Column) -> Column:
    """Name without its extension."""
    base = base_name(name)
    return F.left(base, F.length(base) - F.length(_extension_of(base)))


def edit_stem(name: Column, edit) -> Column:
    """Apply ``edit`` to the stem and put the extension back."""
    return F.concat(edit(stem(name)), extension(name))


def _replace_literal(text: Column, source: str, replacement: str) -> Column:
    if source:
        return F.replace(text, F.lit(source), F.lit(replacement))
    # An empty source matches between all characters and at both ends.
    spread = F.array_join(F.split(text, ""), replacement)
    return F.when(F.length(text) == 0, F.lit(replacement)).otherwise(
        F.concat(F.lit(replacement), spread, F.lit(replacement))
    )


def replace_string(name: Column, source: str = ".", replacement: str = "_") -> Column:
    """Replace every occurrence of a literal in the stem."""
    return edit_stem(name, lambda text: _replace_literal(text, source, replacement))


def convert_marked(marked: Column, convert) -> Column:
    """Rewrite the spans between pairs of marks and drop the marks.

    After splitting at the mark the spans sit at the odd positions.
    """
    return F.array_join(
        F.transform(
            F.split(marked, MARK, -1),
            lambda part, i: F.when(i % 2 == 1, convert(part)).otherwise(part),
        ),
        "",
    )


def _capitalize_after_separators(text: Column, upper_first: bool) -> Column:
    # Single characters are lowered one by one, so a capital sigma never takes
    # its word-final form.
    lowered = F.lower(F.translate(text, "Σ", "σ"))
    gap = r"[_\-. ]\P{L}*"
    start = rf"(^\P{{L}}*|{gap})" if upper_first else f"({gap})"
    marked = F.regexp_replace(lowered, start + r"(\p{L})", f"$1{MARK}$2{MARK}")
    return convert_marked(marked, F.upper)


def to_camel_case(name: Column, upper_first: bool = False) -> Column:
    """Capitalize the first letter after each separator, lower all others.

    Separators are kept. With ``upper_first`` the first letter of the name is
    capitalized as well (Pascal case).
    """
    return edit_stem(name, lambda text: _capitalize_after_separators(text, upper_first))


def title_case(text: Column) -> Column:
    """Capitalize every letter that does not follow another letter."""
    # initcap starts words at spaces only, so a marked space goes in front of
    # every run of cased letters and comes out again afterwards.
    gap = MARK + " "
    spaced = F.regexp_replace(text, f"(?<!{CASED})(?={CASED})", gap)
    return F.replace(F.initcap(spaced), F.lit(gap), F.lit(""))
