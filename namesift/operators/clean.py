"""Ordered chains of name operations."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DEFAULT_FORMAT, standardize_dates
from ..functions.names import replace_string, to_camel_case
from ..functions.regex import regex_replace, validate_regex


@dataclass(frozen=True)
class ReplaceString:
    source: str = "."
    replacement: str = "_"

    def apply(self, name: Column) -> Column:
        return replace_string(name, self.source, self.replacement)


@dataclass(frozen=True)
class CamelCase:
    upper_first: bool = False

    def apply(self, name: Column) -> Column:
        return to_camel_case(name, self.upper_first)


@dataclass(frozen=True)
class RegexReplace:
    pattern: str = ""
    replacement: str = ""
    preserve_extension: bool = True

    def apply(self, name: Column) -> Column:
        problem = validate_regex(self.pattern)
        if problem:
            warnings.warn(problem, stacklevel=2)
        return regex_replace(name, self.pattern, self.replacement, self.preserve_extension)


@dataclass(frozen=True)
class StandardizeDates:
    format: str = DEFAULT_FORMAT

    def apply(self, name: Column) -> Column:
        return standardize_dates(name, self.format)


OPERATION_TYPES = {
    "replace_string": ReplaceString,
    "camel_case": CamelCase,
    "regex": RegexReplace,
    "standardize_dates": StandardizeDates,
}


def parse_operations(operations: Iterable) -> list:
    """Operations from objects or from dicts with a ``type`` and parameters.

    Dicts of an unknown type, and parameters an operation does not have, are
    ignored.
    """
    parsed = []
    for operation in operations:
        if not isinstance(operation, Mapping):
            parsed.append(operation)
            continue
        kind = OPERATION_TYPES.get(operation.get("type"))
        if kind is not None:
            known = {k: v for k, v in operation.items() if k in kind.__dataclass_fields__}
            parsed.append(kind(**known))
    return parsed


def replace_pairs(pairs: Iterable[tuple[str, str]]) -> list[ReplaceString]:
    """Operations for (source, replacement) pairs, empty sources left out."""
    return [ReplaceString(source, replacement) for source, replacement in pairs if source]


def clean_names(files: DataFrame, operations: Iterable, column: str = "name", into: str = "new_name") -> DataFrame:
    """Apply operations in order to a name column; the result is ``into``.

    Each operation reads its input several times, and so would whatever uses
    the result, if the optimizer nested the expressions. Passing each result on
    through a one-element array keeps it computed once; all operations still
    run in one stage of generated code.
    """
    rows = files.withColumn(into, F.col(column))
    others = [c for c in files.columns if c != into]
    for operation in parse_operations(operations):
        once = F.explode(F.array(operation.apply(F.col(into)))).alias(into)
        rows = rows.select(*others, once)
    return rows
