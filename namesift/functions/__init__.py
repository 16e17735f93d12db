"""Column functions: each takes and returns Columns."""

from .dates import SHAPES, rewrite_dates, standardize_dates
from .names import base_name, canonical_path, extension, replace_string, stem, title_case, to_camel_case
from .regex import regex_replace, validate_regex
from .scores import (
    confidence,
    format_percent,
    format_size,
    match_reasons,
    name_similarity,
    sequence_ratio,
    size_similarity,
    tfidf_similarity,
)
from .tokens import term_counts, tokenize

__all__ = [
    "SHAPES",
    "base_name",
    "canonical_path",
    "confidence",
    "extension",
    "format_percent",
    "format_size",
    "match_reasons",
    "name_similarity",
    "regex_replace",
    "replace_string",
    "rewrite_dates",
    "sequence_ratio",
    "size_similarity",
    "standardize_dates",
    "stem",
    "term_counts",
    "tfidf_similarity",
    "title_case",
    "to_camel_case",
    "tokenize",
    "validate_regex",
]
