"""Predicates on single text lines."""

from __future__ import annotations

from pyspark.sql import Column

from scriptorium.functions.text import regex

# Lines carrying one of these are legal notices, publisher names or links.
IRRELEVANT_PATTERNS = [
    r"full terms",
    r"conditions of (access|use)",
    r"copyright",
    r"all rights reserved",
    r"Taylor & Francis",
    r"elsevier",
    r"springer",
    r"john wiley",
    r"https?://",
    r"terms and conditions",
]
# Lines matching one of these are page headers or footers.
HEADER_FOOTER_PATTERNS = [
    r"full terms",
    r"conditions of (access|use)",
    r"copyright",
    r"^page \d+",
    r"^issn",
    r"^doi:",
    r"^\d+$",
    r"all rights reserved",
]


def _any_of(patterns: list[str]) -> str:
    return regex("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def is_irrelevant(c: Column) -> Column:
    return c.rlike(_any_of(IRRELEVANT_PATTERNS))


def is_header_footer(c: Column) -> Column:
    return c.rlike(_any_of(HEADER_FOOTER_PATTERNS))
