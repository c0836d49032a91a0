"""Scores of catalogue records against a document's title and authors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.similarity import (
    any_name_contains,
    any_surname_within,
    author_similarity,
    sequence_ratio,
    string_similarity,
)
from scriptorium.schema import present

# Options order of the services; earlier ones win ties.
SOURCE_ORDER = ["crossref", "openlib", "k10plus", "googlebooks", "openalex"]
TITLE_POINTS = 50.0
AUTHOR_POINTS = 30.0
# Five points each for these fields of a search candidate.
CANDIDATE_BONUS = {
    "crossref": ["year", "journal", "publisher", "doi"],
    "openalex": ["year", "journal", "doi", "cited_by_count"],
    "googlebooks": ["year", "publisher", "isbn", "keywords"],
    "openlib": ["year", "publisher", "isbn", "keywords"],
}
# Points for the fields of found metadata.
METADATA_BONUS = {
    "crossref": {"year": 4, "journal": 4, "publisher": 3, "doi": 5, "issn": 4},
    "openalex": {"year": 4, "journal": 4, "publisher": 3, "doi": 5, "keywords": 4},
    "googlebooks": {"year": 4, "publisher": 3, "isbn": 5, "page_count": 3, "keywords": 5},
    "openlib": {"year": 4, "publisher": 3, "isbn": 5, "page_count": 3, "keywords": 5},
    "k10plus": {"year": 4, "publisher": 3, "isbn": 5, "page_count": 3, "language": 5},
}

Field = Callable[[str], Column]
SIMILARITIES = {"levenshtein": string_similarity, "ratio": sequence_ratio}


def source_position(source: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SOURCE_ORDER]), source).cast("int")


def _by_source(source: Column, build: Callable[[str], Column]) -> Column:
    chosen = F.lit(None).cast("double")
    for name in SOURCE_ORDER:
        chosen = F.when(source == name, build(name)).otherwise(chosen)
    return chosen


def _points(record: Field, weights: dict[str, int]) -> Column:
    total = F.lit(0.0)
    for name, points in weights.items():
        total = total + F.when(present(name, record(name)), float(points)).otherwise(0.0)
    return total


def metadata_bonus(source: Column, record: Field) -> Column:
    return _by_source(source, lambda s: _points(record, METADATA_BONUS[s]))


def candidate_bonus(source: Column, record: Field) -> Column:
    """Bonus of a search candidate; the union catalogue scores candidates like metadata."""
    return _by_source(
        source,
        lambda s: _points(
            record, METADATA_BONUS[s] if s == "k10plus" else dict.fromkeys(CANDIDATE_BONUS[s], 5)
        ),
    )


def title_points(found: Column, original: Column, similarity: str = "levenshtein") -> Column:
    return SIMILARITIES[similarity](original, found) * TITLE_POINTS


def most_title_points(x: Column, y: Column, similarity: str = "levenshtein") -> Column:
    """The most points that two titles of ``x`` and ``y`` characters can get."""
    alike = {"levenshtein": F.least(x, y) / F.greatest(x, y), "ratio": F.lit(2.0) * F.least(x, y) / (x + y)}
    return alike[similarity] * TITLE_POINTS


def candidate_author_points(source: Column, found: Column, original: Column) -> Column:
    """All or nothing by name match; the union catalogue grades by similarity."""

    def rule(name: str) -> Column:
        if name == "k10plus":
            return author_similarity(found, original) * AUTHOR_POINTS
        matches = any_surname_within if name == "crossref" else any_name_contains
        return F.when(matches(found, original), AUTHOR_POINTS).otherwise(0.0)

    known = (F.size(found) > 0) & (F.size(original) > 0)
    return F.when(F.coalesce(known, F.lit(False)), _by_source(source, rule)).otherwise(0.0)


def candidate_score(
    source: Column, record: Field, title: Column, author: Column, similarity: str = "levenshtein"
) -> Column:
    return (
        title_points(record("title"), title, similarity)
        + candidate_author_points(source, record("author"), author)
        + candidate_bonus(source, record)
    )


def metadata_score(
    source: Column, record: Field, title: Column, author: Column, similarity: str = "levenshtein"
) -> Column:
    known = F.coalesce((F.size(record("author")) > 0) & (F.size(author) > 0), F.lit(False))
    graded = F.when(known, author_similarity(record("author"), author) * AUTHOR_POINTS).otherwise(0.0)
    return title_points(record("title"), title, similarity) + graded + metadata_bonus(source, record)
