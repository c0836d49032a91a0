"""Named queries over the supplied tables and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "library_queries",
    "search_queries",
    "text_queries",
    "catalogue_queries",
    "chunk_queries",
    "source_queries",
]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
