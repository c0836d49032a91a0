"""Catalogue records of five services brought to one shape.

Each ``from_*`` function takes rows read with the schema of its service and returns the columns of
``RECORD_FIELDS`` beside the columns named in ``keep``. Missing fields are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.extract import let
from scriptorium.functions.text import search_regex, strip
from scriptorium.schema import FIELD_TYPES, RECORD_FIELDS, has_text, null_if_empty

CROSSREF = (
    "title ARRAY<STRING>, author ARRAY<STRUCT<given: STRING, family: STRING>>, `container-title` ARRAY<STRING>, "
    "published STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, publisher STRING, DOI STRING, ISSN ARRAY<STRING>, "
    "type STRING, abstract STRING"
)
OPENALEX = (
    "title STRING, doi STRING, authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, "
    "publication_year INT, primary_location STRUCT<source: STRUCT<display_name: STRING, issn_l: STRING, "
    "host_organization: STRUCT<display_name: STRING>>>, cited_by_count BIGINT, "
    "concepts ARRAY<STRUCT<display_name: STRING>>, open_access STRUCT<is_oa: BOOLEAN>, type STRING, "
    "abstract_inverted_index MAP<STRING, ARRAY<INT>>"
)
GOOGLEBOOKS = (
    "volumeInfo STRUCT<title: STRING, subtitle: STRING, authors: ARRAY<STRING>, publishedDate: STRING, "
    "publisher: STRING, industryIdentifiers: ARRAY<STRUCT<type: STRING, identifier: STRING>>, pageCount: BIGINT, "
    "language: STRING, categories: ARRAY<STRING>, description: STRING>"
)
OPENLIB = (
    "title STRING, author_name ARRAY<STRING>, first_publish_year INT, publish_year ARRAY<INT>, "
    "publisher ARRAY<STRING>, isbn ARRAY<STRING>, language ARRAY<STRING>, number_of_pages_median BIGINT, "
    "subject ARRAY<STRING>"
)
MARC = (
    "controlfield ARRAY<STRUCT<_tag: STRING, _VALUE: STRING>>, "
    "datafield ARRAY<STRUCT<_tag: STRING, subfield: ARRAY<STRUCT<_code: STRING, _VALUE: STRING>>>>"
)
SCHEMAS = {"crossref": CROSSREF, "openalex": OPENALEX, "googlebooks": GOOGLEBOOKS, "openlib": OPENLIB, "k10plus": MARC}

# Usual list caps (the argument ``most`` of a normaliser, None takes all) and life dates after a MARC name.
MAX_CONCEPTS = 3
MAX_SUBJECTS = 5
LIFE_DATES = r", \d{4}-\d{4}$"
EXTENT_PATTERN = r"(\d+) (?:Seiten|S\.|pages|p\.)"


def _nth(c: Column, i: int = 0) -> Column:
    return F.get(c, F.lit(i))


def _some(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _shape(rows: DataFrame, source: str, fields: dict[str, Column], keep: list[str]) -> DataFrame:
    columns = [fields.get(n, F.lit(None)).cast(FIELD_TYPES[n]).alias(n) for n in RECORD_FIELDS]
    return rows.select(*keep, F.lit(source).alias("source"), *columns)


def rebuild_abstract(index: Column) -> Column:
    """Text from a ``word -> positions`` map; positions nobody holds become empty words."""

    def placed(entries: Column) -> Column:
        return F.array_sort(
            F.flatten(
                F.transform(
                    entries,
                    lambda e, j: F.transform(
                        F.coalesce(e["value"], F.array().cast("array<int>")),
                        lambda p: F.struct(p.alias("at"), j.alias("j"), e["key"].alias("word")),
                    ),
                )
            )
        )

    def last_of_each(words: Column) -> Column:
        indexed = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.get(words, i + 1)["at"].alias("next")))
        kept = F.filter(indexed, lambda s: s["next"].isNull() | (s["next"] != s["w"]["at"]))
        return F.transform(kept, lambda s: s["w"])

    def spaced(words: Column) -> Column:
        pieces = F.transform(
            words,
            lambda w, i: F.concat(F.repeat(F.lit(" "), w["at"] - F.coalesce(F.get(words, i - 1)["at"], F.lit(0))), w["word"]),
        )
        return F.array_join(pieces, "")

    return let(let(placed(F.map_entries(index)), last_of_each), spaced)


def from_crossref(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    names = F.transform(
        "author", lambda a: F.concat_ws(" ", a["given"], a["family"])
    )
    fields = {
        "title": _nth(F.col("title")),
        "author": _some(F.filter(names, lambda n: n != "")),
        "journal": _nth(F.col("`container-title`")),
        "year": _nth(_nth(F.col("published")["date-parts"])),
        "publisher": F.col("publisher"),
        "doi": F.col("DOI"),
        "issn": _nth(F.col("ISSN")),
        "type": F.col("type"),
        "abstract": F.col("abstract"),
    }
    return _shape(rows, "crossref", fields, keep or [])


def _first(c: Column, most: int | None) -> Column:
    """The first ``most`` values of a list, all of them for None."""
    return c if most is None else F.slice(c, 1, most)


def from_openalex(rows: DataFrame, keep: list[str] | None = None, most: int | None = MAX_CONCEPTS) -> DataFrame:
    place = F.col("primary_location.source")
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    concepts = F.transform(_first(F.col("concepts"), most), lambda c: c["display_name"])
    fields = {
        "title": F.col("title"),
        "doi": null_if_empty(F.col("doi")),
        "author": _some(F.filter(names, lambda n: n.isNotNull())),
        "year": F.col("publication_year"),
        "journal": place["display_name"],
        "issn": place["issn_l"],
        "publisher": place["host_organization"]["display_name"],
        "cited_by_count": F.col("cited_by_count"),
        "keywords": _some(F.filter(concepts, lambda c: c.isNotNull())),
        "is_open_access": F.col("open_access.is_oa"),
        "type": F.col("type"),
        "abstract": rebuild_abstract(F.col("abstract_inverted_index")),
    }
    return _shape(rows, "openalex", fields, keep or [])


def from_googlebooks(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    info = F.col("volumeInfo")

    def identifier(kind: str) -> Column:
        return _nth(F.filter(info["industryIdentifiers"], lambda i: i["type"] == kind))["identifier"]

    fields = {
        "title": F.concat(info["title"], F.coalesce(F.concat(F.lit(": "), info["subtitle"]), F.lit(""))),
        "author": info["authors"],
        "year": search_regex(info["publishedDate"], r"^(\d{4})").cast("int"),
        "publisher": info["publisher"],
        "isbn": F.coalesce(identifier("ISBN_13"), identifier("ISBN_10")),
        "page_count": info["pageCount"],
        "language": info["language"],
        "keywords": info["categories"],
        "abstract": info["description"],
    }
    return _shape(rows, "googlebooks", fields, keep or [])


def from_openlib(rows: DataFrame, keep: list[str] | None = None, most: int | None = MAX_SUBJECTS) -> DataFrame:
    codes = F.transform(
        "language", lambda c: F.when(c == "eng", "en").when(c.isin("ger", "deu"), "de").otherwise(c)
    )
    fields = {
        "title": F.col("title"),
        "author": F.col("author_name"),
        "year": F.coalesce("first_publish_year", F.array_min("publish_year")),
        "publisher": _nth(F.col("publisher")),
        "isbn": _nth(F.col("isbn")),
        "language": null_if_empty(F.array_join(codes, "/")),
        "page_count": F.col("number_of_pages_median"),
        "keywords": F.coalesce(_first(F.col("subject"), most), F.array().cast("array<string>")),
    }
    return _shape(rows, "openlib", fields, keep or [])


def _fields(tag: str) -> Column:
    return F.filter("datafield", lambda d: d["_tag"] == tag)


def _subfield(field: Column, code: str) -> Column:
    """First non-empty value of a subfield."""
    values = F.filter(field["subfield"], lambda s: (s["_code"] == code) & has_text(s["_VALUE"]))
    return _nth(values)["_VALUE"]


def from_marc(rows: DataFrame, keep: list[str] | None = None, most: int | None = MAX_SUBJECTS) -> DataFrame:
    """Title parts 245 a and b, names 100/700, year and language 008, imprint 264, ISBN 020, extent 300, topics 650."""
    title = _nth(_fields("245"))
    parts = F.filter(title["subfield"], lambda s: s["_code"].isin("a", "b") & has_text(s["_VALUE"]))
    people = F.concat(F.slice(_fields("100"), 1, 1), _fields("700"))
    names = F.transform(people, lambda p: F.regexp_replace(strip(_subfield(p, "a")), LIFE_DATES, ""))
    control = _nth(F.filter("controlfield", lambda c: c["_tag"] == "008"))["_VALUE"]
    coded_year = F.nullif(F.substring(control, 8, 4).try_cast("int"), F.lit(0))
    imprint = _nth(_fields("264"))
    isbns = F.transform(_fields("020"), lambda f: search_regex(_subfield(f, "a"), r"([\dX]{10,13})"))
    topics = F.transform(_fields("650"), lambda f: strip(_subfield(f, "a")))
    code = F.when(F.length(control) >= 38, F.substring(control, 36, 3))
    fields = {
        "title": null_if_empty(F.array_join(F.transform(parts, lambda s: strip(s["_VALUE"])), " ")),
        "author": _some(F.filter(names, lambda n: n.isNotNull())),
        "year": F.coalesce(
            F.when(F.substring(control, 8, 4).rlike(r"^\d{4}$"), coded_year),
            search_regex(_subfield(imprint, "c"), r"(\d{4})").cast("int"),
        ),
        "publisher": F.regexp_replace(strip(_subfield(imprint, "b")), "[:,.]+$", ""),
        "isbn": _nth(F.filter(isbns, lambda i: i.isNotNull())),
        "page_count": search_regex(_subfield(_nth(_fields("300")), "a"), EXTENT_PATTERN).cast("bigint"),
        "language": F.when(code == "ger", "de").when(code == "eng", "en").otherwise(code),
        "keywords": _some(_first(F.filter(topics, lambda t: t.isNotNull()), most)),
    }
    return _shape(rows, "k10plus", fields, keep or [])


NORMALIZERS = {
    "crossref": from_crossref,
    "openalex": from_openalex,
    "googlebooks": from_googlebooks,
    "openlib": from_openlib,
    "k10plus": from_marc,
}


def union_records(tables: list[DataFrame]) -> DataFrame:
    """One catalogue from several normalised sources."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table, allowMissingColumns=True)
    return merged
