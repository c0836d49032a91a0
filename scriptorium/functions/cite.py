"""Citations in five styles as plain column expressions.

Every function reads the metadata columns ``title, author, year, journal, publisher, ...`` of the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import UNKNOWN, words
from scriptorium.schema import present

# Fixed values of the output formats.
DEFAULT_TITLE = "Unbekannter Titel"
NO_YEAR = "n.d."
DOI_PREFIX = "https://doi.org/"
STYLES = ["apa", "mla", "chicago", "harvard", "ieee"]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _if(name: str, *parts: Column | str) -> Column:
    """The concatenated parts when the field is present, else nothing."""
    return F.when(present(name), _text(*parts)).otherwise("")


def _nth(names: Column, i: int) -> Column:
    return F.get(names, F.lit(i))


def _head(parts: Column) -> Column:
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def _last_first(name: Column) -> Column:
    parts = words(name)
    full = _text(F.try_element_at(parts, F.lit(-1)), ", ", F.array_join(_head(parts), " "))
    return F.when(F.size(parts) > 1, full).otherwise(name)


def _initials(parts: Column, glue: str) -> Column:
    return F.array_join(F.transform(_head(parts), lambda p: _text(F.substring(p, 1, 1), ".")), glue)


def _last_initials(name: Column) -> Column:
    parts = words(name)
    full = _text(F.try_element_at(parts, F.lit(-1)), ", ", _initials(parts, ""))
    return F.when(F.size(parts) > 1, full).otherwise(name)


def _initials_last(name: Column) -> Column:
    parts = words(name)
    full = _text(_initials(parts, " "), " ", F.try_element_at(parts, F.lit(-1)))
    return F.when(F.size(parts) > 1, full).otherwise(name)


def _all_but_last(names: Column) -> Column:
    return F.array_join(_head(names), ", ")


def _final(names: Column) -> Column:
    return F.try_element_at(names, F.lit(-1))


def _authors(style: str) -> Column:
    names = F.col("author")
    if style == "apa":
        listed = F.transform(names, _last_initials)
        text = (
            F.when(F.size(listed) == 1, _nth(listed, 0))
            .when(F.size(listed) == 2, _text(_nth(listed, 0), " & ", _nth(listed, 1)))
            .otherwise(_text(_all_but_last(listed), ", & ", _final(listed)))
        )
    elif style == "harvard":
        listed = F.transform(names, _last_initials)
        text = (
            F.when(F.size(listed) == 1, _nth(listed, 0))
            .when(F.size(listed) == 2, _text(_nth(listed, 0), " and ", _nth(listed, 1)))
            .when(F.size(listed) == 3, _text(_nth(listed, 0), ", ", _nth(listed, 1), " and ", _nth(listed, 2)))
            .otherwise(_text(_nth(listed, 0), " et al."))
        )
    elif style == "ieee":
        listed = F.transform(names, _initials_last)
        text = (
            F.when(F.size(listed) == 1, _nth(listed, 0))
            .when(F.size(listed) == 2, _text(_nth(listed, 0), " and ", _nth(listed, 1)))
            .otherwise(_text(_all_but_last(listed), ", and ", _final(listed)))
        )
        text = _text(text, ", ")
    else:
        lead = _last_first(_nth(names, 0))
        text = F.when(F.size(names) == 1, _text(lead, ". ")).when(
            F.size(names) == 2, _text(lead, ", and ", _nth(names, 1), ". ")
        )
        if style == "chicago":
            second, third = _nth(names, 1), _nth(names, 2)
            parted = _text(
                lead, ", ", F.array_join(words(second), " "), ", and ", F.array_join(words(third), " "), ". "
            )
            plain = _text(lead, ", ", second, ", and ", third, ". ")
            text = text.when(
                F.size(names) == 3, F.when(F.size(words(_nth(names, 0))) > 1, parted).otherwise(plain)
            )
        text = text.otherwise(_text(lead, ", et al. "))
    return F.when(present("author"), text).otherwise("")


def _year() -> Column:
    return F.coalesce(F.col("year").cast("string"), F.lit(NO_YEAR))


def _title(article: tuple[str, str], book: tuple[str, str]) -> Column:
    title = F.coalesce(F.col("title"), F.lit(DEFAULT_TITLE))
    is_article = F.coalesce(F.col("type") == "article", F.lit(False)) | present("journal")
    return F.when(is_article, _text(article[0], title, article[1])).otherwise(_text(book[0], title, book[1]))


def _doi_url() -> Column:
    doi = F.col("doi")
    return F.when(doi.startswith(DOI_PREFIX), doi).otherwise(_text(DOI_PREFIX, doi))


def _journal() -> Column:
    return _text("*", F.col("journal"), "*")


def _volume_issue() -> Column:
    return _if("volume", ", ", F.col("volume"), _if("issue", "(", F.col("issue"), ")"))


def apa() -> Column:
    source = (
        F.when(present("journal"), _text(_journal(), _volume_issue(), _if("pages", ", ", F.col("pages")), "."))
        .when(present("publisher"), _text(F.col("publisher"), "."))
        .otherwise("")
    )
    title = _title(("", ". "), ("*", "*. "))
    return _text(_authors("apa"), "(", _year(), "). ", title, source, _if("doi", " ", _doi_url()))


def mla() -> Column:
    volume = _if("volume", ", vol. ", F.col("volume"))
    issue = _if("issue", ", no. ", F.col("issue"))
    container = _if("journal", _journal(), volume, issue, ", ")
    pages = F.when(present("pages") & present("journal"), _text(", pp. ", F.col("pages"))).otherwise("")
    title = _title(('"', '." '), ("*", "*. "))
    publisher = _if("publisher", F.col("publisher"), ", ")
    doi = _if("doi", ". ", _doi_url())
    return _text(_authors("mla"), title, container, publisher, _year(), pages, doi, ".")


def chicago() -> Column:
    numbering = _if("volume", F.col("volume"), _if("issue", ", no. ", F.col("issue"), " "))
    article = _text(_journal(), " ", numbering, "(", _year(), ")", _if("pages", ": ", F.col("pages")), ".")
    city = _if("publisher_location", F.col("publisher_location"), ": ")
    book = _text(_if("publisher", city, F.col("publisher"), ", "), _year(), ".")
    source = F.when(present("journal"), article).otherwise(book)
    title = _title(('"', '." '), ("*", "*. "))
    return _text(_authors("chicago"), title, source, _if("doi", " ", _doi_url(), "."))


def harvard() -> Column:
    city = _if("publisher_location", F.col("publisher_location"), ": ")
    source = (
        F.when(present("journal"), _text(_journal(), _volume_issue(), _if("pages", ", pp. ", F.col("pages")), "."))
        .when(present("publisher"), _text(city, F.col("publisher"), "."))
        .otherwise("")
    )
    doi = _if("doi", " Verfügbar unter: ", _doi_url(), " [Zugriff am: --].")
    title = _title(("'", "', "), ("*", "*, "))
    return _text(_authors("harvard"), "(", _year(), ") ", title, source, doi)


def ieee() -> Column:
    volume = _if("volume", ", vol. ", F.col("volume"), _if("issue", ", no. ", F.col("issue")))
    article = _text(_journal(), volume, _if("pages", ", pp. ", F.col("pages")), ", ", _year(), ".")
    book = _text(_if("publisher", F.col("publisher"), ", "), _year(), ".")
    source = F.when(present("journal"), article).otherwise(book)
    title = F.coalesce(F.col("title"), F.lit(DEFAULT_TITLE))
    return _text(_authors("ieee"), '"', title, '," ', source, _if("doi", " DOI: ", _doi_url(), "."))


def cite(style: str = "apa") -> Column:
    """The citation in a style; unknown styles fall back to APA."""
    return {"mla": mla, "chicago": chicago, "harvard": harvard, "ieee": ieee}.get(style.lower(), apa)()


def cite_by(style: Column) -> Column:
    """The citation in the style each row names."""
    wanted = F.lower(style)
    return (
        F.when(wanted == "mla", mla())
        .when(wanted == "chicago", chicago())
        .when(wanted == "harvard", harvard())
        .when(wanted == "ieee", ieee())
        .otherwise(apa())
    )


def lead_surname() -> Column:
    """Surname of the first author, ``et al.`` when there are more."""
    parts = words(_nth(F.col("author"), 0))
    last = F.try_element_at(parts, F.lit(-1))
    named = F.when(F.size("author") > 1, _text(last, " et al.")).otherwise(last)
    return F.when(present("author") & (F.size(parts) > 0), named).otherwise(UNKNOWN)


def inline(style: str = "apa", page: Column | None = None) -> Column:
    """In-text citation with an optional page."""
    who, page = lead_surname(), F.lit(None).cast("string") if page is None else page.cast("string")

    def at(mark: str) -> Column:
        return F.when(F.coalesce(page != "", F.lit(False)), _text(mark, page)).otherwise("")

    forms = {
        "mla": lambda: _text("(", who, at(" "), ")"),
        "chicago": lambda: _text("(", who, " ", _year(), at(", "), ")"),
        "harvard": lambda: _text("(", who, ", ", _year(), at(": "), ")"),
        "ieee": lambda: _text("[", F.coalesce(F.nullif(page, F.lit("")), F.lit("1")), "]"),
    }
    return forms.get(style.lower(), lambda: _text("(", who, ", ", _year(), at(", S. "), ")"))()


def short_form() -> Column:
    """Detail-page form: surnames, year, title, place and DOI link, single spaces."""
    last = F.transform("author", lambda a: F.element_at(F.split(a, " "), -1))
    count = F.size(last)
    middle = F.slice(last, F.lit(2), F.greatest(count - 2, F.lit(0)))
    rest = F.concat(
        F.transform(middle, lambda s: _text(s, ",")),
        F.when(count > 1, F.array(_text("& ", _final(last)))).otherwise(F.array().cast("array<string>")),
    )
    authors = F.when(present("author"), F.concat_ws(" ", _text(_nth(last, 0), ","), F.array_join(rest, " ")))
    year = F.when(present("year"), _text("(", F.col("year").cast("string"), ")."))
    title = _text("*", F.coalesce("title", F.lit("")), "*.")
    place = F.when(present("journal"), F.col("journal")).when(present("publisher"), F.col("publisher"))
    doi = F.when(present("doi"), _text(DOI_PREFIX, F.col("doi")))
    return F.regexp_replace(F.concat_ws(" ", authors, year, title, place, doi), " {2,}", " ")
