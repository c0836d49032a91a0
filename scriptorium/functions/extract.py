"""Bibliographic metadata from text, one column expression per field.

Rules read the whole text. A ``window`` argument limits one to the first so many characters; the ``*_CHARS`` numbers of
``fixed_values`` are the customary ones. Titles and page-one rules are about the head of a document by their nature:
their numbers of lines are arguments, and ``None`` takes all lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import fixed_values as v
from scriptorium.functions.lines import is_header_footer, is_irrelevant
from scriptorium.functions.text import WHITESPACE, extension, file_name, page_estimate, regex, search_regex, strip
from scriptorium.schema import null_if_empty, present

TEXTS = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _head(text: Column, window: int | None) -> Column:
    return text if window is None else F.substring(text, 1, window)


def text_lines(text: Column) -> Column:
    """Stripped lines without the empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def _none() -> Column:
    return F.lit(None).cast("string")


# --- title and authors ------------------------------------------------------------------------


def _top(lines: Column, most: int | None) -> Column:
    return lines if most is None else F.slice(lines, 1, most)


def title(text: Column, lines: int | None = v.TITLE_LINES, pattern_lines: int | None = v.TITLE_PATTERN_LINES) -> Column:
    """A marked title among the first ``pattern_lines`` lines, else the longest title-like one of the first ``lines``."""

    def from_lines(lines: Column) -> Column:
        top = F.array_join(_top(lines, pattern_lines), "\n")
        matched = let(top, lambda t: F.coalesce(*[strip(search_regex(t, p)) for p in v.TITLE_PATTERNS]))
        candidates = F.filter(
            lines,
            lambda line: (F.length(line) >= 10)
            & (F.length(line) <= 300)
            & ~line.rlike(regex(v.NOT_A_TITLE))
            & ~line.rlike(regex(v.NUMBERED_LINE)),
        )
        longest = F.array_max(F.transform(candidates, lambda line: F.struct(F.length(line).alias("n"), line.alias("line"))))
        return F.coalesce(matched, longest["line"])

    return let(_top(text_lines(text), lines), from_lines)


def authors(text: Column, name: Column | None = None, window: int | None = None) -> Column:
    def named(found: Column) -> Column:
        people = F.transform(F.split(found, regex(v.AUTHOR_SEPARATOR)), strip)
        return F.filter(people, lambda p: (F.length(p) > 3) & ~p.rlike(regex(v.NOT_AN_AUTHOR)))

    def first_hit(head: Column) -> Column:
        # A later pattern counts only when the earlier ones leave no name.
        tries = [let(named(search_regex(head, p)), lambda a: F.when(F.size(a) > 0, a)) for p in v.AUTHOR_PATTERNS]
        return F.coalesce(*tries)

    found = let(_head(text, window), first_hit)
    if name is None:
        return found
    guess = search_regex(file_name(name), v.FILENAME_AUTHOR)
    return F.coalesce(found, F.when(guess.isNotNull(), F.array(guess)))


# --- years ------------------------------------------------------------------------------------

# Blanks of the year patterns; ``strip`` also takes four separators below the space.
_SPACES = "".join(c for c in WHITESPACE if not "\x1c" <= c <= "\x1f")


def _near_digits(text: Column) -> Column:
    """The text as year patterns see it: of a line without a digit only its end stays, behind a dash.

    All patterns end in digits. What they read before these is on the same line, or blanks and a word at the end of an
    earlier one. Most lines hold no digit, and the patterns are slow.
    """

    def end(line: Column) -> Column:
        kept = F.concat(F.lit("-"), F.substring(line, -v.YEAR_REACH, v.YEAR_REACH))
        return F.when(line == "", line).otherwise(kept)

    def shortened(line: Column) -> Column:
        return F.when(line.rlike(regex(r"\d")), line).otherwise(let(F.rtrim(line, F.lit(_SPACES)), end))

    return F.array_join(F.transform(F.split(text, "\n"), shortened), "\n")


def year(text: Column, window: int | None = None, latest: int = v.MAX_YEAR) -> Column:
    """Most frequent plausible year over all patterns; among equals the first one seen."""

    def collect(head: Column) -> Column:
        found = F.flatten(F.array(*[F.regexp_extract_all(head, F.lit(regex(p)), F.lit(1)) for p in v.YEAR_PATTERNS]))
        return F.filter(
            F.transform(found, lambda y: y.try_cast("int")), lambda y: (y >= v.MIN_YEAR) & (y <= latest)
        )

    def mode(years: Column) -> Column:
        ranked = F.transform(
            F.array_distinct(years),
            lambda y, i: F.struct(F.size(F.filter(years, lambda x: x == y)).alias("n"), (-i).alias("i"), y.alias("y")),
        )
        return F.array_max(ranked)["y"]

    return let(let(_near_digits(_head(text, window)), collect), mode)


def year_max(text: Column) -> Column:
    """Newest year of 1990 to 2030, else the first year of the text."""
    low, high = v.PAGE_ONE_YEARS

    def pick(years: Column) -> Column:
        recent = F.filter(years, lambda y: (y >= low) & (y <= high))
        return F.when(F.size(recent) > 0, F.array_max(recent)).otherwise(F.get(years, F.lit(0)))

    found = F.regexp_extract_all(text, F.lit(regex(v.PAGE_ONE_YEAR)), F.lit(1))
    return let(F.transform(found, lambda y: y.cast("int")), pick)


# --- publisher and journal --------------------------------------------------------------------


def _quoted(name: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in name)


def _folded(c: Column) -> Column:
    """Lower case, with the letters case-insensitive patterns also take for ``s``, ``i`` and ``k``."""
    for letter, plain in zip("\u017f\u0130\u0131\u212a", "siik", strict=True):
        c = F.replace(c, F.lit(letter), F.lit(plain))
    return F.lower(c)


def _known(head: Column, folded: Column, names: list[str]) -> Column:
    """The first listed name that occurs as whole words; a plain substring test spares most pattern runs."""
    tests = [F.contains(folded, F.lit(n.lower())) & head.rlike(regex(rf"(?i)\b{_quoted(n)}\b")) for n in names]
    return F.coalesce(*[F.when(test, n) for test, n in zip(tests, names, strict=True)])


def _first_plausible(
    head: Column, folded: Column, patterns: list[str], hints: list[str], finish: Callable[[Column], Column] = lambda found: found
) -> Column:
    """The first pattern's match of 4 to 99 characters; patterns whose hint the text does not hold are not run."""

    def plausible(found: Column) -> Column:
        return F.when((F.length(found) > 3) & (F.length(found) < 100), finish(found))

    tries = [
        F.when(F.contains(folded, F.lit(hint)), let(strip(search_regex(head, p)), plausible))
        for p, hint in zip(patterns, hints, strict=True)
    ]
    return F.coalesce(*tries)


def publisher(text: Column, window: int | None = None) -> Column:
    def find(head: Column, folded: Column) -> Column:
        fits = _first_plausible(head, folded, v.PUBLISHER_PATTERNS, v.PUBLISHER_HINTS)
        return F.coalesce(_known(head, folded, v.PUBLISHERS), fits)

    return let(_head(text, window), lambda head: let(_folded(head), lambda folded: find(head, folded)))


def _without_tails(name: Column) -> Column:
    for tail in v.JOURNAL_TAILS:
        name = F.regexp_replace(name, regex(tail), "")
    return name


def journal(text: Column, window: int | None = None) -> Column:
    def find(head: Column, folded: Column) -> Column:
        fits = _first_plausible(head, folded, v.JOURNAL_PATTERNS, v.JOURNAL_HINTS, _without_tails)
        return F.coalesce(_known(head, folded, v.JOURNALS), fits)

    return null_if_empty(let(_head(text, window), lambda head: let(_folded(head), lambda folded: find(head, folded))))


# --- identifiers ------------------------------------------------------------------------------


def _with_doi(text: Column, found: Column) -> Column:
    """``found`` where the text holds what every DOI begins with; other texts are not searched by pattern."""
    return F.when(F.contains(text, F.lit("10.")), found)


def doi(text: Column) -> Column:
    return _with_doi(text, search_regex(text, v.DOI_PATTERN))


def doi_loose(text: Column) -> Column:
    found = _with_doi(text, F.coalesce(*[search_regex(text, p) for p in v.LOOSE_DOI_PATTERNS]))
    return F.regexp_replace(found, regex(r"[,;.\s]+$"), "")


def isbn(text: Column) -> Column:
    found = F.coalesce(*[search_regex(text, p) for p in v.ISBN_PATTERNS])
    return F.regexp_replace(F.when(text.rlike(regex("(?i)isbn")), found), "[- ]", "")


def doi_key(*identifiers: Column) -> Column:
    """Join key from the first identifier field that holds a DOI."""
    return F.lower(F.coalesce(*[search_regex(i, v.DOI_KEY) for i in identifiers]))


def isbn_key(c: Column) -> Column:
    return null_if_empty(F.regexp_replace(c, "[^0-9X]", ""))


# --- language ---------------------------------------------------------------------------------


def language_ratio(
    text: Column, window: int | None = None, min_chars: int = 0
) -> Column:
    """``de``, ``en`` or ``mixed`` by the share of common words; texts under ``min_chars`` count as ``en``."""

    def share(tokens: Column, listed: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(listed))) / F.size(tokens)

    def decide(shares: Column) -> Column:
        de, en = shares["de"], shares["en"]
        return (
            F.when((F.abs(de - en) < 0.05) & (de > 0.05) & (en > 0.05), "mixed").when(de > en, "de").otherwise("en")
        )

    def judge(tokens: Column) -> Column:
        both = F.struct(share(tokens, v.GERMAN_WORDS).alias("de"), share(tokens, v.ENGLISH_WORDS).alias("en"))
        return F.when(F.size(tokens) == 0, "en").otherwise(let(both, decide))

    tokens = F.regexp_extract_all(F.lower(_head(text, window)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    long_enough = F.coalesce(F.length(text) >= min_chars, F.lit(False))
    return F.when(long_enough, let(tokens, judge)).otherwise("en")


def language_presence(text: Column, window: int | None = None) -> Column:
    """``de`` when strictly more of the German than of the English words stand between blanks."""

    def listed(words: list[str]) -> Column:
        return F.array(*[F.lit(word) for word in words[: v.PRESENCE_WORDS]])

    def count(found: Column, words: list[str]) -> Column:
        return F.size(F.array_intersect(found, listed(words)))

    # The text is read once, for the words of both lists.
    found = F.array_intersect(F.split(F.lower(_head(text, window)), " "), F.array_union(listed(v.GERMAN_WORDS), listed(v.ENGLISH_WORDS)))
    return let(found, lambda f: F.when(count(f, v.GERMAN_WORDS) > count(f, v.ENGLISH_WORDS), "de").otherwise("en"))


def chunk_language(given: Column, text: Column) -> Column:
    return F.when(given.isin("auto", "mixed"), language_presence(text)).otherwise(given)


# --- everything together ----------------------------------------------------------------------


def extract_all(docs: DataFrame, text: str = "text", name: str | None = None, heads: bool = False) -> DataFrame:
    """All fields that can be read off the text; absent ones are null.

    With ``heads``, fields are looked for in the customary first characters only, and texts under
    ``LANGUAGE_MIN_CHARS`` count as English.
    """
    at = (lambda n: n) if heads else (lambda n: None)
    t = F.col(text)
    fields = {
        "title": null_if_empty(title(t)),
        "author": authors(t, F.col(name) if name else None, at(v.AUTHOR_CHARS)),
        "year": year(t, at(v.YEAR_CHARS)),
        "language": language_ratio(t, at(v.LANGUAGE_CHARS), v.LANGUAGE_MIN_CHARS if heads else 0),
        "doi": doi(t),
        "isbn": isbn(t),
        "journal": journal(t, at(v.JOURNAL_CHARS)),
        "publisher": publisher(t, at(v.PUBLISHER_CHARS)),
    }
    if name:
        fields["file_extension"] = extension(F.col(name))
    return docs.withColumns(fields)


def fill_missing(docs: DataFrame, name: str = "filename", text: str = "text", language: str = "auto") -> DataFrame:
    """Fill title, authors, language, file type, pages and size where the reader left them out."""
    t = F.col(text)
    return docs.withColumns(
        {
            "title": F.when(present("title"), F.col("title")).otherwise(title(t)),
            "author": F.when(present("author"), F.col("author")).otherwise(authors(t, F.col(name))),
            "language": F.when(present("language"), F.col("language")).otherwise(language),
            "file_type": null_if_empty(F.substring(extension(F.col(name)), 2, 100)),
            "page_count": F.coalesce("page_count", page_estimate(t)),
            "filename": file_name(F.col(name)),
        }
    )


# --- page one of a paged file -----------------------------------------------------------------


def body_lines(text: Column) -> Column:
    return F.filter(text_lines(text), lambda line: ~is_header_footer(line))


def page_title(lines: Column, most: int | None = v.PAGE_ONE_TITLE_LINES) -> Column:
    """Longest of the first ``most`` lines that can be a title; the first among equals."""
    ranked = F.transform(
        F.filter(
            F.transform(_top(lines, most), lambda line, i: F.struct(line.alias("line"), i.alias("i"))),
            lambda s: (F.length(s["line"]) >= 20) & ~s["line"].rlike(regex(v.PAGE_ONE_NOT_A_TITLE)),
        ),
        lambda s: F.struct(F.length(s["line"]).alias("n"), (-s["i"]).alias("i"), s["line"].alias("line")),
    )
    return F.array_max(ranked)["line"]


def page_authors(
    lines: Column, found_title: Column, after_title: int | None = v.PAGE_ONE_AUTHOR_LINES, anywhere: int | None = v.PAGE_ONE_NAME_LINES
) -> Column:
    """Name lines among the ``after_title`` lines after the title, else every name-like match in the first ``anywhere`` lines."""
    name_line = regex("|".join(v.PAGE_ONE_NAMES))

    def is_author_line(line: Column) -> Column:
        titled = line.rlike(regex(v.PAGE_ONE_DEGREE)) & ~line.rlike(regex(v.PAGE_ONE_INSTITUTION))
        fits = (F.length(line) >= 3) & (F.length(line) <= 100)
        return fits & (line.rlike(name_line) | titled) & ~is_irrelevant(line)

    def after(at: Column) -> Column:
        near = F.filter(F.slice(lines, at + 1, F.size(lines) if after_title is None else F.lit(after_title)), is_author_line)
        everywhere = F.regexp_extract_all(
            F.array_join(_top(lines, anywhere), " "), F.lit(regex(v.PAGE_ONE_ANY_NAME)), F.lit(1)
        )
        names = F.filter(F.array_distinct(everywhere), lambda n: ~is_irrelevant(n))
        return F.when(F.size(near) > 0, near).otherwise(names)

    holds = F.transform(lines, lambda line: F.contains(line, found_title))
    position = F.array_position(holds, F.lit(True))
    usable = F.coalesce((found_title != "") & (position > 0) & (position < F.size(lines)), F.lit(False))
    return F.when(usable, let(position.cast("int"), after)).otherwise(F.array().cast(TEXTS))


def page_journal(lines: Column, most: int | None = v.PAGE_ONE_JOURNAL_LINES) -> Column:
    """Whole match of the first journal-like wording in the first ``most`` lines."""
    found = F.transform(
        _top(lines, most), lambda line: F.coalesce(*[search_regex(line, p, 0) for p in v.PAGE_ONE_JOURNAL])
    )
    return strip(F.get(F.filter(found, lambda f: f.isNotNull()), F.lit(0)))


def page_metadata(pages: DataFrame, text: str = "text") -> DataFrame:
    """Put what page one says over the file's own metadata.

    A title replaces an absent or shorter one, authors fill a gap, DOI, journal and year overwrite.
    """
    lined = pages.withColumn("_lines", body_lines(F.col(text))).withColumn("_title", page_title(F.col("_lines")))
    new_title, found = F.col("_title"), page_authors(F.col("_lines"), F.col("_title"))
    better = (
        new_title.isNotNull()
        & ~is_irrelevant(new_title)
        & (~present("title") | (F.length(new_title) > F.length("title")))
    )
    return lined.withColumns(
        {
            "title": F.when(better, new_title).otherwise(F.col("title")),
            "author": F.when(present("author"), F.col("author")).otherwise(F.when(F.size(found) > 0, found)),
            "doi": F.coalesce(doi_loose(F.col(text)), F.col("doi")),
            "journal": F.coalesce(page_journal(F.col("_lines")), F.col("journal")),
            "year": F.coalesce(year_max(F.col(text)), F.col("year")),
        }
    ).drop("_lines", "_title")


def validate_title(c: Column, most: int | None = None) -> Column:
    """Whitespace collapsed; with ``most`` (customary: 300) longer titles are cut there with an ellipsis."""
    squeezed = strip(F.regexp_replace(c, regex(r"\s+"), " "))
    if most is None:
        return squeezed
    return let(
        squeezed, lambda s: F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)
    )


def validate_authors(c: Column) -> Column:
    """Names of 3 to 100 characters that are no legal notice; the originals when none is left."""
    kept = F.filter(c, lambda a: (F.length(a) >= 3) & (F.length(a) <= 100) & ~is_irrelevant(a))
    return F.when(F.size(kept) > 0, kept).otherwise(c)


def validate_metadata(docs: DataFrame) -> DataFrame:
    return docs.withColumns(
        {
            "title": F.when(present("title"), validate_title(F.col("title"))).otherwise(F.col("title")),
            "author": F.when(present("author"), validate_authors(F.col("author"))).otherwise(F.col("author")),
        }
    )
