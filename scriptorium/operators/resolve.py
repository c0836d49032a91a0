"""Finding each document's catalogue record: by DOI, by ISBN, by title and author."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.extract import doi_key, isbn_key, let
from scriptorium.functions.text import normalize_title, strip, surname
from scriptorium.operators.scoring import AUTHOR_POINTS, SOURCE_ORDER, candidate_author_points, candidate_bonus, most_title_points, title_points
from scriptorium.schema import RECORD_FIELDS, present
from scriptorium.session import cut_lineage

# Which services answer which identifier, and the least acceptable score.
DOI_SOURCES = ["crossref", "openalex"]
ISBN_SOURCES = ["googlebooks", "openlib", "k10plus"]
ISBN_THEN_TITLE = ["openlib", "k10plus"]
FULL_NAME_SOURCES = ["googlebooks"]
MIN_SCORE = 10.0
# Title word sets must share this part of their union.
TITLE_OVERLAP = 0.6
ANY_NAME = "any"
# Phrases with this share of the length of the title that holds them are scored before the others.
NEAR_LENGTH = 0.3


def _record() -> Column:
    return F.struct("rank", "record_id", *RECORD_FIELDS)


def _first_record(catalogue: DataFrame, key: Column, name: str) -> DataFrame:
    """One record per source and identifier: the service's first answer. Partial aggregation absorbs hot keys."""
    return (
        catalogue.select("source", key.alias(name), _record().alias("record"))
        .filter(F.col(name).isNotNull())
        .groupBy("source", name)
        .agg(F.min_by("record", F.struct("record.rank", "record.record_id")).alias("record"))
    )


def by_doi(library: DataFrame, catalogue: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, source, record)`` for documents whose DOI a service knows; it may stand in ``doi`` or ``identifier``."""
    fields = [F.col(c) for c in ("doi", "identifier") if c in library.columns]
    wanted = library.select(key, doi_key(*fields).alias("doi_key")).filter("doi_key IS NOT NULL")
    known = _first_record(catalogue.filter(F.col("source").isin(DOI_SOURCES)), doi_key(F.col("doi")), "doi_key")
    return wanted.join(known, "doi_key").select(key, "source", "record")


def by_isbn(library: DataFrame, catalogue: DataFrame, key: str = "doc_id") -> DataFrame:
    wanted = library.select(key, isbn_key(F.col("isbn")).alias("isbn_key")).filter("isbn_key IS NOT NULL")
    known = _first_record(catalogue.filter(F.col("source").isin(ISBN_SOURCES)), isbn_key(F.col("isbn")), "isbn_key")
    return wanted.join(known, "isbn_key").select(key, "source", "record")


def title_words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(normalize_title(title)), " "), lambda w: w != ""))


def _size_class(n: Column) -> Column:
    """Word counts up to six stand for themselves, larger ones in steps of a quarter."""
    return F.when(n <= 6, n).otherwise(F.floor(F.log(n / F.lit(7.0)) / math.log(1.25)) + 7).cast("int")


def _leading_words(words: Column, both: Column, overlap: float) -> Column:
    """``(word, class)`` per size class of possible partners: the words one of which a partner shares.

    Sets of ``n`` and ``m`` words that share ``overlap`` of their union have at least
    ``a = ceil(overlap / (1 + overlap) * (n + m))`` words in common, so in any common order of the words the
    first ``n - a + 1`` of one and the first ``m - a + 1`` of the other meet. Within a class the smallest
    partner asks for the longest lead. Words that only one side has (``both`` is false) meet nothing.
    """
    n = F.size(words)
    smallest = F.ceil(n * F.lit(overlap) - F.lit(1e-9)).cast("int")
    largest = F.floor(n / F.lit(overlap) + F.lit(1e-9)).cast("int")

    def lead(m: Column) -> Column:
        shared = F.ceil((n + m) * F.lit(overlap / (1 + overlap)) - F.lit(1e-9))
        return F.struct(_size_class(m).alias("class"), (n - shared + 1).cast("int").alias("lead"))

    def first_of_class(leads: Column) -> Column:
        indexed = F.transform(leads, lambda e, i: F.struct(e.alias("e"), F.get(leads, i - 1)["class"].alias("before")))
        kept = F.filter(indexed, lambda x: x["before"].isNull() | (x["before"] != x["e"]["class"]))
        return F.transform(kept, lambda x: x["e"])

    def spelled(leads: Column) -> Column:
        return F.flatten(
            F.transform(
                leads,
                lambda e: F.transform(
                    _of_both(F.slice(words, F.lit(1), e["lead"]), both),
                    lambda w: F.struct(w.alias("word"), e["class"].alias("class")),
                ),
            )
        )

    return let(let(F.transform(F.sequence(smallest, largest), lead), first_of_class), spelled)


def _of_both(words: Column, both: Column) -> Column:
    return F.filter(words, lambda w, i: F.get(both, i))


def _bit(c: Column) -> Column:
    """A number with the one of 64 bits set that stands for the value."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))


def _bits(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda bits, c: bits.bitwiseOR(_bit(c)))


def worded(titles: DataFrame) -> DataFrame:
    """``(title_id, words, both, bits)`` of distinct numbered titles, words from rare to frequent among these titles.

    ``both`` tells which of the words stand in ``asked`` and in ``known`` titles, ``bits`` has the bits of all words.
    Frequencies are counted over all titles and met by a join on the word; nothing is broadcast.
    """
    split = titles.select("title_id", "asked", "known", F.explode(title_words(F.col("title_lower"))).alias("word"))
    seen = split.groupBy("word").agg(F.count("*").alias("seen"), (F.max("asked") & F.max("known")).alias("both"))
    ranked = F.array_sort(F.collect_list(F.struct("seen", (-F.length("word")).alias("l"), "word", "both")))
    met = split.select("title_id", "word").join(seen, "word")
    return met.groupBy("title_id").agg(ranked.alias("ranked"), F.bit_or(_bit(F.col("word"))).alias("bits")).select(
        "title_id", F.col("ranked.word").alias("words"), F.col("ranked.both").alias("both"), "bits"
    )


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table. What was shuffled for it is not read again: collecting the driver's garbage gives the disk back."""
    table = cut_lineage(df, name)
    df.sparkSession._jvm.System.gc()
    return table


def all_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """`worded` of the titles of both sides with a ``title_id`` of their own, written; the joins on titles share it.

    ``chars`` is the length that similarities count, ``phrase`` the normalised title where it is another one.
    """
    sides = left.select("title_lower", F.lit(True).alias("asked")).unionByName(right.select("title_lower", F.lit(False).alias("asked")))
    titles = sides.groupBy("title_lower").agg(F.max("asked").alias("asked"), F.max(~F.col("asked")).alias("known"))
    numbered = _written(titles.withColumn("title_id", F.monotonically_increasing_id()), "titles")
    title = F.col("title_lower")
    plain = numbered.select(
        "title_id", "title_lower", F.nullif(F.lower(normalize_title(title)), title).alias("phrase"), F.length(strip(F.lower(title))).alias("chars")
    )
    return _written(plain.join(worded(numbered), "title_id"), "title-words")


def _spread_words(titles: DataFrame, overlap: float, name: str, other: str) -> DataFrame:
    """Per title one narrow row for each leading word and partner class."""
    leading = F.explode(_leading_words(F.col("words"), F.col("both"), overlap)).alias("k")
    return titles.select("title_id", F.size("words").alias("n"), "bits", "names", leading).select(
        "k.word",
        F.col("title_id").alias(f"{name}_id"),
        _size_class(F.col("n")).alias(f"{name}_class"),
        F.col("k.class").alias(f"{other}_class"),
        *[F.col(c).alias(f"{name}_{c}") for c in ("n", "bits", "names")],
    )


def _alike(a: DataFrame, b: DataFrame, overlap: float) -> DataFrame:
    """``(left_id, right_id)`` of the titles that share a leading word: all that overlap enough, and some others.

    Bits that only one title has are words that only one has, and at most ``1 - overlap`` of the union may be such words.
    ``names`` have a common bit where the titles have a common name. Pairs that fail leave the join at once.
    """
    apart = F.bit_count(F.col("left_bits").bitwiseXOR(F.col("right_bits")))
    near = apart <= (F.col("left_n") + F.col("right_n")) * F.lit((1 - overlap) / (1 + overlap)) + F.lit(1e-9)
    named = F.col("left_names").bitwiseAND(F.col("right_names")) != 0
    left, right = _spread_words(a, overlap, "left", "right"), _spread_words(b, overlap, "right", "left")
    return left.join(right, ["word", "left_class", "right_class"]).filter(near & named).select("left_id", "right_id").distinct()


def _overlaps(left_phrase: Column, right_phrase: Column, overlap: float) -> Column:
    def enough(words: Column) -> Column:
        total = F.size(words["left"]) + F.size(words["right"])
        shared = F.size(F.array_intersect(words["left"], words["right"]))
        return shared >= (total - shared) * F.lit(overlap) - F.lit(1e-9)

    def words_of(phrase: Column) -> Column:
        return F.array_distinct(F.split(phrase, " "))

    return let(F.struct(words_of(left_phrase).alias("left"), words_of(right_phrase).alias("right")), enough)


def similar_titles(left: DataFrame, right: DataFrame, overlap: float = TITLE_OVERLAP, words: DataFrame | None = None) -> DataFrame:
    """All ``(left_title, right_title)`` pairs of distinct titles whose word sets overlap enough.

    Exact: the join runs on each title's rarest words, of which every qualifying pair shares one, and on both
    sizes. A word that half the titles use is among the leading ones only where a title has nothing rarer.
    Ids travel through the join; words and titles are fetched for the pairs that met.
    """
    words = all_words(left, right) if words is None else words
    everyone = words.withColumn("names", F.lit(-1).cast("bigint"))
    a = everyone.join(left.select("title_lower").distinct(), "title_lower", "left_semi")
    b = everyone.join(right.select("title_lower").distinct(), "title_lower", "left_semi")
    met = _with_titles(_alike(a, b, overlap), words)
    return met.filter(_overlaps(F.col("left_phrase"), F.col("right_phrase"), overlap)).select("left_title", "right_title")


def _holds(left_phrase: Column, right_phrase: Column) -> Column:
    """One of the two phrases stands in the other."""
    left, right = (F.concat(F.lit(" "), phrase, F.lit(" ")) for phrase in (left_phrase, right_phrase))
    return F.contains(right, left) | F.contains(left, right)


def _carried(titles: DataFrame, name: str, carry: list[str]) -> list[Column]:
    columns = {"id": F.col("title_id"), "n": F.size("words"), **{c: F.col(c) for c in ("bits", "names", "chars", *carry)}}
    return [c.alias(f"{name}_{key}") for key, c in columns.items()]


def _holding(left: DataFrame, right: DataFrame, worth: Callable[[Column, Column, list[Column]], Column], carry: list[str] = []) -> DataFrame:
    """``(left_id, right_id)`` of titles one of which has the other's rarest word and all its bits, and that are ``worth`` it.

    A phrase has all its words in the title that holds it, so its rarest one is among that title's words: phrases, by
    rarest word, are probed from all words of the titles of the other side, both ways. ``names`` have a common bit where
    the titles have a common name. ``worth`` is asked in the join, of both lengths and of the sums of the ``carry`` columns:
    what fails is never written.
    """

    def probed(phrases: DataFrame, holders: DataFrame) -> DataFrame:
        rarest = phrases.filter(F.get("both", F.lit(0))).select(F.get("words", F.lit(0)).alias("word"), *_carried(phrases, "phrase", carry))
        probes = holders.select(F.explode(_of_both(F.col("words"), F.col("both"))).alias("word"), *_carried(holders, "holder", carry))
        held = (F.col("phrase_n") <= F.col("holder_n")) & (F.col("phrase_bits").bitwiseAND(F.col("holder_bits")) == F.col("phrase_bits"))
        named = F.col("phrase_names").bitwiseAND(F.col("holder_names")) != 0
        sums = [F.col(f"phrase_{c}") + F.col(f"holder_{c}") for c in carry]
        return rarest.join(probes, "word").filter(held & named & worth(F.col("phrase_chars"), F.col("holder_chars"), sums))

    asked = probed(left, right).select(F.col("phrase_id").alias("left_id"), F.col("holder_id").alias("right_id"))
    return asked.union(probed(right, left).select("holder_id", "phrase_id")).distinct()


def _with_titles(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs with ``left_title``, ``left_phrase``, ``right_title`` and ``right_phrase``."""
    for name in ("left", "right"):
        phrase = F.coalesce("phrase", "title_lower").alias(f"{name}_phrase")
        pairs = pairs.join(words.select(F.col("title_id").alias(f"{name}_id"), F.col("title_lower").alias(f"{name}_title"), phrase), f"{name}_id")
    return pairs


def containing_titles(left: DataFrame, right: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """All ``(left_title, right_title)`` pairs of one ``name_key`` where one title stands in the other as a phrase.

    ``left`` and ``right``: title_lower and name_key.
    """
    words = all_words(left, right) if words is None else words
    sides = [side.join(words, "title_lower").select("title_id", "name_key").distinct() for side in (left, right)]
    named = [words.join(side.groupBy("title_id").agg(F.bit_or(_bit(F.col("name_key"))).alias("names")), "title_id") for side in sides]
    asking, answering = (side.withColumnRenamed("title_id", f"{name}_id") for side, name in zip(sides, ("left", "right"), strict=True))
    pairs = _holding(*named, lambda *_: F.lit(True)).join(asking, "left_id").join(answering, ["right_id", "name_key"])
    found = _with_titles(pairs.select("left_id", "right_id").distinct(), words)
    return found.filter(_holds(F.col("left_phrase"), F.col("right_phrase"))).select("left_title", "right_title")


def _name_keys(source: Column, author: Column) -> Column:
    """The keys a record answers to: full names at the books service, surnames elsewhere."""
    return F.array_distinct(
        F.transform(
            author,
            lambda a: F.when(source.isin(FULL_NAME_SOURCES), F.concat(F.lit("full:"), F.lower(a))).otherwise(
                F.concat(F.lit("last:"), F.lower(surname(a)))
            ),
        )
    )


def _best_record() -> Column:
    order = F.struct((-F.col("bonus")).alias("b"), "record.rank", "record.record_id")
    return F.min_by(F.struct("bonus", "record"), order).alias("best")


def _first_of(columns: list[str]) -> Column:
    """The ``columns`` of the row with the highest score, of equal ones the first by rank and record id."""
    order = F.struct((-F.col("score")).alias("s"), F.col("rank"), F.col("record_id"))
    return F.min_by(F.struct(*columns), order).alias("best")


def by_title(
    library: DataFrame,
    catalogue: DataFrame,
    key: str = "doc_id",
    similarity: str = "levenshtein",
    overlap: float = TITLE_OVERLAP,
    min_score: float = MIN_SCORE,
) -> DataFrame:
    """Best-scored record per document and source among records with a similar title and the first author's name.

    A title is similar if the word sets overlap enough or if one of the two holds the other as a phrase, as a title with
    a subtitle holds the title without.

    Both sides are reduced before they meet: documents to distinct (title, authors), records to the best one
    per (source, title, authors), because the score depends on nothing else. A title shared by a third of
    all rows is one row in the similarity join.

    Phrases of one or two words stand in very many titles, and nearly all of these score far below the best record. So titles
    that overlap, and phrases not much shorter than what holds them, are scored first. Of the other phrases only
    those are looked at that could still reach the best score found so far, by both lengths and by the best bonus of the title's
    records; they are told apart in the join. Nothing that could win is left out.
    """
    title_lower = F.lower("title").alias("title_lower")
    asked = library.filter(present("title")).select(key, title_lower, F.when(present("author"), F.col("author")).alias("author"))
    bonus = candidate_bonus(F.col("source"), F.col)
    # Equal (source, title, authors) score alike but for the bonus: keep the best, then the first.
    records = (
        catalogue.filter(present("title"))
        .select("source", title_lower, "author", bonus.alias("bonus"), _record().alias("record"))
        .groupBy("source", "title_lower", "author")
        .agg(_best_record())
        .select("source", "title_lower", "author", "best.bonus", "best.record")
    )
    # Numbered and written once: numbers of titles and records travel through the joins, records are fetched for the winners.
    records = _written(records.withColumn("record_no", F.monotonically_increasing_id()), "title-records")
    words = all_words(asked.select("title_lower"), records.select("title_lower"))
    ids = words.select("title_lower", "title_id")
    queries = _written(
        asked.select("title_lower", "author").distinct().join(ids, "title_lower")
        .select("title_lower", F.col("title_id").alias("left_id"), F.col("author").alias("asked_author"), F.monotonically_increasing_id().alias("query_no")),
        "title-queries",
    )
    known = _written(
        records.join(ids, "title_lower")
        .select("source", F.col("title_id").alias("right_id"), "author", "bonus", "record.rank", "record.record_id", "record_no"),
        "title-answers",
    )
    # Documents ask under their first author's name, those without authors under ANY_NAME; records answer
    # under each of their names, and the best one of a title also under ANY_NAME, because without authors
    # only the bonus separates the records of one title.
    first = F.get("asked_author", F.lit(0))
    names = F.array(F.concat(F.lit("full:"), F.lower(first)), F.concat(F.lit("last:"), F.lower(surname(first))))
    named = queries.select(
        "left_id", "query_no", "asked_author", F.explode(F.when(F.col("asked_author").isNull(), F.array(F.lit(ANY_NAME))).otherwise(names)).alias("name_key")
    )
    answer_keys = _name_keys(F.col("source"), F.col("author"))
    # Names that no record has are not asked under.
    answered = known.select(F.explode(F.concat(F.coalesce(answer_keys, F.array().cast("array<string>")), F.array(F.lit(ANY_NAME)))).alias("name_key")).distinct()
    asking = _written(named.select("left_id", "name_key").distinct().join(answered, "name_key", "left_semi"), "title-askers")

    def best(pairs: DataFrame) -> DataFrame:
        """The first of the records that the pairs of titles lead to, for each query and source."""
        met = known.join(pairs.select("right_id").distinct(), "right_id", "left_semi")
        answer = ["author", "bonus", "rank", "record_id", "record_no"]
        by_name = met.select("source", "right_id", *answer, F.explode(answer_keys).alias("name_key"))
        best_of_title = (
            met.withColumn("score", F.col("bonus")).groupBy("source", "right_id").agg(_first_of(answer))
            .select("source", "right_id", "best.*", F.lit(ANY_NAME).alias("name_key"))
        )
        met_records = pairs.join(asking, "left_id").join(by_name.unionByName(best_of_title), ["right_id", "name_key"])
        points = F.col("title_points") + candidate_author_points(F.col("source"), F.col("author"), F.col("asked_author")) + F.col("bonus")
        scored = named.join(met_records, ["left_id", "name_key"]).withColumn("score", points)
        return scored.groupBy("query_no", "source").agg(_first_of(["score", "rank", "record_id", "record_no"])).select("query_no", "source", "best.*")

    def rated(pairs: DataFrame, fits: Column) -> DataFrame:
        """The pairs that fit, with the points of their titles: worked out once, however many records and authors share them."""
        points = title_points(F.col("right_title"), F.col("left_title"), similarity).alias("title_points")
        return _written(_with_titles(pairs, words).filter(fits).select("left_id", "right_id", points), "title-pairs")

    def known_title(s: str) -> Column:
        return F.max(F.when(F.col("source") == s, F.col("bonus"))).alias(s)

    titles = words.select("title_id", "words", "both", "bits", "chars")
    left = titles.join(asking.groupBy(F.col("left_id").alias("title_id")).agg(F.bit_or(_bit(F.col("name_key"))).alias("names")), "title_id")
    answering = F.bit_or(F.coalesce(_bits(answer_keys), F.lit(0).cast("bigint")).bitwiseOR(_bit(F.lit(ANY_NAME)))).alias("names")
    right = titles.join(known.groupBy(F.col("right_id").alias("title_id")).agg(answering, *map(known_title, SOURCE_ORDER)), "title_id")
    left, right = _written(left, "asked-titles"), _written(right, "known-titles")

    holds = _holds(F.col("left_phrase"), F.col("right_phrase"))
    share = F.lit(NEAR_LENGTH)
    near = _alike(left, right, overlap).union(_holding(left, right, lambda x, y, _: F.least(x, y) >= F.greatest(x, y) * share)).distinct()
    first_best = _written(best(rated(near, holds | _overlaps(F.col("left_phrase"), F.col("right_phrase"), overlap))), "title-best")
    # What a title and a bonus must add up to, beside the points of authors, to reach the best of each source for some query of the title.
    reached = queries.join(first_best.groupBy("query_no").pivot("source", SOURCE_ORDER).agg(F.max("score")), "query_no", "left")
    authors = F.when(F.col("asked_author").isNull(), 0.0).otherwise(AUTHOR_POINTS)
    need = [F.max(authors - F.greatest(F.col(s), F.lit(min_score))).alias(s) for s in SOURCE_ORDER]
    left = left.join(reached.groupBy(F.col("left_id").alias("title_id")).agg(*need), "title_id")

    def could_win(x: Column, y: Column, spare: list[Column]) -> Column:
        within = most_title_points(x, y, similarity) + F.greatest(*spare) >= F.lit(-1e-6)
        return (F.least(x, y) < F.greatest(x, y) * share) & within

    far = best(rated(_holding(left, right, could_win, SOURCE_ORDER), holds))
    found = first_best.unionByName(far).groupBy("query_no", "source").agg(_first_of(["score", "record_no"])).select("query_no", "source", "best.*")
    numbers = queries.select("query_no", F.col("title_lower").alias("best_title"), F.col("asked_author").alias("best_author"))
    found = found.filter(F.col("score") > min_score).join(numbers, "query_no").drop("query_no")
    given = asked.join(found, (F.col("title_lower") == F.col("best_title")) & F.col("author").eqNullSafe(F.col("best_author")))
    return given.select(key, "source", "score", "record_no").join(records.select("record_no", "record"), "record_no").select(key, "source", "score", "record")


def resolve(library: DataFrame, catalogue: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``(key, source, via, record)``: identifiers first, titles where the service's rules allow them."""
    doi = by_doi(library, catalogue, key).withColumn("via", F.lit("doi"))
    isbn = by_isbn(library, catalogue, key).withColumn("via", F.lit("isbn"))
    has_doi = doi_key(*[F.col(c) for c in ("doi", "identifier") if c in library.columns]).isNotNull()
    has_isbn = isbn_key(F.col("isbn")).isNotNull()
    title = by_title(library, catalogue, key, **options).join(
        library.select(key, has_doi.alias("_doi"), has_isbn.alias("_isbn")), key
    )
    source = F.col("source")
    # A document with an identifier is not searched by title, except where that service missed the ISBN.
    by_key = F.when(source.isin(DOI_SOURCES), ~F.col("_doi"))
    allowed = by_key.when(source.isin(ISBN_THEN_TITLE), F.lit(True)).otherwise(~F.col("_isbn"))
    fallback = title.filter(allowed).drop("_doi", "_isbn", "score")
    missed = fallback.join(isbn.select(key, "source"), [key, "source"], "left_anti").withColumn("via", F.lit("title"))
    columns = [key, "source", "via", "record"]
    return doi.select(*columns).unionByName(isbn.select(*columns)).unionByName(missed.select(*columns))


