"""Keyword search over chunks."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.extract import let
from scriptorium.functions.text import words
from scriptorium.operators import index as search_index
from scriptorium.operators.filters import search_filter
from scriptorium.operators.listing import source_label
from scriptorium.schema import present
from scriptorium.session import broadcast_if_small, cut_lineage

# Default number of hits and of context chunks.
MAX_RESULTS = 10
CONTEXT_CHUNKS = 5
# Hits joined back by broadcast are bounded by the caller's ``k``; above this the planner decides.
BROADCAST_HITS = 10_000
# Query words that a batch search treats by patterns, so there are up to two to this power of these.
COMMON_TERMS = 10
# Pairs of queries and chunks up to which a batch search lets every word pair them.
PAIRS = 20_000_000
# Pairs of queries and chunks that one task of a batch search may have to hold, so there are more tasks for more chunks.
PAIRS_A_TASK = 4_000_000
# Query words that a batch search looks for in the chunks' texts: those that the most different words hold.
SCANNED_TERMS = 32
# One in so many chunks is scored first; every query's k-th best among these bounds what may be among its best of all.
BOUND_SHARE = 64


def relevance(text: Column, query: str) -> Column:
    """Share of the query's words that occur in the text as substrings, case ignored."""
    terms = Counter(query.lower().split())
    if not terms:
        return F.lit(0.0)
    lowered = F.lower(text)
    found = F.lit(0)
    for term, times in terms.items():
        found = found + F.when(F.contains(lowered, F.lit(term)), times).otherwise(0)
    return found.cast("double") / float(sum(terms.values()))


def _bounded(df: DataFrame, k: int) -> DataFrame:
    return F.broadcast(df) if k <= BROADCAST_HITS else df


def keyword_search(
    library: DataFrame,
    chunks: DataFrame | search_index.SearchIndex,
    query: str,
    filters: dict | None = None,
    k: int = MAX_RESULTS,
    key: str = "doc_id",
) -> DataFrame:
    """The ``k`` most relevant chunks of the documents that pass the filters.

    With a search index only postings of words that hold a query word, and texts of the winning documents are read. Without
    one all texts are scanned, and again for the winners. Only ``(key, chunk_id, relevance)`` is shuffled and ranked.
    """
    indexed = isinstance(chunks, search_index.SearchIndex)
    if indexed:
        scored = search_index.scores(chunks, query)
    else:
        scored = chunks.select(key, "chunk_id", relevance(F.col("text"), query).alias("relevance"))
    allowed = library.filter(search_filter(filters)).select(key, "id", "added_at")
    order = [F.desc("relevance"), F.col("added_at"), F.col("id"), F.col("chunk_id")]
    winners = scored.filter("relevance > 0").join(allowed, key).orderBy(*order).limit(k)
    metadata = library.drop("id", "added_at", "text")
    if indexed and k <= BROADCAST_HITS:
        # At most k rows: their keys decide what is read of texts and metadata.
        winners = library.sparkSession.createDataFrame(winners.collect(), winners.schema)
        keys = [r[0] for r in winners.select(key).distinct().collect()]
        all_texts, metadata = search_index.texts_of(chunks, keys), metadata.where(F.col(key).isin(keys))
    else:
        all_texts = chunks.table("texts") if indexed else chunks.select(key, "chunk_id", "text")
    texts = all_texts.join(_bounded(winners, k), [key, "chunk_id"])
    hits = metadata.join(_bounded(texts, k), key)
    return hits.withColumns(
        {"source_label": source_label(), "relevance_pct": F.round(F.col("relevance") * 100).cast("bigint")}
    ).orderBy(*order)


def semantic_search(library: DataFrame, chunks: DataFrame, query: str, **options) -> DataFrame:
    """Same answer as the keyword search, which is all the search mode of that name does."""
    return keyword_search(library, chunks, query, **options)


def sort_hits(hits: DataFrame, by: str = "relevance") -> DataFrame:
    """Reorder the chosen hits by year; the choice of hits stays as it is."""
    year = F.coalesce(F.col("year").try_cast("int"), F.lit(0))
    ties = [F.desc("relevance"), F.col("added_at"), F.col("id"), F.col("chunk_id")]
    if by == "date-desc":
        return hits.orderBy(year.desc(), *ties)
    if by == "date-asc":
        return hits.orderBy(year.asc(), *ties)
    return hits.orderBy(*ties)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, times, n_terms)`` of a query table; repeated words count repeatedly."""
    terms = F.col("terms")
    return (
        queries.select("query_id", words(F.lower("query")).alias("terms"))
        .select("query_id", F.size(terms).alias("n_terms"), F.explode(terms).alias("term"))
        .groupBy("query_id", "n_terms", "term")
        .agg(F.count("*").alias("times"))
    )


def words_holding(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """``(word, term)`` pairs where the word contains the term.

    A term occurs in a word only if the term's first three characters are one of the word's n-grams, so an
    equality join on that anchor finds every pair; it runs on distinct words, not on the texts.
    """
    sizes = F.array(F.lit(1), F.lit(2), F.lit(3))
    grams = F.array_distinct(
        F.flatten(
            F.transform(
                sizes,
                lambda n: F.when(
                    F.length("word") >= n,
                    F.transform(
                        F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1))),
                        lambda at: F.substring(F.col("word"), at, n),
                    ),
                ).otherwise(F.array().cast("array<string>")),
            )
        )
    )
    anchored = terms.select("term", F.substring("term", 1, 3).alias("anchor"))
    return (
        vocabulary.select("word", F.explode(grams).alias("anchor"))
        .join(anchored, "anchor")
        .filter(F.contains("word", F.col("term")))
        .select("word", "term")
    )


def batch_search(
    chunks: DataFrame, queries: DataFrame, k: int = MAX_RESULTS, mode: str = "substring", key: str = "doc_id", pairs: int = PAIRS
) -> DataFrame:
    """The ``k`` best chunks for every query of a table, scored like ``keyword_search``.

    Query words hold no blanks, so a chunk contains a query word exactly when one of the chunk's
    blank-separated words does. That turns the search into equality joins on words: distinct words meet
    the distinct query words once, then the chunk's words look the result up. Where all queries and chunks make more
    than ``pairs`` pairs, `best_chunks` bounds what common words pair; the result is the same.
    """
    postings = search_index.chunk_words(chunks, key)
    # Query words travel as numbers.
    named = query_terms(queries)
    wanted = cut_lineage(named.select("term").distinct().withColumn("no", F.monotonically_increasing_id()), "search-terms")
    terms = cut_lineage(named.join(wanted, "term").select("query_id", "n_terms", F.col("no").alias("term"), "times"), "search-queries")
    if mode == "word":
        meant = wanted.select(F.col("term").alias("word"), F.array("no").alias("meant"))
    else:
        vocabulary = cut_lineage(postings.select("word").distinct(), "search-vocabulary")
        scanned = _held_by_most(vocabulary, wanted)
        listed = wanted.where(~F.col("no").isin([r.no for r in scanned]))
        found = words_holding(vocabulary, listed).join(broadcast_if_small(listed), "term")
        meant = found.groupBy("word").agg(F.collect_list("no").alias("meant"))
    # Written and measured: broadcast when small, so that a chunk's words need not travel; else a shuffled
    # join, kept from broadcasting the words by a hint, because their number is easily underestimated.
    meant = broadcast_if_small(cut_lineage(meant, "search-words"))
    # One row per chunk with the query words it holds.
    held = postings.hint("merge").join(meant, "word").select(key, "chunk_id", "meant")
    if mode != "word" and scanned:
        # The text is lower-cased once, not once per word.
        tests = lambda text: F.array(*[F.when(F.contains(text, F.lit(r.term)), F.lit(r.no).cast("long")) for r in scanned])
        seen = let(F.lower("text"), lambda text: F.filter(tests(text), lambda no: no.isNotNull()))
        held = held.unionByName(chunks.where("text IS NOT NULL").select(key, "chunk_id", seen.alias("meant")))
    holding = (
        held.groupBy(key, "chunk_id")
        .agg(F.array_distinct(F.flatten(F.collect_list("meant"))).alias("held"))
    )
    most = chunks.select(key).count() * queries.count()
    if most > pairs:
        return best_chunks(cut_lineage(holding, "search-holding"), terms, k, key, math.ceil(most / PAIRS_A_TASK))
    # The rows stay where the counting per chunk puts them: counting per query and chunk needs no further shuffle.
    hits = (
        holding.select(key, "chunk_id", F.explode("held").alias("term"))
        .join(terms, "term")
        .groupBy("query_id", "n_terms", key, "chunk_id")
        .agg(F.sum("times").alias("matched"))
    )
    return _leaders(hits.select("query_id", key, "chunk_id", _share()), k, key)


def _held_by_most(vocabulary: DataFrame, wanted: DataFrame) -> list:
    """The query words, ``SCANNED_TERMS`` at most, that most words seem to hold, so that a list of these words would be long.

    Short ones are held by most; which of them are chosen decides the time a search takes and not its result.
    """
    some = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(BOUND_SHARE)) == 0)
    by_words = words_holding(some, wanted).groupBy("term").agg(F.count("*").alias("n_words"))
    return by_words.join(wanted, "term").orderBy(F.desc("n_words"), "term").limit(SCANNED_TERMS).collect()


def _share() -> Column:
    return (F.col("matched").cast("double") / F.col("n_terms")).alias("relevance")


def _leaders(hits: DataFrame, k: int, key: str) -> DataFrame:
    """The first ``k`` rows of each query with their ``rank``; each task cuts its own rows before they are shuffled."""
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), key, "chunk_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def common_terms(holding: DataFrame, terms: DataFrame, k: int, most: int = COMMON_TERMS) -> list:
    """The terms, ``most`` of them at most, that would pair the most (query, chunk) rows, if these are more than ``k`` for each query."""
    chunks_of = holding.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("chunks"))
    queries_of = terms.groupBy("term").agg(F.count("*").alias("queries"))
    heavy = chunks_of.join(queries_of, "term").where(F.col("chunks") > k)
    return [r.term for r in heavy.orderBy(F.desc(F.col("chunks") * F.col("queries")), "term").limit(most).collect()]


def best_chunks(holding: DataFrame, terms: DataFrame, k: int, key: str = "doc_id", tasks: int = 1) -> DataFrame:
    """The ``k`` best chunks of each query; ``holding``: key, chunk_id and the query words ``held`` or their numbers, written.

    Words that many queries ask for and many chunks hold would pair nearly all of both. A chunk's set of such common words is
    its pattern, and chunks of one pattern score alike by them for every query. A chunk that holds none of a query's
    other words can only be among its best k if it is among the first k of its pattern by (key, chunk_id): those before
    it score no less. So pairs are made over the other words, with the common ones counted in from the pattern, and
    over the first k of each pattern: at most k * queries * 2 ** COMMON_TERMS rows, whatever the number of chunks.

    Pairs are counted in ``tasks`` tasks or more. The k-th best of a share of the chunks is no better than the k-th best of
    all, so pairs below it are dropped before they are ranked.
    """
    common = common_terms(holding, terms, k)
    bit = F.lit(0)
    for i, term in enumerate(common):
        bit = bit + F.when(F.array_contains("held", term), 1 << i).otherwise(0)
    asked = F.array(*[F.lit(t) for t in common]).cast(holding.schema["held"].dataType)
    chunks = holding.select(key, "chunk_id", F.array_except("held", asked).alias("rare"), bit.cast("int").alias("pattern"))
    # What each common word counts for a query, in the order of the bits.
    counts = [F.sum(F.when(F.col("term") == term, F.col("times")).otherwise(0)).cast("int").alias(f"common_{i}") for i, term in enumerate(common)]
    weights = terms.groupBy("query_id", "n_terms").agg(F.count("*").alias("n_different"), *counts)

    def from_pattern() -> Column:
        total = F.lit(0)
        for i in range(len(common)):
            total = total + F.when(F.col("pattern").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"common_{i}")).otherwise(0)
        return total

    def by_rare(some: DataFrame) -> DataFrame:
        return (
            some.select(key, "chunk_id", "pattern", F.explode("rare").alias("term"))
            .join(terms.select("query_id", "term", "times"), "term")
            .groupBy("query_id", key, "chunk_id")
            .agg(F.sum("times").alias("rare_times"), F.max("pattern").alias("pattern"))
            .join(weights, "query_id")
            .select("query_id", key, "chunk_id", "n_terms", (F.col("rare_times") + from_pattern()).alias("matched"))
        )

    # Dealt by chunk once, while a chunk is one row: counting per query and chunk needs no further shuffle.
    parts = max(tasks, holding.sparkSession.sparkContext.defaultParallelism)
    share = F.pmod(F.xxhash64(key, "chunk_id"), F.lit(BOUND_SHARE)) == 0
    scored_first = by_rare(chunks.where(share)).select("query_id", key, "chunk_id", "matched", _share())
    least = _leaders(scored_first, k, key).where(F.col("rank") == k).select("query_id", F.col("matched").alias("least"))
    least = broadcast_if_small(cut_lineage(least, "search-bounds"))
    pairs = by_rare(chunks.repartition(parts, key, "chunk_id")).join(least, "query_id", "left")
    pairs = pairs.where(F.col("matched") >= F.coalesce("least", F.lit(0))).drop("least")
    first = Window.partitionBy("pattern").orderBy(key, "chunk_id")
    leading = chunks.where("pattern <> 0").select(key, "chunk_id", "pattern").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    # Patterns meet queries by their words, an equality join.
    bits = F.filter(F.transform(asked, lambda t, i: F.when(F.getbit(F.col("pattern"), i) == 1, t)), lambda t: t.isNotNull())
    by_common = (
        leading.select(key, "chunk_id", F.explode(bits).alias("term"))
        .join(terms, "term")
        .groupBy("query_id", "n_terms", key, "chunk_id")
        .agg(F.sum("times").alias("matched"))
        .select("query_id", key, "chunk_id", "n_terms", "matched")
    )
    hits = _leaders(pairs.select("query_id", key, "chunk_id", _share()), k, key)
    if not common:
        return hits
    # A chunk met both ways counts with all its words, the larger number. What the cut of the pairs by other words has
    # dropped has k better ones before it, so it may come back with the common words alone and still not be among the first.
    both = hits.drop("rank").unionByName(by_common.select("query_id", key, "chunk_id", _share()))
    return _leaders(both.groupBy("query_id", key, "chunk_id").agg(F.max("relevance").alias("relevance")), k, key)


def year_facet(library: DataFrame) -> DataFrame:
    return library.filter(present("year")).select("year").distinct().orderBy("year")
