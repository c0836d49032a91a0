"""Rule-based chunk annotations: tokens, entities, keywords, summary, sentiment.

These follow the shape and limits of model-based annotations, not their output: there is no statistical
model behind them. Texts are read whole; ``window`` limits a rule to the first so many characters (customary:
``ANALYSIS_CHARS``).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import fixed_values as v
from scriptorium.functions.extract import let
from scriptorium.functions.text import strip

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}_]+"
# A token that is no word.
SIGN = r"[^\p{L}\p{N}_\s]"
SENTENCE = r"[^.!?]+[.!?]?"
# Entity types and the patterns that find them, in the order a summary counts them.
ENTITY_PATTERNS = {
    "NAME": r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+",
    "DATE": r"(?:19|20)[0-9][0-9]",
    "DOI": r"10\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "URL": r"https?://[^\s<>]+",
    "IP": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}
# One of these stands in every text that holds a mention of the type; names have no such sign.
ENTITY_HINTS = {"DATE": ["19", "20"], "DOI": ["10."], "EMAIL": ["@"], "URL": ["://"], "IP": [f"{digit}." for digit in range(10)]}
STOP_WORDS = sorted(set(v.GERMAN_WORDS) | set(v.ENGLISH_WORDS))
MAX_KEYWORDS = 20
MIN_KEYWORD_CHARS = 4
SUMMARY_CHARS = 280


def _analysed(text: Column, window: int | None) -> Column:
    return text if window is None else F.substring(text, 1, window)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _holds(text: Column, hints: list[str]) -> Column:
    return functools.reduce(operator.or_, [F.contains(text, F.lit(hint)) for hint in hints])


def lower_words(text: Column, window: int | None = None) -> Column:
    """All words in lower case, in order: what keywords and sentiment read, and what a token count can use."""
    return _all(F.lower(_analysed(text, window)), WORD)


def token_count(text: Column, window: int | None = None, words: Column | None = None) -> Column:
    """Number of words and other signs; ``words``, the text's ``lower_words``, spares cutting it again."""

    def count(head: Column) -> Column:
        tokens = F.size(_all(head, TOKEN))
        if words is None:
            return tokens
        # The one letter whose lower case is a letter and a sign.
        return F.when(F.contains(head, F.lit("\u0130")), tokens).otherwise(F.size(words) + F.size(_all(head, SIGN)))

    return count(_analysed(text, window))


def entities(text: Column, window: int | None = None) -> Column:
    """Map of entity type to its distinct mentions in order of appearance; types without mention are absent."""

    def mentions(head: Column, kind: str) -> Column:
        found = F.array_distinct(_all(head, ENTITY_PATTERNS[kind]))
        if kind not in ENTITY_HINTS:
            return found
        # Texts without the hint are not searched by pattern.
        return F.when(~_holds(head, ENTITY_HINTS[kind]), F.array().cast("array<string>")).otherwise(found)

    def find(head: Column) -> Column:
        found = [F.struct(F.lit(kind).alias("key"), mentions(head, kind).alias("value")) for kind in ENTITY_PATTERNS]
        return F.map_from_entries(F.filter(F.array(*found), lambda e: F.size(e["value"]) > 0))

    return let(_analysed(text, window), find)


def keywords(
    text: Column, window: int | None = None, most: int | None = MAX_KEYWORDS, words: Column | None = None
) -> Column:
    """First ``most`` distinct words of four or more letters that are no stop words; ``None`` takes all."""
    tokens = lower_words(text, window) if words is None else words
    kept = F.filter(tokens, lambda w: (F.length(w) >= MIN_KEYWORD_CHARS) & ~w.isin(STOP_WORDS))
    return F.array_distinct(kept) if most is None else F.slice(F.array_distinct(kept), 1, most)


def summary(text: Column, window: int | None = None, most: int = SUMMARY_CHARS) -> Column:
    """First sentence, and the entity-richest other one when both fit ``most`` characters."""
    any_entity = "|".join(f"(?:{p})" for p in ENTITY_PATTERNS.values())
    hints = [hint for listed in ENTITY_HINTS.values() for hint in listed]

    def mentions(sentence: Column) -> Column:
        # Without a hint of the other types only names can be found.
        return F.size(F.when(_holds(sentence, hints), _all(sentence, any_entity)).otherwise(_all(sentence, ENTITY_PATTERNS["NAME"])))

    def choose(sentences: Column) -> Column:
        first = F.get(sentences, F.lit(0))
        counted = F.transform(
            F.filter(sentences, lambda s: s != first),
            lambda s: F.struct(mentions(s).alias("n"), s.alias("s")),
        )
        # Beside a first sentence that fills the summary there is no need to look for another.
        richest = F.when(F.length(first) < most, F.array_max(F.filter(counted, lambda c: c["n"] > 0))["s"])

        def beside(other: Column) -> Column:
            fits = F.coalesce(F.length(first) + F.length(other) <= most, F.lit(False))
            return F.coalesce(F.when(fits, F.concat_ws(" ", first, other)).otherwise(first), F.lit(""))

        return let(richest, beside)

    sentences = F.filter(F.transform(_all(_analysed(text, window), SENTENCE), strip), lambda s: s != "")
    return let(sentences, choose)


def sentiment(text: Column, window: int | None = None, words: Column | None = None) -> Column:
    """Shares of listed positive and negative words among the words that are no stop words."""

    def share(tokens: Column, listed: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(listed))) / F.size(tokens)

    def rounded(both: Column) -> Column:
        return F.struct(
            F.round(both["positive"], 3).alias("positive"),
            F.round(both["negative"], 3).alias("negative"),
            F.round(F.lit(1.0) - (both["positive"] + both["negative"]), 3).alias("neutral"),
        )

    def judge(tokens: Column) -> Column:
        both = F.struct(share(tokens, v.POSITIVE_WORDS).alias("positive"), share(tokens, v.NEGATIVE_WORDS).alias("negative"))
        none = F.struct(F.lit(0.0).alias("positive"), F.lit(0.0).alias("negative"), F.lit(1.0).alias("neutral"))
        return F.when(F.size(tokens) == 0, none).otherwise(let(both, rounded))

    tokens = F.filter(lower_words(text, window) if words is None else words, lambda w: ~w.isin(STOP_WORDS))
    return let(tokens, judge)
