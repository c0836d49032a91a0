"""Question context: numbered sources, prompt and bibliography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.cite import NO_YEAR, cite
from scriptorium.functions.text import UNKNOWN, strip
from scriptorium.operators.index import SearchIndex
from scriptorium.operators.search import CONTEXT_CHUNKS, keyword_search
from scriptorium.schema import has_text

# Fixed values of the prompt and answer texts.
INSTRUCTION = (
    "Du bist ein wissenschaftlicher Assistent, der auf Grundlage folgender Quellen Fragen beantwortet. "
    "Verwende ausschließlich die gegebenen Quellen für deine Antwort und füge Kurzzitate in der Form "
    "(Autor, Jahr, S. X) ein."
)
SOURCES_HEADING = "\n\n### Quellen:\n"
QUESTION_HEADING = "\n### Frage:\n"
ANSWER_HEADING = "\n### Antwort:\n"
NO_HITS = "Ich konnte keine relevanten Informationen zu deiner Frage in deiner Literatursammlung finden."
UNKNOWN_DOCUMENT = "Unbekanntes Dokument"
# Characters of a source and names of its authors that a prompt shows.
PROMPT_CHARS = 1000
PROMPT_AUTHORS = 3


def question_context(
    library: DataFrame,
    chunks: DataFrame | SearchIndex,
    question: str,
    filters: dict | None = None,
    k: int = CONTEXT_CHUNKS,
    key: str = "doc_id",
) -> DataFrame:
    """The best ``k`` chunks with defaults for missing metadata, numbered from 1 in hit order."""
    hits = keyword_search(library, chunks, question, filters, k, key)
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("relevance")).alias("_by"), "added_at", "id", "chunk_id", key, "relevance", "text",
                F.coalesce("author", F.array(F.lit(UNKNOWN))).alias("author"),
                F.coalesce(F.col("year").cast("string"), F.lit(NO_YEAR)).alias("year"),
                F.coalesce("title", F.lit(UNKNOWN_DOCUMENT)).alias("title"),
            )
        )
    )
    # At most k rows meet here.
    return (
        hits.groupBy()
        .agg(ordered.alias("hits"))
        .select(F.posexplode("hits").alias("pos", "hit"))
        .select((F.col("pos") + 1).alias("source_no"), "hit.*", F.lit("").alias("page"))
        .drop("_by")
    )


def prompt(
    context: DataFrame, question: str, max_chars: int | None = PROMPT_CHARS, max_authors: int | None = PROMPT_AUTHORS
) -> DataFrame:
    """One row with the prompt text, or with the fixed message when nothing was found.

    Texts beyond ``max_chars`` and author lists beyond ``max_authors`` are shortened visibly; ``None`` shows all.

    Sources without text keep their number but are left out.
    """
    shown = F.array_join("author", ", ")
    if max_authors is not None:
        some = F.array_join(F.slice("author", 1, max_authors), ", ")
        shown = F.concat(some, F.when(F.size("author") > max_authors, " et al.").otherwise(""))
    head = F.concat(
        F.lit("["), F.col("source_no"), F.lit("] "),
        F.when(F.size("author") > 0, shown).otherwise(""),
        F.when(has_text(F.col("year")), F.concat(F.lit(" ("), "year", F.lit(")"))).otherwise(""),
        F.when(has_text(F.col("title")), F.concat(F.lit(": "), "title")).otherwise(""),
    )
    body = strip(F.col("text"))
    cut = body
    if max_chars is not None:
        short = F.concat(F.substring(body, 1, max_chars - 3), F.lit("..."))
        cut = F.when(F.length(body) > max_chars, short).otherwise(body)
    item = F.when(has_text(F.col("text")), F.concat(head, F.lit("\n"), cut, F.lit("\n")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("source_no", item.alias("item")))), lambda s: s["item"])
    parts = F.concat(
        F.array(F.lit(INSTRUCTION), F.lit(SOURCES_HEADING)),
        F.filter("items", lambda i: i.isNotNull()),
        F.array(F.lit(QUESTION_HEADING + question), F.lit(ANSWER_HEADING)),
    )
    n = F.col("n_sources")
    return (
        context.groupBy()
        .agg(F.count("*").alias("n_sources"), listed.alias("items"))
        .select("n_sources", F.when(n > 0, F.array_join(parts, "\n")).alias("prompt"), F.when(n == 0, NO_HITS).alias("answer"))
    )


def bibliography(context: DataFrame, library: DataFrame, style: str = "apa", key: str = "doc_id") -> DataFrame:
    """The distinct documents of a context, cited, in order of their first hit."""
    used = context.groupBy(key).agg(F.min("source_no").alias("first_hit"))
    return library.join(used, key).select("first_hit", key, "id", cite(style).alias("citation"))
