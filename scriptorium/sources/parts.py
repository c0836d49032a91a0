"""Texts put together from numbered parts: pages, paragraphs, slides, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.extract import let
from scriptorium.functions.text import clean_text, page_estimate, strip

# Parts are joined in runs of this many first, so no task sorts a whole book's parts at once.
RUN = 256
# Fixed values of the part formats.
PART_GAP = "\n\n"
PARAGRAPHS_PER_PAGE = 40
SLIDE_MARK = "--- Folie {} ---"


def _ordered_join(order: str, text: str, gap: str) -> Column:
    listed = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    return F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda s: s[text]), gap))


def _assemble(parts: DataFrame, key: str, no: str, text: Column, gap: str = PART_GAP) -> DataFrame:
    """``(key, raw, parts, first)``: non-null texts joined in order; ``parts`` counts all rows."""
    numbered = parts.select(key, F.col(no).alias("_no"), text.alias("_text"), F.floor(F.col(no) / RUN).alias("_run"))
    runs = numbered.groupBy(key, "_run").agg(
        _ordered_join("_no", "_text", gap).alias("_joined"),
        F.count("*").alias("_n"),
        F.min_by("_text", "_no").alias("_first"),
    )
    return runs.groupBy(key).agg(
        F.coalesce(_ordered_join("_run", "_joined", gap), F.lit("")).alias("raw"),
        F.sum("_n").alias("parts"),
        F.min_by("_first", "_run").alias("first"),
    )


def assemble_pages(pages: DataFrame, key: str, no: str = "no", text: str = "text") -> DataFrame:
    """Pages joined by a blank line, blank pages dropped but counted; page one is kept apart."""
    joined = _assemble(pages, key, no, F.when(strip(F.col(text)) != "", F.col(text)))
    return joined.select(
        key,
        clean_text(F.col("raw")).alias("text"),
        F.col("parts").alias("page_count"),
        F.coalesce("first", F.lit("")).alias("first_page"),
    )


def assemble_paragraphs(paragraphs: DataFrame, key: str, no: str = "no", text: str = "text") -> DataFrame:
    """Paragraphs joined by a blank line, empty ones dropped; forty of all of them make a page."""
    joined = _assemble(paragraphs, key, no, F.when(F.col(text) != "", F.col(text)))
    pages = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("parts") / PARAGRAPHS_PER_PAGE))
    return joined.select(key, clean_text(F.col("raw")).alias("text"), pages.alias("page_count"))


def assemble_slides(shapes: DataFrame, key: str, slide: str = "slide", no: str = "no", text: str = "text") -> DataFrame:
    """Slides counted from 0: a heading line each, then the non-empty shapes line by line."""
    content = F.when(F.col(text) != "", F.col(text))
    bodies = (
        shapes.select(key, F.col(slide).alias("_slide"), F.col(no).alias("_no"), content.alias("_text"))
        .groupBy(key, "_slide")
        .agg(_ordered_join("_no", "_text", "\n").alias("_body"))
    )
    heading = F.format_string(SLIDE_MARK.replace("{}", "%d"), (F.col("_slide") + 1).cast("bigint"))
    joined = _assemble(bodies, key, "_slide", F.concat_ws("\n", heading, F.col("_body")))
    return joined.select(key, clean_text(F.col("raw")).alias("text"), F.col("parts").alias("page_count"))


# Markup without text, and elements that end a line.
SILENT_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>"
LINE_MARKUP = r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|title|article|section|ul|ol|table|blockquote)\s*>"
NAMED_ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&mdash;": "—", "&ndash;": "–", "&amp;": "&",
}


def _numeric_entities(text: Column) -> Column:
    """``&#233;`` and ``&#xe9;`` to their characters."""
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))

    def character(mark: Column) -> Column:
        body = F.regexp_replace(mark, "[&#;]", "")
        number = F.when(body.rlike("^[xX]"), F.conv(F.substring(body, 2, 10), 16, 10)).otherwise(body).cast("bigint")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(mark)

    return F.when(
        F.contains(text, F.lit("&#")), F.aggregate(marks, text, lambda acc, m: F.replace(acc, m, character(m)))
    ).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Markup to plain text: silent parts dropped, block ends become line ends, entities decoded."""
    text = F.regexp_replace(html, SILENT_MARKUP, "")
    text = F.regexp_replace(text, LINE_MARKUP, "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    text = let(text, _numeric_entities)
    for entity, character in NAMED_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def html_documents(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    raw = pages.select(key, html_to_text(F.col(html)).alias("raw"))
    return raw.select(key, clean_text(F.col("raw")).alias("text"), page_estimate(F.col("raw")).alias("page_count"))
