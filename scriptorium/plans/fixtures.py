"""Library tables derived from the supplied parquet tables (rules in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.chunking import fixed_chunks
from scriptorium.operators.index import SearchIndex, build
from scriptorium.session import spread

# Fixed values of the fixture rules.
AUTHOR_POOL = [
    "Ada Lovelace", "Kurt Goedel", "Emmy Noether", "Alan M. Turing", "Grace Hopper",
    "Plato", "Sofia Kowalewskaja", "Carl F. Gauss", "Lise Meitner", "Max Born",
]
SOURCES = ["crossref", "openlib", "k10plus", "googlebooks", "openalex"]


TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _title(text: Column, name: Column) -> Column:
    """The words up to the first other sign; where that is too long for a title, the file's name."""
    words = F.trim(F.regexp_extract(text, r"^[\p{L} ]+", 0))
    return F.when(F.length(words) <= 300, words).otherwise(name)


def _pick(index: Column, values: list[str]) -> Column:
    return F.get(_strings(values), index.cast("int"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.substring(F.md5(F.concat(F.lit("doc"), n, F.lit("_"), F.col("n_chars"))), 1, 12).alias("id"),
        F.concat(F.lit("doc"), n, _pick(n % 5, [".pdf", ".docx", ".epub", ".pptx", ".TXT"])).alias("filename"),
        _title(F.col("text"), F.concat(F.lit("doc"), n)).alias("title"),
        F.when(
            n % 11 != 0, F.slice(_strings(AUTHOR_POOL), (n % 7 + 1).cast("int"), (n % 4 + 1).cast("int"))
        ).alias("author"),
        F.when(n % 13 != 0, 1990 + n % 35).cast("int").alias("year"),
        F.when(n % 3 == 0, F.col("source")).alias("journal"),
        F.when(n % 3 == 1, F.concat(F.lit("Press "), F.col("source"))).alias("publisher"),
        F.when(n % 4 == 0, F.concat(F.lit("10.1234/"), F.col("source"), F.lit("."), n)).alias("doi"),
        F.when(n % 4 == 1, F.concat(F.lit("978"), F.lpad(n.cast("string"), 10, "0"))).alias("isbn"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n_chars") / 2000)).alias("page_count"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=n.cast("int"))).alias("added_at"),
        _pick(n % 4, ["article", "book", "thesis", "other"]).alias("type"),
        (n % 50 + 1).cast("string").alias("volume"),
        F.when(n % 2 == 0, (n % 12 + 1).cast("string")).alias("issue"),
        F.when(n % 5 != 0, F.lit("10-20")).alias("pages"),
        F.when(n % 6 == 1, F.lit("Berlin")).alias("publisher_location"),
        F.col("lang").alias("language"),
        "source",
        F.col("n_chars").alias("file_size"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fixed_chunks(docs, "doc_id")


_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def search_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of `chunks`, written once per application and folder of tables and read by every search after that."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _INDEXES:
        _INDEXES[place] = build(chunks(spark, sf_dir))
    return _INDEXES[place]


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with bibliographic lines put in after their first 60 characters; the rest is kept whole."""
    n, text = F.col("doc_id"), F.col("text")
    lines = [
        F.substring(text, 1, 60),
        _pick(n % 3, ["Authors: Ada Lovelace, Kurt Goedel", "Author: Emmy Noether and Max Born", "by Grace Hopper"]),
        F.when(n % 2 == 0, F.concat(F.lit("("), 1990 + n % 35, F.lit(")"))).otherwise(
            F.concat(F.lit("Published "), 1985 + n % 40)
        ),
        F.when(n % 4 == 0, F.concat(F.lit("doi: 10.1234/"), F.col("source"), F.lit("."), n)).when(
            n % 4 == 1, F.concat(F.lit("ISBN 978-3-16-"), F.lpad(n.cast("string"), 6, "0"), F.lit("-X"))
        ),
        F.get(
            _strings(["Springer", "published by Invented House.", "Journal of Imaginary Results."]),
            (n % 5).cast("int"),
        ),
        F.expr("substring(text, 61)"),
    ]
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.concat_ws("\n", *lines).alias("text")
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate records: every document in each service that covers its language, at three ranks."""
    order = F.col("source_order")
    rank = F.col("rank")
    lib = library(spark, sf_dir)
    covered = (
        (order == 1)
        | ((order == 2) & F.col("language").isin("en", "de"))
        | ((order == 3) & F.col("language").isin("de", "fr"))
        | ((order == 4) & F.col("language").isin("en", "fr", "es"))
        | ((order == 5) & F.col("language").isin("en", "es"))
    )
    first = rank == 1
    title = (
        F.when(first, F.expr("substring(title, 1, greatest(length(title) - source_order, 0))"))
        .when(rank == 2, F.concat("title", F.lit(" (Nachdruck)")))
        .otherwise(F.reverse("title"))
    )
    return (
        lib.withColumn("source_order", F.explode(F.sequence(F.lit(1), F.lit(len(SOURCES)))))
        .withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .filter(covered)
        .select(
            _pick(order - 1, SOURCES).alias("source"),
            "rank",
            "doc_id",
            F.concat(_pick(order - 1, SOURCES), F.lit("-"), "doc_id", F.lit("-"), "rank").alias("record_id"),
            title.alias("title"),
            F.when(rank <= 2, F.col("author")).alias("author"),
            (1990 + F.col("doc_id") % 35 + rank - 1).cast("int").alias("year"),
            F.when(rank <= 2, F.col("publisher")).alias("publisher"),
            F.when(first, F.col("journal")).alias("journal"),
            F.when(first, F.col("doi")).alias("doi"),
            F.when(first, F.col("isbn")).alias("isbn"),
            F.when(first & (F.col("doc_id") % 2 == 0), F.lit("1234-5678")).alias("issn"),
            F.when(first, F.col("page_count")).alias("page_count"),
            F.when(first, F.col("language")).alias("language"),
            F.when(first & F.col("journal").isNotNull(), F.array("journal", F.lit("catalogue"))).alias("keywords"),
            F.lit(None).cast("string").alias("abstract"),
            F.when(first, F.col("type")).alias("type"),
            F.when(first, F.col("doc_id") % 4).alias("cited_by_count"),
            F.lit(None).cast("boolean").alias("is_open_access"),
        )
    )


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("event_type").alias("search_type"), F.col("props").alias("query")
    )


def fetch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("lookup_"), "user_id").alias("key"), "ts")


def cache_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the look-up events: those of errors are empty, each is valid for a day."""
    value = F.when(F.col("event_type") != "error", F.col("props")).otherwise("")
    expiry = (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("expiry")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("lookup_"), "user_id").alias("key"), value.alias("value"), expiry)


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.concat(F.lit("patched "), "doc_id")).alias("title"),
        F.when(F.col("toxic") == 1, F.lit("2000")).alias("year"),
        F.when(F.col("quality") == 0, F.lit(" Rosalind Franklin , Max Born")).alias("authors"),
    )


def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")


def index_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the library an index knows: the documents someone has labelled."""
    return library(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
