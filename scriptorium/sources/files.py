"""Files: directory scan, text decoding, JSON metadata with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import clean_text, document_id, extension, file_name, file_stem, page_estimate, reader_for
from scriptorium.schema import METADATA, null_if_empty

BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def list_files(
    spark: SparkSession, directory: str, extensions: list[str] | None = None, recursive: bool = False
) -> DataFrame:
    """``(path, length, modificationTime)`` of the files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    listed = files.select("path", "length", "modificationTime")
    if not recursive:
        listed = listed.filter(F.regexp_replace("path", "/[^/]*$", "") == _qualified(spark, directory))
    if extensions:
        listed = listed.filter(extension(file_name(F.col("path"))).isin([e.lower() for e in extensions]))
    return listed


def _qualified(spark: SparkSession, directory: str) -> str:
    """The folder as the file source spells it, with its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1; line ends become ``\\n``."""
    utf8 = content.cast("string")
    text = F.when(F.is_valid_utf8(utf8), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def text_documents(files: DataFrame) -> DataFrame:
    """Rows of a ``binaryFile`` source, batch or stream, as documents with basic metadata."""
    name = file_name(F.col("path"))
    raw = files.filter(reader_for(name) == "text").select(
        document_id(name, F.col("length"), F.unix_micros("modificationTime")).alias("id"),
        name.alias("filename"),
        F.col("path").alias("filepath"),
        F.col("length").alias("file_size"),
        decode_text(F.col("content")).alias("raw"),
    )
    return raw.select(
        "id", "filename", "filepath", "file_size",
        file_stem(F.col("filename")).alias("title"),
        null_if_empty(F.substring(extension(F.col("filename")), 2, 100)).alias("file_type"),
        page_estimate(F.col("raw")).alias("page_count"),
        clean_text(F.col("raw")).alias("text"),
    )


def unsupported_files(files: DataFrame) -> DataFrame:
    """Quarantine rows for files no reader takes."""
    name = file_name(F.col("path"))
    reason = F.concat(F.lit("unsupported file type "), extension(name))
    return files.filter(reader_for(name).isNull()).select("path", "length", reason.alias("error"))


def read_text_files(spark: SparkSession, directory: str) -> DataFrame:
    return text_documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory))


def _as_field(raw: Column, kind: T.DataType) -> Column:
    """A JSON value as text in the field's type; a plain text is a list of one, values that do not fit are null."""
    if isinstance(kind, T.ArrayType):
        listed = F.from_json(raw, "array<string>")
        return F.when(F.trim(raw).startswith("["), listed).when(raw != "", F.array(raw))
    return raw if isinstance(kind, T.StringType) else F.trim(raw).try_cast(kind)


def read_metadata_json(spark: SparkSession, path: str, key: str = "id", source: str | None = None) -> DataFrame:
    """Metadata lines, one JSON object each, in the library's types.

    Lists may be given as plain text and numbers as text. Fields the library does not know, and values that do
    not fit a field's type, are kept as text in the map ``extra``. Only lines that are no JSON object are
    broken: they keep their raw text in ``_corrupt`` and have no values. ``source`` names a column for the line's file.
    """
    raw = F.from_json("value", "map<string,string>")
    named = [F.col("_metadata.file_path").alias(source)] if source else []
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", raw.alias("_raw"), *named)
    fields = {f.name: _as_field(F.col("_raw")[f.name], f.dataType) for f in METADATA.fields}
    # A key of the object is extra if no field took its value.
    taken = F.array(F.lit(key), *[F.when(v.isNotNull() | (F.col("_raw")[n] == ""), F.lit(n)) for n, v in fields.items()])
    extra = F.map_filter("_raw", lambda k, v: v.isNotNull() & ~F.coalesce(F.array_contains(F.array_compact(taken), k), F.lit(False)))
    return lines.select(
        F.col("_raw")[key].alias(key),
        *[v.alias(n) for n, v in fields.items()],
        extra.alias("extra"),
        F.when(F.col("_raw").isNull(), F.col("value")).alias("_corrupt"),
        *([source] if source else []),
    )


def metadata_with_fallback(index: DataFrame, from_files: DataFrame, key: str = "id") -> DataFrame:
    """Index rows with the file's metadata where there is a readable file, else the index's own."""
    fields = [f for f in METADATA.fieldNames() if f in index.columns and f in from_files.columns]
    readable = from_files.filter(F.col("_corrupt").isNull() & F.col(key).isNotNull())
    # Of several lines with one key the last by content counts, whatever order they are read in.
    values = readable.groupBy(key).agg(F.max_by(F.struct(*fields), F.to_json(F.struct(*fields))).alias("_file"))
    joined = index.join(values, key, "left")
    has_file = F.col("_file").isNotNull()
    return joined.withColumns({f: F.when(has_file, F.col(f"_file.{f}")).otherwise(F.col(f)) for f in fields}).drop("_file")


def read_chunk_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`chunk_files` of a folder of chunk files ``<id>/<name>``.

    Spark's file sources leave files of no bytes out: they have no row, as missing ones, and a look-up of their document finds
    no chunks. The driver lists every file and each is opened by itself: very many of them are better kept packed.
    """
    return chunk_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), schema)


def chunk_files(files: DataFrame, schema: str) -> DataFrame:
    """One row per chunk file ``<id>/<name>``: ``id``, its array ``chunks`` and the raw text of a broken file.

    ``files`` has ``path`` and ``content``, as rows of a ``binaryFile`` source or a table that very many small files are
    packed into. A file that holds no JSON array has no chunks; elements are read by ``schema``. The folder may be named
    ``id=<id>``. Files are read whole, one document's chunks each.
    """
    read = files.select("path", F.col("content").cast("string").alias("value"))
    kind = f"array<struct<{schema}>>"
    listed = F.from_json("value", kind)
    # The parser takes a lone object for an array of one; chunk files hold arrays.
    sound = F.coalesce(listed.isNotNull() & F.col("value").rlike(r"(?s)^\s*\[.*\]\s*$"), F.lit(False))
    return read.select(
        F.url_decode(F.regexp_extract("path", "([^/=]+)/[^/]+$", 1)).alias("id"),
        F.when(sound, listed).otherwise(F.array().cast(kind)).alias("chunks"),
        F.when(~sound, F.col("value")).alias("_corrupt"),
    )


def read_index(spark: SparkSession, path: str, backup: str, key: str = "id") -> DataFrame:
    """The rows of an index folder; a file with a broken line counts as empty and is copied below ``backup``.

    Which lines belong to a broken file is a flag per file, joined back by its name; copies keep the lines and their file.
    """
    metadata = read_metadata_json(spark, path, key, source="file")
    broken = metadata.where("_corrupt IS NOT NULL").select("file").distinct()
    named = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    named.join(broken, "file", "left_semi").write.mode("overwrite").parquet(backup)
    return metadata.join(broken, "file", "left_anti").drop("file", "_corrupt")


def parsed_documents(files: DataFrame, parse, fields: str) -> DataFrame:
    """Files read by a user's ``parse(path, content) -> (text, metadata)``: ``path, length, text, metadata, error``.

    ``fields`` is the schema of the metadata, a mapping; what it does not name is left out. A file whose parser raises or
    gives no text, or a value that does not fit its field, is a row with ``error``; `parsed` and `broken` tell them apart. ``files`` has the columns of
    a ``binaryFile`` source. One file at a time is in Python's memory beside its batch.
    """
    schema = T.StructType([
        *[files.schema[c] for c in ("path", "length")],
        T.StructField("text", T.StringType()), T.StructField("metadata", T.StructType.fromDDL(fields)), T.StructField("error", T.StringType()),
    ])
    names = schema["metadata"].dataType.names

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            rows = [read(*(c.as_py() for c in values), out, pa) for values in zip(*batch.columns, strict=True)]
            yield from pa.Table.from_batches(rows, out).combine_chunks().to_batches()

    def read(path, length, content, out, pa):
        row = {"path": path, "length": length, "text": None, "metadata": None, "error": None}
        try:
            text, metadata = parse(path, content)
            if text is None:
                raise ValueError("no text")
            found = {n: (metadata or {}).get(n) for n in names}
            return pa.RecordBatch.from_pylist([row | {"text": text, "metadata": found}], schema=out)
        except Exception as wrong:  # a user's parser may raise anything; the file goes to quarantine
            return pa.RecordBatch.from_pylist([row | {"error": f"{type(wrong).__name__}: {wrong}"}], schema=out)

    return files.select("path", "length", "content").mapInArrow(run, schema)


def parsed(documents: DataFrame) -> DataFrame:
    return documents.where("error IS NULL").drop("error")


def broken(documents: DataFrame) -> DataFrame:
    """Quarantine rows, like those of `unsupported_files`."""
    return documents.where("error IS NOT NULL").select("path", "length", "error")


def _catalogue_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"{schema}, _corrupt STRING", options).alias("r")).select("r.*")


def read_catalogue_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bulk records of a service, one JSON object per line; `broken_catalogue_lines` has the rest."""
    return _catalogue_lines(spark, path, schema).where("_corrupt IS NULL").drop("_corrupt")


def broken_catalogue_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quarantine: the raw text of the lines that are no record of this schema."""
    return _catalogue_lines(spark, path, schema).where("_corrupt IS NOT NULL").select(F.col("_corrupt").alias("line"))


def _marc_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each record element, whatever its prefix; what is no well-formed record is kept in ``_corrupt``.

    Files are cut at the ends of records, so that a broken one cannot take the rest of its file along. Fields outside
    of a closed record, as in a file that was cut short, count as a broken record.
    """
    pieces = spark.read.option("lineSep", "record>").text(path)
    opening = F.regexp_extract("value", r"(?s)(<(?:\w+:)?record[\s>].*</(?:\w+:)?)$", 1)
    # A record without attributes loses its opening to the cut; the piece after it goes on to the closing tag.
    body = F.when(opening != "", F.concat(opening, F.lit("record>"))).when(
        F.col("value").rlike(r"</(?:\w+:)?$"), F.concat(F.lit("<record>"), F.regexp_replace("value", r"</(?:\w+:)?$", ""), F.lit("</record>"))
    )
    body = F.coalesce(body, F.when(F.col("value").rlike(r"<(?:\w+:)?(?:data|control)field\b"), F.concat(F.lit("<record>"), "value")))
    plain = F.regexp_replace(body, r"(</?)\w+:(?=\w)", "$1")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "true"}
    records = pieces.select(plain.alias("record")).where("record IS NOT NULL")
    return records.select(F.from_xml("record", f"{schema}, _corrupt STRING", options).alias("r")).select("r.*")


def read_marc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """MARCXML collections, one row per record; `broken_marc_records` has those that cannot be parsed."""
    return _marc_records(spark, path, schema).where("_corrupt IS NULL").drop("_corrupt")


def broken_marc_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quarantine: the text of the records that are not well-formed."""
    return _marc_records(spark, path, schema).where("_corrupt IS NOT NULL").select(F.col("_corrupt").alias("record"))
