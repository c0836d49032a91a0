"""Files, sinks and streams: batch equals stream, replays change nothing, broken input falls back."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import lookups
from scriptorium.sources import files, parts, tables
from scriptorium.streaming import ingest, lookup_cache
from scriptorium.streaming import stats as running


def some_files(folder):
    folder.mkdir()
    (folder / "a.txt").write_bytes("Grüße  aus\r\nBonn".encode())
    (folder / "b.MD").write_bytes("Grüße".encode("latin-1"))
    (folder / "c.png").write_bytes(b"\x89PNG")
    (folder / "sub").mkdir()
    (folder / "sub" / "d.csv").write_text("x" * 4100)
    return str(folder)


def test_scan(spark, tmp_path):
    folder = some_files(tmp_path / "in")

    def names(df):
        return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())

    assert names(files.list_files(spark, folder)) == ["a.txt", "b.MD", "c.png"]
    assert names(files.list_files(spark, folder, [".MD", ".csv"], recursive=True)) == ["b.MD", "d.csv"]


def test_text_files(spark, tmp_path):
    rows = {r.filename: r for r in files.read_text_files(spark, some_files(tmp_path / "in")).collect()}
    assert set(rows) == {"a.txt", "b.MD", "d.csv"}
    assert rows["a.txt"].text == "Grüße aus\nBonn"
    assert (rows["b.MD"].text, rows["b.MD"].title, rows["b.MD"].file_type) == ("Grüße", "b", "md")
    assert rows["d.csv"].page_count == 2
    left = files.unsupported_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in")))
    assert [r.error for r in left.collect()] == ["unsupported file type .png"]


def test_broken_metadata_falls_back_to_the_index(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"id": "a", "title": "File A"}\n{"id": "b", "title": \n')
    index = spark.createDataFrame([("a", "Index A"), ("b", "Index B"), ("c", "Index C")], "id STRING, title STRING")
    got = files.metadata_with_fallback(index, files.read_metadata_json(spark, str(tmp_path / "m.json")))
    assert [r.title for r in got.orderBy("id").collect()] == ["File A", "Index B", "Index C"]


def test_metadata_lines_in_all_spellings(spark, tmp_path):
    lines = [
        '{"id": "a", "title": "File A", "author": "Ada", "year": "1999", "shelf": "B 7", "page_count": 12}',
        '{"id": "b", "author": ["Ada", "Kurt"], "year": 2001, "is_open_access": true, "tags": ["x", "y"]}',
        '{"id": "c", "year": "about 1850", "title": "", "author": []}',
        "no json", "",
    ]
    (tmp_path / "m.json").write_text("\n".join(lines))
    read = files.read_metadata_json(spark, str(tmp_path / "m.json"))
    rows = {r.id: r for r in read.collect()}
    assert (rows["a"].author, rows["a"].year, rows["a"].page_count, rows["a"].extra) == (["Ada"], 1999, 12, {"shelf": "B 7"})
    assert (rows["b"].author, rows["b"].year, rows["b"].is_open_access, rows["b"].extra) == (["Ada", "Kurt"], 2001, True, {"tags": '["x","y"]'})
    assert (rows["c"].year, rows["c"].title, rows["c"].author, rows["c"].extra) == (None, "", [], {"year": "about 1850"})
    assert rows[None]._corrupt == "no json" and len(rows) == 4
    index = spark.createDataFrame([("a", ["Index"], "I")], "id STRING, author ARRAY<STRING>, title STRING")
    for asked in (index, index.drop("author")):  # the answer does not depend on what is read
        assert files.metadata_with_fallback(asked, read).first().title == "File A"


def test_bulk_catalogue_lines_and_quarantine(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"title": "A", "n": 1}\n{"title": \n{"title": "B", "n": 2}\n')
    schema, path = "title STRING, n INT", str(tmp_path / "c.json")
    assert [tuple(r) for r in files.read_catalogue_json(spark, path, schema).orderBy("n").collect()] == [("A", 1), ("B", 2)]
    assert [r.line for r in files.broken_catalogue_lines(spark, path, schema).collect()] == ['{"title": ']


def test_nested_folder_of_the_same_name_is_not_listed(spark, tmp_path):
    inner = tmp_path / "in" / "x" / "in"
    inner.mkdir(parents=True)
    (inner / "deep.txt").write_text("deep")
    (tmp_path / "in" / "top.txt").write_text("top")
    listed = files.list_files(spark, str(tmp_path / "in")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in listed] == ["top.txt"]


def test_log_of_full_library_rows(spark, tmp_path):
    root, table = str(tmp_path / "log"), str(tmp_path / "table")
    schema = "id STRING, title STRING, filename STRING, added_at TIMESTAMP_NTZ, no INT"
    time = dt.datetime(2020, 1, 1)
    first = spark.createDataFrame([("a", "old", "f", time, 1), ("a", "older", "f", time, 0)], schema)
    ingest.log_batch(root, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "no")(first, 0)
    second = spark.createDataFrame([("a", "new", "g", None, 1), ("b", "one", "h", None, 1)], schema)
    ingest.log_batch(root, F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), "no")(second, 1)
    ingest.publish(spark, root, table)
    rows = {r.id: r for r in tables.read_table(spark, table).collect()}
    assert (rows["a"].title, rows["a"].filename, rows["a"].added_at) == ("new", "f", time)
    assert (rows["b"].title, rows["b"].added_at, rows["b"].updated_at) == ("one", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2))


def test_metadata_export_reads_back(spark, tmp_path):
    library = spark.createDataFrame([("a", "T", ["Ada"], 1999)], "id STRING, title STRING, author ARRAY<STRING>, year INT")
    tables.export_metadata(library, str(tmp_path / "out"))
    row = files.read_metadata_json(spark, str(tmp_path / "out")).first()
    assert (row.id, row.title, row.author, row.year, row.extra) == ("a", "T", ["Ada"], 1999, {})


def test_parts_beyond_one_run_keep_their_order(spark):
    rows = spark.range(1000).select(F.lit("k").alias("key"), F.col("id").alias("no"), F.concat(F.lit("p"), "id").alias("text"))
    done = parts.assemble_pages(rows.orderBy(F.rand(3)), "key").first()
    assert done.page_count == 1000
    assert done.text == "".join(f"p{i}" for i in range(1000))
    assert done.first_page == "p0"


def test_blank_pages_count_and_blank_first_page_is_empty(spark):
    rows = spark.createDataFrame([("k", 0, "  \n"), ("k", 1, "body")], "key STRING, no INT, text STRING")
    done = parts.assemble_pages(rows, "key").first()
    assert (done.text, done.page_count, done.first_page) == ("body", 2, "")


def test_slides(spark):
    rows = spark.createDataFrame([("k", 0, 0, "A"), ("k", 0, 1, ""), ("k", 1, 0, None)], "key STRING, slide INT, no INT, text STRING")
    done = parts.assemble_slides(rows, "key").first()
    # Cleaning swallows the blank line between slides.
    assert done.text == "--- Folie 1 ---\nA--- Folie 2 ---"
    assert done.page_count == 2


def test_markup(value):
    html = "<p>a &lt;b&gt; &#233;&#xE9;&#0;</p><script>x</script><!-- y --><br/>c&amp;lt;"
    assert value(parts.html_to_text(F.col("text")), row=(html,)) == "a <b> éé&#0;\n\nc&lt;"


def test_results_round_trip_and_swap(spark, tmp_path):
    root = str(tmp_path / "out")
    text = spark.createDataFrame([("a", "full")], "id STRING, text STRING")
    lib = spark.createDataFrame([("a", "T", ["X"])], "id STRING, title STRING, author ARRAY<STRING>")
    chunk = spark.createDataFrame([("a", 0, "c")], "id STRING, chunk_id INT, text STRING")
    assert tables.read_results(spark, root) is None
    first = tables.write_results(text, lib, chunk, root)
    got = tables.read_results(spark, root)
    assert got["library"].collect() == lib.collect() and got["chunks"].collect() == chunk.collect() and got["fulltext"].collect() == text.collect()
    assert got["status"].first().status == "complete"
    # A reader that began before the second write goes on with the four tables of the first.
    second = tables.write_results(text.withColumn("text", F.lit("more")), lib.withColumn("title", F.lit("U")), chunk, root)
    assert all(first[name] != second[name] for name in tables.RESULTS)
    old, new = tables.read_results(spark, root, first), tables.read_results(spark, root)
    assert (old["library"].first().title, old["fulltext"].first().text) == ("T", "full")
    assert (new["library"].first().title, new["fulltext"].first().text) == ("U", "more")
    assert tables.vacuum_results(spark, root, keep=[first]) == []
    assert len(tables.vacuum_results(spark, root)) == 4
    assert tables.read_results(spark, root)["library"].first().title == "U"
    assert not (tmp_path / "out" / "library" / first["library"]).exists()


def test_a_write_that_fails_leaves_the_old_results(spark, tmp_path):
    root = str(tmp_path / "out")
    lib = spark.createDataFrame([("a", "T")], "id STRING, title STRING")
    chunk = spark.createDataFrame([("a", 0, "c")], "id STRING, chunk_id INT, text STRING")
    tables.write_results(chunk.select("id", "text"), lib, chunk, root)
    broken = chunk.withColumn("chunk_id", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        tables.write_results(chunk.select("id", "text"), lib.withColumn("title", F.lit("U")), broken, root)
    got = tables.read_results(spark, root)
    assert got["library"].first().title == "T" and got["chunks"].count() == 1
    assert len(tables.vacuum_results(spark, root)) >= 2 and tables.read_results(spark, root)["library"].first().title == "T"


def test_table_swap(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.read_table(spark, root) is None
    tables.replace_table(spark.range(1), root)
    before = tables.current_version(spark, root)
    tables.replace_table(tables.read_table(spark, root).union(spark.range(1)), root)
    assert tables.current_version(spark, root) != before
    assert (tables.read_table(spark, root).count(), spark.read.parquet(before).count()) == (2, 1)


def test_stream_equals_batch(spark, tmp_path):
    folder = some_files(tmp_path / "in")
    stream = ingest.documents(ingest.stream_files(spark, folder, files_per_batch=1))
    ingest.run(stream, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    ingest.run(stream, str(tmp_path / "sink"), str(tmp_path / "cp")).awaitTermination()
    batch = ingest.documents(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))
    got = spark.read.parquet(str(tmp_path / "sink")).orderBy("id").collect()
    assert got == batch.orderBy("id").collect() and len(got) == 3


def test_replayed_batches_change_nothing(spark, tmp_path):
    root = str(tmp_path / "log")

    def at(hour):
        return ingest.log_batch(root, F.lit(f"2024-01-01 {hour:02d}:00:00").cast("timestamp_ntz"))

    columns = "id STRING, filename STRING, title STRING"
    first = spark.createDataFrame([("a", "a.txt", "A"), ("a", "a.txt", "A"), ("b", "b.txt", "B")], columns)
    second = spark.createDataFrame([("a", "copy.txt", "A2")], columns)

    def state():
        return [tuple(map(str, r)) for r in ingest.library_from_log(spark, root).orderBy("id").collect()]

    at(1)(first, 0)
    at(2)(second, 1)
    want = [
        ("a", "a.txt", "A2", "2024-01-01 01:00:00", "2024-01-01 02:00:00"),
        ("b", "b.txt", "B", "2024-01-01 01:00:00", "2024-01-01 01:00:00"),
    ]
    assert state() == want
    at(2)(second, 1)
    assert state() == want
    ingest.publish(spark, root, str(tmp_path / "table"))
    assert tables.read_table(spark, str(tmp_path / "table")).count() == 2
    # A snapshot changes nothing, nor does a batch that it holds and that is replayed, nor a second snapshot.
    ingest.compact(spark, root, buckets=3)
    assert state() == want and ingest.open_batches(spark, root) == []
    at(9)(second, 1)
    assert state() == want and ingest.compact(spark, root) == tables.read_manifest(spark, root)
    ingest.drop_merged(spark, root)
    assert state() == want


def test_compaction_writes_only_folders_with_new_keys(spark, tmp_path):
    root = str(tmp_path / "log")
    columns = "id STRING, filename STRING, title STRING"

    def add(number, ids):
        rows = spark.createDataFrame([(i, f"{i}-{number}.txt", f"T{number}") for i in ids], columns)
        ingest.log_batch(root, F.lit(f"2024-01-0{number + 1}").cast("timestamp_ntz"))(rows, number)

    everyone = [f"d{i}" for i in range(40)]
    add(0, everyone)
    before = ingest.compact(spark, root, buckets=7)["buckets"]
    add(1, ["d3"])
    add(2, ["d3", "new"])
    got = {r.id: (r.filename, r.title, str(r.added_at)[:10], str(r.updated_at)[:10]) for r in ingest.library_from_log(spark, root).collect()}
    assert len(got) == 41 and got["d3"] == ("d3-0.txt", "T2", "2024-01-01", "2024-01-03") and got["new"][0] == "new-2.txt"
    after = ingest.compact(spark, root)["buckets"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    ingest.drop_merged(spark, root)
    assert {r.id: (r.filename, r.title, str(r.added_at)[:10], str(r.updated_at)[:10]) for r in ingest.library_from_log(spark, root).collect()} == got
    # Only the snapshot and open batches are read.
    add(3, ["d5"])
    files = ingest.library_from_log(spark, root).inputFiles()
    assert all("/snapshot/" in f or "/batch=3/" in f for f in files)


def test_upsert_stream_restarts_where_it_was(spark, tmp_path):
    root, source, cp = str(tmp_path / "log"), str(tmp_path / "in"), str(tmp_path / "cp")
    schema = "id STRING, filename STRING, title STRING"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.run_upsert(stream, root, cp).awaitTermination()

    feed([("a", "a.txt", "A"), ("b", "b.txt", "B")])
    feed([("a", "x.txt", "A2")])
    assert ingest.open_batches(spark, root) == [0, 1]
    assert {(r.id, r.filename, r.title) for r in ingest.library_from_log(spark, root).collect()} == {("a", "a.txt", "A2"), ("b", "b.txt", "B")}
    ingest.compact(spark, root)
    feed([("c", "c.txt", "C")])
    assert ingest.open_batches(spark, root) == [2] and ingest.library_from_log(spark, root).count() == 3


def test_running_statistics_add_up(spark, tmp_path):
    source = tmp_path / "rows"
    schema = "filename STRING, year INT, language STRING"
    spark.createDataFrame([("a.PDF", 2000, "de"), ("b.pdf", None, "de")], schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    histogram = running.running_histograms(stream)
    running.run(histogram, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("c.txt", 2000, "en")], schema).coalesce(1).write.mode("append").parquet(str(source))
    running.run(histogram, str(tmp_path / "s"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.facet, r.value): r.documents for r in tables.read_table(spark, str(tmp_path / "s")).collect()}
    assert got == {
        ("file_type", ".pdf"): 2, ("file_type", ".txt"): 1, ("year", "2000"): 2, ("language", "de"): 2, ("language", "en"): 1,
    }


def test_chunk_files_fall_back_to_no_chunks(spark, tmp_path):
    texts = {"a": '[{"n": 1, "text": "x"}, {"n": 2}]', "b": '[{"n": 1, "te', "c": " ", "d": '{"n": 1}', "e": ' \n[]\n', "f f": '[{"n": 3}]', "g": ""}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "chunks.json").write_text(text)
    rows = {r.id: r for r in files.read_chunk_files(spark, str(tmp_path), "n INT, text STRING").collect()}
    assert {k: [(c.n, c.text) for c in r.chunks] for k, r in rows.items()} == {
        "a": [(1, "x"), (2, None)], "b": [], "c": [], "d": [], "e": [], "f f": [(3, None)],
    }
    assert {k for k, r in rows.items() if r._corrupt is not None} == {"b", "c", "d"}


def test_a_broken_index_file_counts_as_empty_and_is_copied(spark, tmp_path):
    folder = tmp_path / "index"
    folder.mkdir()
    (folder / "good.jsonl").write_text('{"id": "a", "title": "T", "more": 1}\n\n{"id": "b"}\n')
    (folder / "bad.jsonl").write_text('{"id": "c", "title": "T"}\n{"id": "d", "ti')
    rows = {r.id: r for r in files.read_index(spark, str(folder), str(tmp_path / "copy")).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"].title, rows["a"].extra) == ("T", {"more": "1"})
    copied = spark.read.parquet(str(tmp_path / "copy")).collect()
    assert {(r.file.rsplit("/", 1)[1], r.value) for r in copied} == {("bad.jsonl", '{"id": "c", "title": "T"}'), ("bad.jsonl", '{"id": "d", "ti')}


def test_a_users_parser_and_its_quarantine(spark):
    def parse(path, content):
        if path == "none":
            return None, None
        return content.decode(), {"n": "three" if path == "kind" else len(content), "unknown": 1}

    rows = [(p, len(c), bytearray(c)) for p, c in (("a", b"text"), ("empty", b""), ("none", b"x"), ("kind", b"x"), ("bytes", b"\xff"))]
    source = spark.createDataFrame([*rows, ("null", None, None)], "path STRING, length BIGINT, content BINARY")
    done = files.parsed_documents(source, parse, "n INT, missing STRING")
    assert {(r.path, r.text, r.metadata.n, r.metadata.missing) for r in files.parsed(done).collect()} == {("a", "text", 4, None), ("empty", "", 0, None)}
    wrong = {r.path: r.error for r in files.broken(done).collect()}
    assert set(wrong) == {"none", "kind", "bytes", "null"}
    assert wrong["none"] == "ValueError: no text"
    assert files.parsed_documents(source.limit(0), parse, "n INT").count() == 0


# --- look-ups with a validity period ----------------------------------------------------------


def fold(times, ttl):
    last, fetched = None, []
    for at in sorted(set(times)):
        if last is None or at > last + ttl:
            last = at
            fetched.append(at)
    return fetched


def requests(seed=5):
    rng = random.Random(seed)
    # One key holds most rows, in dense runs, with gaps and exact-expiry times mixed in.
    hot = [rng.randint(0, 400) for _ in range(600)] + [0, 10, 20, 21]
    return {"hot": hot, "cold": [5], "edge": [0, 10, 11, 21, 22], "late": [1000, 2000]}


def test_fetch_chain_equals_the_sequential_fold(spark):
    data = requests()
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=s)) for k, v in data.items() for s in v]
    frame = spark.createDataFrame(rows, "key STRING, ts TIMESTAMP_NTZ")
    got: dict[str, list[int]] = {}
    for r in lookups.fetches(frame, ttl_seconds=10).collect():
        got.setdefault(r.key, []).append(int((r.ts - start).total_seconds()))
    assert {k: sorted(v) for k, v in got.items()} == {k: fold(v, 10) for k, v in data.items()}
    counts = {r.key: (r.fetched, r.hits) for r in lookups.outcomes(frame, 10).collect()}
    assert counts["edge"] == (3, 2)


def kept_fold(rows, ttl):
    """Fetches and hits of one key's (time, kept), in time order, kept answers first."""
    last, fetched = None, 0
    for at, empty in sorted((at, not kept) for at, kept in rows):
        if last is None or at > last + ttl:
            fetched += 1
            last = last if empty else at
    return fetched, len(rows) - fetched


def kept_requests(seed=7):
    rng = random.Random(seed)
    data = {k: [(at, rng.random() < 0.6) for at in v] for k, v in requests().items()}
    return data | {"never": [(at, False) for at in (1, 2, 50)], "edge": [(0, False), (0, True), (10, False), (11, False), (12, True), (22, False)]}


LOOKUPS = "key STRING, ts TIMESTAMP_NTZ, kept BOOLEAN"
START = dt.datetime(2024, 1, 1)


def lookup_rows(spark, rows):
    return spark.createDataFrame([(k, START + dt.timedelta(seconds=at), kept) for k, at, kept in rows], LOOKUPS)


def test_empty_answers_are_not_kept(spark):
    data = kept_requests()
    frame = lookup_rows(spark, [(k, at, kept) for k, v in data.items() for at, kept in v])
    got = {r.key: (r.fetched, r.hits) for r in lookups.outcomes(frame, 10).collect()}
    assert got == {k: kept_fold(v, 10) for k, v in data.items()}
    assert got["edge"] == (3, 3)
    assert lookups.outcomes(lookup_rows(spark, []), 10).count() == 0


def test_cover_of_empty_answers_is_two_rows_a_fetch(spark):
    """Each fetch used to be 97 rows, one for each slot of its validity, broadcast by the size of its file."""
    rows = [("k", at, at % 3 == 0) for at in range(0, 400, 7)] + [("edge", 10, True), ("edge", 20, False), ("edge", 21, False), ("edge", 9, False)]
    found = lookups.outcomes(lookup_rows(spark, rows), 10)
    data = {k: [(at, kept) for key, at, kept in rows if key == k] for k in ("k", "edge")}
    assert {r.key: (r.fetched, r.hits) for r in found.collect()} == {k: kept_fold(v, 10) for k, v in data.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan and "SortMergeJoin [key" in plan


def test_stream_of_lookups_equals_batch(spark, tmp_path):
    data = kept_requests()
    rows = [(k, at, kept) for k, v in data.items() for at, kept in v]
    random.Random(1).shuffle(rows)
    log = str(tmp_path / "log")
    # Two runs from one checkpoint, then a late row and one that closes the last slots.
    parts_ = [[r for r in rows if r[1] < 100], [r for r in rows if r[1] >= 100] + [(None, 300, True)], [("hot", 1, True), ("end", 9999, True)]]
    for part in parts_:
        lookup_rows(spark, part).coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(LOOKUPS).parquet(log)
        lookup_cache.run(lookup_cache.outcomes(stream, ttl_seconds=10), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("key").agg(F.sum("fetched").alias("f"), F.sum("hits").alias("h"))
    assert {r.key: (r.f, r.h) for r in got.collect()} == {k: kept_fold(v, 10) for k, v in data.items()}


def test_packed_chunk_files(spark, sf):
    """The query used to make a folder for each document; packed files are read by the same rules."""
    from scriptorium import session
    from scriptorium.plans import load_all
    from scriptorium.plans.registry import QUERIES

    rows = [("a/chunks.json", b'[{"n": 1}, {"n": 2}]'), ("in/id=b%2F1/chunks.json", b" [] "), ("c/chunks.json", b'[{"n": 1}'), ("d/x", b'{"n": 1}'), ("e/x", b"")]
    found = {r.id: r for r in files.chunk_files(spark.createDataFrame(rows, "path STRING, content BINARY"), "n INT").collect()}
    assert {k: [c.n for c in r.chunks] for k, r in found.items()} == {"a": [1, 2], "b/1": [], "c": [], "d": [], "e": []}
    assert {k for k, r in found.items() if r._corrupt is not None} == {"c", "d", "e"}
    load_all()
    made = len(session.FOLDERS)
    done = QUERIES["json_chunks"](spark, sf)
    assert done.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(not tables.folders(spark, f) for f in session.FOLDERS[made:])


def test_upsert_source_is_written_by_all_tasks(spark, sf, monkeypatch):
    """Four tasks used to read all documents, however many there are."""
    from scriptorium import session
    from scriptorium.plans import fixtures, load_all
    from scriptorium.plans.registry import QUERIES

    load_all()
    monkeypatch.setattr(fixtures, "table", lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet").repartition(6))
    made = len(session.FOLDERS)
    assert QUERIES["stream_upsert"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    source = next(f for f in session.FOLDERS[made:] if "/log-source-" in f)
    assert len(spark.read.parquet(source).inputFiles()) >= 12


class StateStore:
    """State values and timers of one key in memory, and the number of calls."""

    def __init__(self):
        self.calls, self.timers, self.now = 0, set(), 0

    def getValueState(self, *named):
        return self.Held(self)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.fired

    class Held:
        def __init__(self, store):
            self.store, self.held = store, {}

        def get(self):
            return self.getValue("value")

        def update(self, value):
            self.updateValue("value", value)

        def exists(self):
            return self.containsKey("value")

        def getValue(self, key):
            self.store.calls += 1
            return self.held.get(key)

        def updateValue(self, key, value):
            self.store.calls += 1
            self.held[key] = value

        def containsKey(self, key):
            self.store.calls += 1
            return key in self.held

        def removeKey(self, key):
            self.store.calls += 1
            del self.held[key]


def folded(batches, ttl=10, width_ms=1000):
    """Fetches and hits of one key's batches of (time, kept), each older than the next, and the calls of the state store."""
    store, processor, sums = StateStore(), lookup_cache._Lookups(ttl * 1_000_000, width_ms), [0, 0]
    processor.init(store)
    for batch in [*batches, []]:
        frame = pd.DataFrame({"us": [at * 1_000_000 for at, _ in batch], "kept": [kept for _, kept in batch]})
        list(processor.handleInputRows(("k",), iter([frame] if batch else []), store))
        store.now = max((at for at, _ in batch), default=10**9) * 1000
        while fired := [t for t in store.timers if t <= store.now]:
            store.fired = min(fired)
            store.timers.remove(store.fired)
            for out in processor.handleExpiredTimer(("k",), store, store):
                sums = [sums[0] + int(out["fetched"].sum()), sums[1] + int(out["hits"].sum())]
    return tuple(sums), store.calls


def test_few_state_calls_for_a_key(monkeypatch):
    """Each slot used to cost a dozen calls of the state store, so that a key's day took hundreds."""
    rows = [(at, at % 4 > 0) for at in range(0, 600, 3)]
    sums, calls = folded([rows])
    assert sums == kept_fold(rows, 10) and calls <= 20
    # Keys with more requests than a state value takes, and such as have them only for a while.
    for block in (1, 3, 8, 50):
        monkeypatch.setattr(lookup_cache, "BLOCK", block)
        for seed in range(10):
            rng = random.Random(seed)
            rows = sorted((rng.randint(0, 200), rng.random() < 0.5) for _ in range(120))
            borders = sorted(rng.sample(range(200), 3))
            batches = [[r for r in rows if a < r[0] <= b] for a, b in zip([-1, *borders], [*borders, 200], strict=True)]
            assert folded(batches)[0] == kept_fold(rows, 10)


def test_first_of_period(spark, tmp_path):
    log = str(tmp_path / "log")
    for rows in ([("a", 0, True), ("a", 3, True), ("b", 1, True)], [("a", 500, True)], [("a", 501, True), ("b", 502, True)]):
        lookup_rows(spark, rows).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(log)
        stream = lookup_cache.first_of_period(spark.readStream.schema("key STRING, ts TIMESTAMP, kept BOOLEAN").parquet(log), 10)
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in got} == {"a": 2, "b": 2}


def test_cache_rows(spark):
    cache = spark.createDataFrame([("a_1", "v", 10), ("a_2", "", 99), ("b_1", "v", 99)], "key STRING, value STRING, expiry INT")
    assert [r.key for r in lookups.clear(cache, "a_").collect()] == ["b_1"]
    assert lookups.clear(cache).count() == 0
    assert [r.key for r in lookups.live(cache, 10).orderBy("key").collect()] == ["a_1", "b_1"]
