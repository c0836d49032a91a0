"""Extraction rules: precedence, limits and fallbacks, against the rules restated in Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import extract as ex
from scriptorium.functions import fixed_values as v
from scriptorium.functions import similarity as sim

T = F.col("text")


def of(value, fn, text):
    return value(fn(T), row=(text,))


def test_title_by_pattern_then_longest_line(value):
    assert of(value, ex.title, "Title: A Study of Things\nby X") is not None
    # No pattern takes these lines: the longest usable one wins, the greater among equals.
    text = "§ 12 (draft/1)\n§ (abstract) is a much longer line/\n§ candidate line (a/1)\n§ candidate line (b/1)"
    assert of(value, ex.title, text) == "§ candidate line (b/1)"
    assert of(value, ex.title, "§§/") is None


def python_title(text):
    lines = [x.strip() for x in text.split("\n") if x.strip()][:20]
    for p in v.TITLE_PATTERNS:
        m = re.search(p, "\n".join(lines[:10]))
        if m:
            return m.group(1).strip()
    usable = [
        (len(x), x) for x in lines if 10 <= len(x) <= 300 and not re.search(v.NOT_A_TITLE, x) and not re.match(v.NUMBERED_LINE, x)
    ]
    return max(usable)[1] if usable else None


def python_year(text):
    years = []
    for p in v.YEAR_PATTERNS:
        years += [int(m.group(1)) for m in re.finditer(p, text) if 1900 <= int(m.group(1)) <= 2025]
    return Counter(years).most_common(1)[0][0] if years else None


def python_language(text):
    words = re.findall(r"\b\w+\b", (text or "").lower())
    if not words:
        return "en"
    de = sum(w in v.GERMAN_WORDS for w in words) / len(words)
    en = sum(w in v.ENGLISH_WORDS for w in words) / len(words)
    if abs(de - en) < 0.05 and de > 0.05 and en > 0.05:
        return "mixed"
    return "de" if de > en else "en"


def test_same_as_the_rules_in_python(spark, sf):
    from scriptorium.plans import fixtures as fx

    docs = fx.papers(spark, sf).select("doc_id", "text")
    got = docs.select(
        "text", ex.title(T).alias("title"), ex.year(T).alias("year"), ex.language_ratio(T).alias("language")
    ).collect()
    assert len(got) == 200
    for r in got:
        assert r.title == python_title(r.text)
        assert r.year == python_year(r.text)
        assert r.language == python_language(r.text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Authors: Ada Lovelace, Kurt Goedel und Max Born\n", ["Ada Lovelace", "Kurt Goedel", "Max Born"]),
        # Institution words and short names go; the next pattern is tried when nothing is left.
        ("by University of X\nProf. Emmy Noether", ["Emmy Noether"]),
        ("12 34", None),
    ],
)
def test_authors(value, text, want):
    got = of(value, ex.authors, text)
    if want == ["Emmy Noether"]:
        assert got is not None and all("University" not in a for a in got)
    else:
        assert got == want


def test_authors_from_file_name(value):
    assert value(ex.authors(T, F.lit("/x/Lovelace_Notes.pdf")), row=("12",)) == ["Lovelace"]
    assert value(ex.authors(T, F.lit("Lovelace et al_Notes.pdf")), row=("12",)) == ["Lovelace et al"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(2001) 1999 1999 (2001)", 2001),
        ("published in 1850, received 1999", 1999),
        ("in 2030 ", None),
        ("May 4, 2020", 2020),
        (" 1999 2000 2000 ", 2000),
    ],
)
def test_year(value, text, want):
    assert of(value, ex.year, text) == want == python_year(text)


def test_year_cap_is_a_parameter(value):
    assert of(value, lambda t: ex.year(t, latest=2040), "(2030)") == 2030


def test_publisher_order(value):
    assert of(value, ex.publisher, "springer and Elsevier") == "Elsevier"
    assert of(value, ex.publisher, "Springerin") is None
    assert of(value, ex.publisher, "TAYLOR & FRANCIS group") == "Taylor & Francis"
    assert of(value, ex.publisher, "published by Invented House. x") == "Invented House"
    assert of(value, ex.publisher, "published by AB. verlag Wort.") == "Wort"


def test_journal(value):
    assert of(value, ex.journal, "the lancet") == "The Lancet"
    assert of(value, ex.journal, "Journal of Odd Facts (Berlin), pages") == "Odd Facts, pages"
    assert of(value, ex.journal, "nothing here") is None


def test_identifiers(value):
    assert of(value, ex.doi, "doi: 10.1234/ab.c, and") == "10.1234/ab.c,"
    assert of(value, ex.doi, "10.1234/abc") is None
    assert of(value, ex.doi_loose, "see 10.1234/abc;. ") == "10.1234/abc"
    # The ten-digit form is tried first and takes the head of a thirteen-digit number.
    assert of(value, ex.isbn, "ISBN 978-3-16-148410-0") == "9783161"
    assert of(value, ex.isbn, "ISBN 3-16-148410-X") == "316148410X"
    # The bare ten digits are tried first, so an unhyphenated thirteen is cut.
    assert of(value, ex.isbn, "ISBN: 9783161484100") == "9783161484"
    assert of(value, ex.doi_key, "https://doi.org/10.1234/AbC") == "10.1234/abc"
    assert of(value, ex.isbn_key, "978-3 16") == "978316"


def test_page_one(value):
    assert of(value, ex.year_max, "1899 1985 2031 2004 1999 12005") == 2004
    assert of(value, ex.year_max, "1985 1950") == 1985
    lines = F.split(T, "\n")
    assert of(value, lambda t: ex.page_title(lines), "short\nA title that is long\nB title that is long") == "A title that is long"
    text = "The title of this long paper\nAda Lovelace\nJOHN SMITH\nUniversity of X\nDr. Who\nlower line"
    got = of(value, lambda t: ex.page_authors(lines, F.lit("The title of this long paper")), text)
    assert got == ["Ada Lovelace", "JOHN SMITH", "Dr. Who"]
    assert of(value, lambda t: ex.page_journal(lines), "x\nIn the Odd Journal today") == "In the Odd Journal"
    assert of(value, lambda t: ex.page_journal(lines), "a, b. The Odd Journal") == "The Odd Journal"
    assert of(value, lambda t: ex.body_lines(t), "Page 3\n\n 12 \nBody\nCopyright X") == ["Body"]


def test_fields_late_in_a_text_are_found_and_heads_can_be_asked_for(spark):
    filler = "7% " * 4000
    text = f"{filler} (1999)\nAuthors: Ada Lovelace, Kurt Goedel\npublished by Springer. und der die und der die\n"
    docs = spark.createDataFrame([(text,)], "text STRING")
    whole, head = ex.extract_all(docs).first(), ex.extract_all(docs, heads=True).first()
    assert (whole.year, whole.author, whole.publisher) == (1999, ["Ada Lovelace", "Kurt Goedel"], "Springer")
    assert (head.year, head.author, head.publisher) == (None, None, None)
    short = spark.createDataFrame([("der Hund und die Katze",)], "text STRING")
    assert (ex.extract_all(short).first().language, ex.extract_all(short, heads=True).first().language) == ("de", "en")


def test_line_limits_can_be_switched_off(spark):
    lines = "\n".join(["~~"] * 25 + ["a much longer line that is the title"])
    got = spark.createDataFrame([(lines,)], "text STRING").select(
        ex.title(F.col("text")).alias("a"), ex.title(F.col("text"), None).alias("b"),
        ex.page_title(ex.body_lines(F.col("text"))).alias("c"), ex.page_title(ex.body_lines(F.col("text")), None).alias("d"),
    ).first()
    assert tuple(got) == (None, "a much longer line that is the title", None, "a much longer line that is the title")


def test_validate(value):
    long = "x" * 301
    assert of(value, ex.validate_title, f" {long}\n") == long
    assert of(value, lambda t: ex.validate_title(t, 300), f" {long}\n") == "x" * 300 + "..."
    names = F.array(F.lit("ab"), F.lit("Springer"), F.lit("Ada Lovelace"))
    assert value(ex.validate_authors(names)) == ["Ada Lovelace"]
    assert value(ex.validate_authors(F.array(F.lit("ab")))) == ["ab"]


def test_edit_distance_equals_the_built_in(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
    rows = [(word(), word()) for _ in range(200)] + [(w, w + word()) for w in (word() for _ in range(50))] + [("", ""), ("a" * 500, "a" * 499 + "b")]
    df = spark.createDataFrame(rows, "x STRING, y STRING")
    assert df.where(sim.edit_distance(F.col("x"), F.col("y")) != F.levenshtein("x", "y")).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("abc", "ABC ", 1.0), ("", "x", 0.0), (None, "x", 0.0), ("abcd", "abce", 0.75), ("a", "b", 0.0)],
)
def test_string_similarity(value, a, b, want):
    columns = "a STRING, b STRING"
    assert value(sim.string_similarity(F.col("a"), F.col("b")), columns, (a, b)) == want
    assert value(sim.string_similarity(F.col("b"), F.col("a")), columns, (a, b)) == want


def test_sequence_ratio(value):
    from difflib import SequenceMatcher

    columns = "a STRING, b STRING"
    got = value(sim.sequence_ratio(F.col("a"), F.col("b")), columns, ("Ada Lovelace", "Lovelace, Ada"))
    assert got == SequenceMatcher(None, "ada lovelace", "lovelace, ada").ratio()
    assert value(sim.sequence_ratio(F.col("a"), F.col("b")), columns, (None, "x")) == 0.0


def test_author_similarity(value):
    found, original = F.array(F.lit("Max Born"), F.lit("")), F.array(F.lit("max born"), F.lit("X"))
    assert value(sim.author_similarity(found, original)) == 0.5


def test_years_are_the_same_when_lines_without_digits_are_left_out(spark, monkeypatch):
    import random

    rng = random.Random(5)
    parts = ["March", "sEptember.", "Dec", "12", "3,", "1999", "2001", "(2001)", "(", ")", ",", "Volume", "received", "©", "x" * 30, "-", "١٩٩٩"]
    blanks = ["", "", " ", "\n", "\n\n", " \n \n", "\x1c", " ", "\r\n", "\t"]
    texts = ["".join(rng.choice(parts) + rng.choice(blanks) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += ["March\n  \n1999", "March\x1c\n1999", "Volume\n12,\n(1999)", "received\n1999", "1999", "\n1999\n", "12\nMarch\n1999", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    got = [r[0] for r in df.select(ex.year(T)).collect()]
    monkeypatch.setattr(ex, "_near_digits", lambda text: text)
    want = [r[0] for r in df.select(ex.year(T)).collect()]
    assert got == want and sum(y is not None for y in want) > 1000


def test_year_patterns_do_not_read_lines_without_digits(value):
    text = "\n".join(["some words of prose " * 50] * 40 + ["ended in March", "1999"])
    assert of(value, lambda t: F.length(ex._near_digits(t)), text) < 600
    assert of(value, ex.year, text) == 1999


def test_hints_stand_wherever_a_case_insensitive_pattern_matches(spark):
    points = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343")
    letter = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c")
    letters = sorted(set("".join([*v.PUBLISHER_HINTS, *v.JOURNAL_HINTS, *v.PUBLISHERS, *v.JOURNALS]).lower()) - set(" &"))
    wrong = [letter.rlike(f"(?Uid)^{x}$") & (ex._folded(letter) != x) for x in letters if x.isalnum()]
    missed = points.select(letter, F.array_contains(F.array(*wrong), True).alias("bad")).where("bad").collect()
    assert [r.c for r in missed] == []
    for patterns, hints in ((v.PUBLISHER_PATTERNS, v.PUBLISHER_HINTS), (v.JOURNAL_PATTERNS, v.JOURNAL_HINTS)):
        for pattern, hint in zip(patterns, hints, strict=True):
            assert re.sub(r"\\s[*+]", " ", pattern).replace("\\", "").startswith(f"(?i){hint.rstrip()}")


def test_a_publisher_with_a_dotless_i_is_found(value):
    assert of(value, ex.publisher, "see Sprınger now") == "Springer"
    assert of(value, ex.isbn, "ıSBN 3-16-148410-X") == "316148410X"


def test_sequence_ratio_equals_the_matcher_on_contained_and_other_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé 𝒳") for _ in range(rng.randint(0, 14)))
    pairs = [(word(), word()) for _ in range(400)] + [(w, word() + w + word()) for w in (word() for _ in range(200))]
    pairs += [(b, a) for a, b in pairs[400:]] + [("", ""), ("", "x"), ("  ", "x"), ("a" * 400, "a" * 299 + "b"), ("ABC", "abc ")]
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a STRING, b STRING")
    for r in df.select("a", "b", sim.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        a, b = r.a.lower().strip(), r.b.lower().strip()
        assert r.r == (SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0)


def test_the_matcher_runs_once_a_pair_and_not_for_contained_titles(spark, monkeypatch):
    import pandas as pd

    asked = []

    class Counted(sim.SequenceMatcher):
        def ratio(self):
            asked.append((self.a, self.b))
            return super().ratio()

    monkeypatch.setattr(sim, "SequenceMatcher", Counted)
    left, right = pd.Series(["abc", None, "abc", "x"]), pd.Series(["cba", "y", "cba", None])
    (got,) = sim._block_ratio.func(iter([(left, right)]))
    assert asked == [("abc", "cba")] and list(got) == [pytest.approx(1 / 3), 0.0, pytest.approx(1 / 3), 0.0]
    # Contained pairs reach Python as nulls.
    df = spark.createDataFrame([("a title", "a title (reprint)")] * 40, "a STRING, b STRING")
    plan = df.select(sim.sequence_ratio(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"_block_ratio\(CASE WHEN|_block_ratio\(if", plan)


def test_blocks_of_many_pairs_are_found_at_once_and_equal_the_matcher(monkeypatch):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(11)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    pairs = list({(word(s, n), word(s, n)) for s in ("ab", "abcé 𝒳\0", "xyz") for n in (9, 40, 150) for _ in range(120)})
    pairs += [("ab" * 150, "ba" * 150), ("x" * 40, "y" * 40), ("a title", "eltit a"), ("qabxab", "abyqab")]
    # A pair of more places than are looked at together, in the midst of the others.
    wide = ("ab" * 30 + "c" * 2000, "c" * 700 + "ba" * 30)
    pairs.insert(50, wide)
    want = {(a, b): SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs}

    asked = []

    class Counted(SequenceMatcher):
        def ratio(self):
            asked.append((self.a, self.b))
            return super().ratio()

    monkeypatch.setattr(sim, "SequenceMatcher", Counted)
    assert sim._ratios(pairs) == want
    assert wide in asked and len(asked) < len(pairs) / 4
    # However many, no more than MOST_PLACES are held at once.
    groups = list(sim._groups(pairs))
    assert [p for g, _ in groups for p in g] == pairs
    assert all(places <= sim.MOST_PLACES or g == [wide] for g, places in groups)


def test_a_batch_of_different_titles_does_not_ask_the_matcher_one_by_one(monkeypatch):
    import pandas as pd

    class Refused(sim.SequenceMatcher):
        def ratio(self):
            raise AssertionError("asked for one pair")

    monkeypatch.setattr(sim, "SequenceMatcher", Refused)
    left = pd.Series([f"on the growth of title number {n}" for n in range(200)])
    (got,) = sim._block_ratio.func(iter([(left, left.str[::-1])]))
    assert len(got) == 200 and got.between(0.05, 0.95).all()


def test_the_ratio_runs_where_the_package_is_not_installed(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "ratio.pickle").write_bytes(cloudpickle.dumps(sim._block_ratio.func))
    code = """
import pickle, pandas as pd
ratio = pickle.load(open("ratio.pickle", "rb"))
left = pd.Series([f"on the growth of title number {n}" for n in range(200)] + ["abc"])
(got,) = ratio(iter([(left, left.str[::-1])]))
try:
    import scriptorium
except ImportError:
    print(len(got), round(got.iloc[-1], 6))
"""
    there = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=there, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == ["201", "0.333333"], run.stderr


def test_presence_reads_the_text_once(spark):
    """Each listed word used to be looked for in the whole text."""
    texts = ["und der the", "the\nund der", "", "und  der", "the of und", None]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING").select(ex.language_presence(F.col("text")).alias("v"))
    assert [r.v for r in df.collect()] == ["de", "de", "en", "de", "en", "en"]
    assert "contains" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_held_text_needs_no_edit_matrix(spark):
    """A phrase in a long title used to be compared character by character; names used to be cut at equal ends first."""
    rows = [("a long title of many words", "title of"), ("title of", "a long title of many words"), ("kitten", "sitting"), ("", "ab")]
    df = spark.createDataFrame(rows, "x STRING, y STRING")
    assert [r.d for r in df.select(sim.edit_distance(F.col("x"), F.col("y")).alias("d")).collect()] == [18, 18, 3, 2]
    plan = df.select(sim.edit_distance(F.col("x"), F.col("y")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(x" in plan
    names = df.select(sim.author_similarity(F.array("x"), F.array("y")).alias("s"))
    assert "substr" not in names._jdf.queryExecution().optimizedPlan().toString()
