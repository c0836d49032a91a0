"""Annotations: what is spared by hints and shared words changes no result."""

import random
import re

from pyspark.sql import functions as F

from scriptorium.functions import annotate as an
from scriptorium.operators import chunking

T = F.col("text")


def odd_texts():
    rng = random.Random(7)
    parts = ["Ada Lovelace", "Max born", "İstanbul İ", "1999", "2031", "10.1234/ab.c", "a.b@c.de", "@", "http://x.y", "https://", "1.2.3.4", "1.2.3.", ".", "!", "? "]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n", ", "]) for _ in range(rng.randint(0, 16))) for _ in range(1500)]
    return [*texts, None, "", " . ! ", "x" * 300 + ". Ada Lovelace.", "x" * 279 + ". Ada Lovelace.", "good bad. und der die"]


def python_summary(text):
    sentences = [s.strip() for s in re.findall(an.SENTENCE, text or "") if s.strip()]
    if not sentences:
        return ""
    everything = "|".join(f"(?:{p})" for p in an.ENTITY_PATTERNS.values()).replace(r"\p{Lu}", "[A-Zİ]").replace(r"\p{Ll}", "[a-z]")
    counted = [(len(re.findall(everything, s)), s) for s in sentences if s != sentences[0]]
    n, best = max(counted, default=(0, ""))
    return f"{sentences[0]} {best}" if n and len(sentences[0]) + len(best) <= an.SUMMARY_CHARS else sentences[0]


def test_entities_and_summary_by_the_rules_in_python(spark):
    rows = spark.createDataFrame([(t,) for t in odd_texts()], "text STRING").select("text", an.entities(T).alias("e"), an.summary(T).alias("s")).collect()
    for r in rows:
        assert r.s == python_summary(r.text)
        if r.text is None:
            continue
        for kind, pattern in an.ENTITY_PATTERNS.items():
            found = re.findall(pattern.replace(r"\p{Lu}", "[A-Zİ]").replace(r"\p{Ll}", "[a-z]"), r.text)
            assert r.e.get(kind, []) == list(dict.fromkeys(found)), kind
            assert all(any(h in f for h in an.ENTITY_HINTS.get(kind, [""])) for f in found)


def test_annotating_and_improving_at_once_equals_one_after_the_other(spark):
    chunks = spark.createDataFrame(list(enumerate(odd_texts())), "chunk_id INT, text STRING")
    once = chunking.annotate_and_improve(chunks)
    after = chunking.improve(chunking.annotate(chunks))
    plain = chunks.select(
        "*", an.entities(T).alias("entities"), an.keywords(T).alias("keywords"), an.token_count(T).alias("token_count"),
        an.summary(T).alias("summary"), an.sentiment(T).alias("sentiment"), F.lit(True).alias("improved"),
    )
    assert once.columns == after.columns == plain.columns
    assert once.orderBy("chunk_id").collect() == after.orderBy("chunk_id").collect() == plain.orderBy("chunk_id").collect()


def test_texts_are_cut_into_words_once(spark):
    chunks = spark.createDataFrame([(0, "a b")], "chunk_id INT, text STRING")
    plan = chunking.annotate_and_improve(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(lower(") == 1


def test_lower_case_keeps_the_number_of_words(spark):
    points = spark.range(1, 0x20000).where("id NOT BETWEEN 55296 AND 57343")
    letter = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    texts = points.select(F.concat(F.lit("a"), letter, F.lit("B "), letter, F.lit(" c"), letter).alias("text"))
    wrong = texts.where(an.token_count(T) != an.token_count(T, words=an.lower_words(T)))
    assert wrong.count() == 0
