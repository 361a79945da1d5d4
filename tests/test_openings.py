"""Needles found by the hashes of their openings, next to plain Python; sections' points; documents of found units."""

import random

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries in order)
from tessella.operators import retrieval as rt


def test_containing_equals_plain(spark):
    rng = random.Random(11)
    words = ["ab", "a", "会话", "x\U0001d400y", "delta", "é", "the longest of all needles here", "sixteen letters!"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(80)] + [(80, None), (81, ""), (5, "ab a"), (None, "delta a")]
    needles = [*words, "a a", "ta th", "of all needles", "not there at all", "longest of all needles here a", "", None, "a"]
    want = sorted(((n, i) for i, t in texts for n in {*needles} if n and t is not None and n in t), key=str)
    got = rt.containing(spark.createDataFrame([(n,) for n in needles], "term string"), spark.createDataFrame(texts, "id int, text string").repartition(3), size=F.length("text") + F.length("term"))
    rows = got.collect()
    assert sorted(((r.term, r.id) for r in rows), key=str) == want and len(want) > 100
    assert all(r.size >= 2 * len(r.term) for r in rows)


def test_long_texts_are_read_in_stretches(spark):
    """A needle across the bound of two stretches of a text, and none across the bound of two texts."""
    n = (1 << 20) - 5
    texts = spark.createDataFrame([(1, "." * n + "needle in hay" + "." * n), (2, "." * 9 + "needle"), (3, " in hay")], "id int, text string").coalesce(1)
    got = rt.containing(spark.createDataFrame([("needle in hay",), ("needle",), ("hay",)], "term string"), texts)
    assert sorted((r.id, r.term) for r in got.collect()) == [(1, "hay"), (1, "needle"), (1, "needle in hay"), (2, "needle"), (3, "hay")]


def test_texts_are_not_cut_into_grams(spark):
    texts = spark.createDataFrame([(1, "alpha beta")], "id int, text string")
    plan = rt.containing(spark.createDataFrame([("alph",)], "term string"), texts)._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "Join" not in plan


def test_section_points(spark):
    sections = [("s1", "Aha aha", "ahaha aha x"), ("s2", "none", "aha " * 60), ("s3", "Change history aha", "aha"), ("s4", None, "aha"), ("s5", "x", None)]
    terms = spark.createDataFrame([(1, "aha"), (2, "aha"), (2, "x"), (3, None)], "query_id int, term string")
    got = rt.section_keyword_search(terms, spark.createDataFrame(sections, "section_id string, title string, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, "s1", 2002), (1, "s2", 50), (2, "s1", 2003)]


def test_documents_of_found_units_come_from_the_index(spark, tmp_path):
    from tessella.plans import q_evaluation as qe

    d = str(tmp_path)
    rows = [(i, f"title {i}\nalpha beta", "en", "s", 9) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    found = spark.createDataFrame([(1, "3#1", 1), (1, "0#0", 2), (2, "9#9", 1)], "query_id int, unit_id string, rank int")
    got = qe._with_docs(spark, d, found)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2), (1, 3, 1)]
    assert "regexp_extract_all" not in (plan := got._jdf.queryExecution().toString()) and "documents.parquet" not in plan
