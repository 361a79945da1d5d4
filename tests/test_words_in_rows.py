"""Terms and trigrams met where the unit's text lies, next to the joins: repeated and missing ids, repeated terms, ties."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import retrieval as rt


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(40)] + ["会", "x9"]
    rows = [(f"u{i}", " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(120)]
    rows += [rows[3], rows[3], ("u5", "abc 会x9 other"), (None, rows[7][1]), (None, "ab 会"), ("u200", None), ("u201", " ")]
    return spark.createDataFrame(rows, "unit_id string, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(1, "ab"), (1, "c"), (2, "会"), (2, "é"), (2, "é"), (3, "abcd"), (4, "nowhere"), (None, "ab"), (5, "x9"), (5, "9")]
    return spark.createDataFrame(rows, "query_id int, term string")


def best(df, k):
    return sorted(map(tuple, rt.top_k(df, k).select("query_id", "unit_id", "score", "rank").collect()), key=str)


def test_substrings_in_rows_equal_joined(monkeypatch, units, terms):
    joined, short = best(rt.substring_hits(terms, units), 1000), best(rt.substring_hits(terms, units), 4)
    monkeypatch.setattr(rt, "FEW_UNITS", 0)
    assert best(rt.substring_hits(terms, units), 1000) == joined and any(s > 1 for _, _, s, _ in joined)
    assert best(rt.substring_hits(terms, units, best=4), 4) == short
    inside = units.where("unit_id < 'u4'").select("unit_id")
    want = [r for r in joined if r[1] is not None and r[1] < "u4"]
    assert {r[:3] for r in best(rt.substring_hits(terms, units, rt.Within(inside), best=1000), 1000)} == {r[:3] for r in want}
    assert {r[:3] for r in best(rt.substring_hits(terms, units, lambda x: x.join(inside, "unit_id", "left_semi"), best=2), 1000)} == {r[:3] for r in want}


def test_tasks_give_on_the_best_alone(spark, monkeypatch):
    """Every unit holds every term: a task gives on k units of a query, not all of them."""
    monkeypatch.setattr(rt, "FEW_UNITS", 0)
    units = spark.range(0, 3000, 1, 3).selectExpr("concat('u', id) AS unit_id", "'gamma delta' AS text")
    terms = spark.createDataFrame([(q, t) for q in range(3) for t in ("amm", "elt")], "query_id int, term string")
    got = rt.substring_hits(terms, units, best=5)
    assert got.count() == 3 * 3 * 5
    near = rt.trigram_similarity(spark.createDataFrame([(q, "gamma delta") for q in range(3)], "query_id int, query string"), units, best=5)
    assert near.count() == 3 * 3 * 5 and best(near, 2)[0] == (0, "u0", 1.0, 1)


def test_trigrams_in_rows_equal_joined(spark, monkeypatch, units):
    rng = random.Random(4)
    texts = [r.text for r in units.collect() if r.text]
    rows = [(i, rng.choice(texts)) for i in range(20)] + [(3, "abc ab"), (None, "abc"), (30, None), (31, "--")]
    queries = spark.createDataFrame(rows, "query_id int, query string")
    got = best(rt.trigram_similarity(queries, units), 1000)
    few = best(rt.trigram_similarity(queries, units, best=3), 3)
    monkeypatch.setattr(rt, "QUERIES_IN_ROWS", 0)
    # Copies of a unit tie, so their ranks alone tell them apart.
    assert got == best(rt.trigram_similarity(queries, units), 1000) and few == best(rt.trigram_similarity(queries, units), 3) and len(few) > 20


def test_words_are_forgotten(monkeypatch):
    """A task that has met more words than it keeps starts again, with the queries' parts under their old numbers."""
    monkeypatch.setattr(rt, "WORDS_KEPT", 2)
    parts = rt._Parts(["  a", " ab"], True)
    first = parts.of(["ab", "abc", "b", "c"])
    assert [list(x) for x in parts.of(["ab"])] == [list(first[0][:3]), [3]] and list(first[0][:2]) == [0, 1]


def test_cascade_asks_each_level_once(spark):
    """Rows that a level's function sees are counted: once for every query left, and no level is asked without queries."""
    seen = spark.sparkContext.accumulator(0)
    asked = []

    @F.udf("string")
    def count(q):
        seen.add(1)
        return f"u{q}"

    def level(name, condition):
        def route(q):
            asked.append(name)
            return q.where(condition).withColumn("unit_id", count("query_id"))
        return route

    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = rt.cascade(q, [("one", level("one", "query_id = 1")), ("two", level("two", "query_id > 0")), ("three", level("three", "true"))])
    assert sorted((r.query_id, r.source) for r in got.collect()) == [(1, "one"), (2, "two"), (3, "two")]
    assert seen.value == 3 and asked == ["one", "two"]
