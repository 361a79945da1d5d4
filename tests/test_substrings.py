"""Terms inside texts: words of all kinds, terms of several tokens, and no grams of whole texts for terms of one token."""

from tessella.operators import retrieval as rt

TEXTS = {"a": "Alpha alphabet, beta", "b": "会话 ALPHA-beta x9", "c": "", "d": None, "e": "alp habet"}
TERMS = [(1, "alpha"), (1, "bet"), (1, "habet"), (2, "会"), (2, "9"), (3, "a-b"), (3, "alpha"), (4, "Alpha"), (5, "")]


def test_substring_hits(spark):
    units = spark.createDataFrame(list(TEXTS.items()), "unit_id string, text string")
    terms = spark.createDataFrame(TERMS, "query_id int, term string")
    size = {q: sum(x == q for x, _ in TERMS) for q, _ in TERMS}
    want = {}
    for u, text in TEXTS.items():
        for q, t in TERMS:
            if t and t in (text or "").lower():
                want[q, u] = want.get((q, u), 0) + 1
    got = {(r.query_id, r.unit_id): r.score for r in rt.substring_hits(terms, units).collect()}
    assert got == {(q, u): round(n / size[q], 6) for (q, u), n in want.items()}


def test_grams_are_cut_from_distinct_tokens(spark, monkeypatch):
    """Every text holds the same words, so one row of each reaches the gram join."""
    units = spark.range(300).selectExpr("concat('u', id) AS unit_id", "'gamma delta gamma' AS text")
    terms = spark.createDataFrame([(1, "amm")], "query_id int, term string")
    rows, whole = [], rt.containing

    def counted(needles, texts, *more, **named):
        rows.append(texts.count())
        return whole(needles, texts, *more, **named)

    monkeypatch.setattr(rt, "containing", counted)
    assert rt.substring_hits(terms, units).count() == 300
    assert rows == [2]
