"""Pairs that near copies are met in: each once, and a group's not in its square."""

import random

from llm import shingles
from llm.setjoin import Threshold

KIND = "t long, s long, n int, p int, g long, c long, w array<long>"


def test_a_pair_is_met_at_its_first_token_only(spark):
    # Sets 1 and 2 share tokens 10 to 15, set 3 shares the last of them with both, set 4 is of set 1's component.
    rows = [(t, s, 100, t - 10, 0, c, None) for s, c in ((1, 1), (2, 2), (4, 1)) for t in range(10, 16)]
    rows.append((15, 3, 100, 0, 0, 3, None))
    got = shingles._crossing(spark.createDataFrame(rows, KIND).repartition(3), Threshold(80)).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]


def test_a_group_of_near_copies_is_checked_in_far_less_than_its_square(spark, monkeypatch):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(10_000) for _ in range(150)]
    texts = []
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(150)] = "x%d" % rng.randrange(1_000_000)
        texts.append(" ".join(words[rng.randrange(5):]))
    checked = []
    whole = shingles.verify

    def counted(pairs, sets, rule):
        checked.append(pairs.count())
        return whole(pairs, sets, rule)

    monkeypatch.setattr(shingles, "verify", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingles.near_documents(docs).collect()}
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = list(range(120))
    for i in range(120):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    assert [got[i] for i in range(120)] == want
    assert len(set(want)) < 20
    assert sum(checked) < 120 * 119 // 4
