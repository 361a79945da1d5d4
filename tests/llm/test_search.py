"""Ranked lexical search against plain Python."""

import math
import re

import numpy as np

from llm import search


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(docs, items, k=10):
    cut = [(i, terms(t)) for i, t in docs]
    n, length = sum(bool(t) for _, t in cut), sum(len(t) for _, t in cut)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in d for _, d in cut) + 1))) for t in set().union(*wanted.values())}
    out = []
    for item, own in wanted.items():
        found = []
        for i, d in cut:
            m = 10 + 90 * len(d) * n // max(length, 1)
            score = sum(weight[t] * (1000000000 * d.count(t) // (1000 * d.count(t) + 8 * m)) for t in own if t in d)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out)


def items_of(spark, corpus):
    texts = [t for _, t in corpus if t]
    rows = [(0, texts[0]), (1, " ".join(texts[4].split()[:6]).upper()), (2, texts[31]), (3, "nothing-like_this"), (4, None), (5, ""), (6, "the, one"),
            (7, texts[40][:300]), (None, texts[2]), (8, "the"), (8, "naïve two"), (9, "amber1 birch2 cedar3 delta4 ember5")]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, term string, score int")


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_ranks_match_plain(spark, docs, corpus):
    rows, items = items_of(spark, corpus)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], rows)
    assert len(want) > 40
    assert got(search.rank_documents(docs, items)) == want
    assert got(search.rank_documents(docs, items, item_terms=40, shard_docs=9)) == want


def test_empty(spark, docs, empty, corpus):
    _, items = items_of(spark, corpus)
    assert got(search.rank_documents(empty, items)) == []
    assert got(search.rank_documents(docs, items.limit(0))) == []


def shard(groups=40, n=3000):
    """Documents of some groups with words of their own, and ten common words of little weight."""
    rng = np.random.default_rng(1)
    ptr, term, quotient = [0], [], []
    for d in range(n):
        common = np.sort(rng.choice(10, 4, replace=False))
        term += [*common.tolist(), *range(10 + 8 * (d % groups), 18 + 8 * (d % groups))]
        quotient += rng.integers(1, 10**6, 12).tolist()
        ptr.append(len(term))
    weights = np.append(np.full(10, 300), rng.integers(3000, 5000, 8 * groups))
    return search.Shard(np.array(ptr), np.array(term), np.array(quotient), weights), rng


def test_blocks_hold_a_list_and_summaries_bound_all_scores():
    s, rng = shard()
    for t in (0, 5, 9, 10, 55):
        docs, bounds = s.blocks(t)
        assert sorted(docs) == np.flatnonzero(s.table[t]).tolist()
        assert bounds[0] == 0 and bounds[-1] == len(docs) and 0 < np.diff(bounds).min() <= np.diff(bounds).max() <= search.BLOCK
        own = np.unique(np.append(rng.choice(len(s.weights), 12, replace=False), t))
        tops = s.weights[own] @ s.summaries(docs, bounds, own).astype(np.int64)
        scores = s.scores(docs, own)
        assert all(scores[a:b].max() <= top for a, b, top in zip(bounds[:-1], bounds[1:], tops))


def test_blocks_are_skipped_and_nothing_is_lost():
    s, rng = shard()
    ids, none = np.arange(3000)[::-1].copy(), np.zeros(3000, bool)
    own = [np.sort(np.append(rng.choice(10, 3, replace=False), 10 + 8 * g + rng.choice(8, 5, replace=False))) for g in range(40)]
    best = [search._Best(10) for _ in own]
    taken = s.search(own, best, ids, none)
    listed = 0
    for terms, found in zip(own, best):
        every = s.scores(np.arange(3000), terms)
        listed += int((every > 0).sum())
        assert list(zip((-found.score).tolist(), found.doc.tolist())) == sorted((-int(x), int(i)) for x, i in zip(every, ids) if x > 0)[:10]
    assert taken < .3 * listed
