"""The hidden Markov language model against plain Python loops over single documents."""

import re
import zlib
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from llm import hmm, words

SMALL = hmm.Setting(states=3, rounds=2, share=1500, fewest=3, segment=7, run_bytes=4000)


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[ \t-\r]+", lower) if w] + [None]


def hashed(word):
    if word is None:
        return hmm.END
    _, data, offsets = next(words.slices(pa.array([word])))
    return words.Texts(data, offsets, lower=True).hashes()[0]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def plain(rows, setting):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text) rows."""
    texts = [(i, tokens(t)) for i, t in rows]
    learn = [t for i, t in texts if not held(i)]
    c = {}
    for w in (w for t in learn for w in t):
        c[w] = c.get(w, 0) + 1
    total, distinct = sum(c.values()), len(c)
    frequent = {w for w, n in c.items() if n >= max(setting.fewest, -(-total // setting.share))}
    rare_mass = sum(n for w, n in c.items() if w not in frequent) + 0.1 * (distinct - len(frequent) + 1)
    mass = sum(c[w] for w in frequent) + rare_mass
    k = setting.states
    own = {w: c[w] * hmm.scattered(np.array([hashed(w)], np.uint64), k)[0] for w in frequent} | {"rare": np.full(k, rare_mass)}
    start = np.full(k, 1 / k)
    away = (1 - setting.stay) / (k - 1)
    moves = np.array([[setting.stay if i == j else away for j in range(k)] for i in range(k)])

    def drawn(w):
        w = w if w in frequent else "rare"
        whole = (c[w] if w != "rare" else rare_mass) / mass
        mine = np.array([(1 - setting.mix) * (own[w][z] / totals[z] if totals[z] > 0 else whole) for z in range(k)])
        return w, mine + setting.mix * whole, mine / (mine + setting.mix * whole)

    def forward(text):
        out, now, logs = [], start, 0.0
        for w in text:
            a = now * drawn(w)[1]
            logs += log10(a.sum())
            out.append((a / a.sum(), a.sum()))
            now = out[-1][0] @ moves
        return out, logs

    totals = sum(own.values())
    for _ in range(setting.rounds):
        new, first, crossed = {w: np.zeros(k) for w in own}, np.zeros(k), np.zeros((k, k))
        for text in learn:
            ahead, _ = forward(text)
            after = np.ones(k)
            for t in range(len(text) - 1, -1, -1):
                w, p, share = drawn(text[t])
                visit = ahead[t][0] * after
                assert visit.sum() == pytest.approx(1)
                new[w] += visit * share
                message = p * after / ahead[t][1]
                if t:
                    crossed += np.outer(ahead[t - 1][0], message) * moves
                    after = moves @ message
                else:
                    first += visit
        own, totals = new, sum(new.values())
        start = (first + 1 / k) / (first.sum() + 1)
        moves = (crossed + 1 / k) / (crossed.sum(1, keepdims=True) + 1)
    out = []
    for i, text in texts:
        score = forward(text)[1] + sum(log10((c.get(w, 0) + 0.1) / rare_mass) for w in text if w not in frequent)
        base = sum(log10((c.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in text)
        out.append((i, held(i), len(text), sum(w in c for w in text), total, base, score))
    return out


def close(got, want):
    def key(r):
        return (r[0] is None, r[0] or 0, r[2], r[5])

    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and g[6] == pytest.approx(w[6], rel=2e-5, abs=1e-4)


def test_scores_match_plain(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 20000]
    close(hmm.score_documents(docs.where("text is null or length(text) < 20000"), SMALL).collect(), plain(rows, SMALL))


def test_every_learnt_word_has_its_own_emission(docs):
    """Words learnt once, too: nothing but the unknown word is in the class of one emission unless a setting asks for it."""
    some = docs.where("text is null or length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    got = hmm.score_documents(some, hmm.Setting(states=3, rounds=2, segment=7, run_bytes=4000)).collect()
    close(got, plain(rows, hmm.Setting(states=3, rounds=2, share=1 << 62, fewest=1)))


def test_runs_and_segments_change_nothing(docs):
    def scores(setting):
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score, r.score) for r in hmm.score_documents(docs, setting).collect())

    for a, b in zip(scores(SMALL), scores(SMALL._replace(segment=100000, run_bytes=1 << 24))):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=2e-5)


def test_nothing_learnt_and_empty(spark, empty):
    assert hmm.score_documents(empty).collect() == []
    own = spark.createDataFrame([(None, "some words"), (None, None)], "doc_id long, text string")
    got = sorted(hmm.score_documents(own).collect(), key=lambda r: r.n_tokens)
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(True, 1, 0, 0), (True, 3, 0, 0)]
    assert all(abs(r.base_score) < 1e-12 and abs(r.score) < 1e-12 for r in got)


def test_probabilities_sum_to_one():
    counts = hmm.Counts(tokens=50, words=9, least=10, rare_tokens=7, rare_words=5)
    own = np.array([[9.0, 1], [4, 6], [0, 13], [1, 9]])
    model = hmm.Model(np.array([.5, .5]), np.eye(2), own.sum(0) + [2.0, 5], np.array([2.0, 5]))
    p, _ = hmm.emissions(model, counts, own, np.array([10, 10, 13, 10]), 0.05)
    assert p.sum(0) == pytest.approx([1, 1])
    assert sum(10 ** counts.within_rare(np.array([1, 1, 1, 2, 2, 0]))) == pytest.approx(1)


def test_better_than_single_words(spark):
    """Two sorts of texts with words of their own: states tell them apart on held-out texts."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{w}" for w in rng.zipf(1.4, 60) % 50)) for i in range(800)]
    got = hmm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hmm.Setting(rounds=5)).where("held_out").collect()
    assert len(got) > 50 and sum(r.score for r in got) > .93 * sum(r.base_score for r in got)
