"""Operators on vectors and links against plain numpy."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import vectors
from llm.components import components


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(240, 16))
    out = [v.tolist() for v in base]
    out += [(base[k % 20] + rng.normal(size=16) * .05).tolist() for k in range(60)]
    out += [out[7], out[7], out[8], [0.0] * 16, None, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], (np.array(out[9]) * 3).tolist()]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(rows)] + [(None, rows[0], 1, "x")], "vec_id long, embedding array<double>, score int, key string").repartition(3)


def usable(rows):
    return [i for i, v in enumerate(rows) if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]


def test_nearest(frame, rows):
    got = collections.defaultdict(list)
    for r in vectors.nearest_vectors(frame, F.col("id") % 20 == 0, k=20, lists=4, probe_share=1.0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = usable(rows)
    m = np.array([rows[i] for i in ids], float)
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        score = m @ np.array(rows[q])
        best = sorted(((-s, i) for s, i in zip(score, ids) if i != q))[:20]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, 21)) and q not in [v for _, v, _ in mine]
        assert all(s == pytest.approx(float(np.dot(rows[v], rows[q])), abs=1e-12) for _, v, s in mine)
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {i for _, i in best})
        total += 20
    assert set(got) == {i for i in ids if i % 20 == 0} and hits / total > .97


def test_equal_vectors_tie_to_smaller_ids(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(90)], "vec_id long, embedding array<double>")
    got = vectors.nearest_vectors(frame, F.col("id") % 20 == 0, k=5).where("query_id = 20").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4] and {r["score"] for r in got} == {1.0}
    few = vectors.nearest_vectors(frame.where("vec_id < 3"), F.col("id") == 0, k=5).collect()
    assert len(few) == 2
    assert vectors.nearest_vectors(frame.limit(0), F.col("id") == 0).count() == 0


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [rows[0]] * 29 + [rows[20]] + [r for r in rows[1:15] for _ in range(9)]  # query rows 30 times and twice, candidates 10 times
    rows += [(40, rng.normal(size=4).tolist())] + [(50 + i, (np.array(rows[0][1]) * (2 + j)).tolist()) for i in range(3) for j in range(4)]  # ids with several vectors
    by_id = collections.defaultdict(list)
    for i, v in rows:
        by_id[i].append(np.array(v))
    got = vectors.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=5, lists=2, probe_share=1.0).collect()
    for q in (0, 20, 40):
        best = sorted((-max(float(a @ b) for a in by_id[q] for b in by_id[i]), i) for i in by_id if i != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(n, i) for n, i, _ in mine] == [(n + 1, i) for n, (_, i) in enumerate(best)] and [s for *_, s in mine] == pytest.approx([-s for s, _ in best])


def test_scan_abandons_only_far_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50] @ vectors.rotation(64)
    s = q @ (x @ vectors.rotation(64)).T
    floor = np.sort(s, axis=1)[:, -21]
    i, j, cost = vectors.scan_block(q, x @ vectors.rotation(64), floor, 20)
    want = {(a, b) for a in range(50) for b in np.argsort(-s[a])[:20]}
    assert len(want & set(zip(i.tolist(), j.tolist()))) / len(want) > .97
    assert cost < .7 * s.size * 64


def _links(rows):
    ids = usable(rows)
    m = np.array([rows[i] for i in ids], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= .9
    n = {i: int(near[k].sum()) - 1 for k, i in enumerate(ids)}
    root = {i: i for i in range(len(rows))}
    for _ in ids:
        for k, i in enumerate(ids):
            low = min(root[ids[j]] for j in np.flatnonzero(near[k]))
            for j in np.flatnonzero(near[k]):
                root[ids[j]] = low
    return n, root


@pytest.mark.parametrize("block", [2048, 16])
def test_near_vectors(frame, rows, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    n, root = _links(rows)
    got = vectors.link_vectors(frame, tables=40, width=3.0).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(len(rows)))
    copies = n[0] + 1  # the row without id takes no part
    assert copies >= 1
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (n.get(i, 0), root[i], root[i] == i), i
    assert vectors.link_vectors(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {i: i for e in links for i in e}
    for _ in range(70):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(links + [(5, 5), (None, 3), (4, None)] + links[:5], "a long, b long")
    own = {a for a, b in links if a != b} | {b for a, b in links if a != b}
    assert {r["id"]: r["component"] for r in components(frame).collect()} == {i: root[i] for i in own}
    assert components(frame.limit(0)).count() == 0
