"""Python workers hold slices of a batch, not all that a batch becomes."""

import numpy as np

from tessella.operators import dense as dn
from tessella.operators import structure as st


def test_runs_of_rows_are_bounded():
    rows = [((i, "x" * (i % 7)), i % 7) for i in range(1000)]
    runs = list(st.row_runs(iter(rows), most=40, characters=100))
    assert [r for run in runs for r in run] == [r for r, _ in rows] and max(map(len, runs)) <= 40
    assert all(sum(len(t) for _, t in run) < 106 for run in runs)
    drawn = []

    def counted():
        for i in range(1000):
            drawn.append(i)
            yield (i,), 1

    assert len(next(st.row_runs(counted(), most=50))) == 50 and len(drawn) == 50


def test_markdown_of_more_blocks_than_a_run(spark):
    text = "\n\n".join(f"# h{i}\n\nline {i}" for i in range(3000))
    got = st.parse_markdown(spark.createDataFrame([(1, text), (2, None), (3, "a")], "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.block_index) for r in got] == [(1, i) for i in range(6000)] + [(3, 0)]
    assert got[2].text == "h1" and got[2].level == 1 and got[3].level is None


def test_more_queries_than_a_slice_equal_brute_force(spark):
    """Several groups, one of them without vectors, and more queries in a batch than are bounded at a time."""
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(900, 6)), rng.normal(size=(2 * dn.QUERIES + 50, 6))
    vectors = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "unit_id int, group int, vector array<double>")
    queries = spark.createDataFrame([(i, i % 4, x.tolist()) for i, x in enumerate(q)], "query_id int, group int, vector array<double>").coalesce(1)
    got = {}
    for r in dn.cell_search(queries, dn.build_cells(vectors, 6), 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.unit_id, r.score))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(v).T, 6)
    for i in range(len(q)):
        own = [j for j in range(len(v)) if j % 3 == i % 4]
        want = sorted(own, key=lambda j: (-scores[i, j], j))[:3]
        assert [u for _, u, _ in sorted(got.get(i, []))] == want
