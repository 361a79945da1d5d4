"""Stored postings, cells of vectors and hub-split hops against brute force, with ties, hot terms, copies and scopes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import dense as dn
from tessella.operators import graph as gr
from tessella.operators import index as ix
from tessella.operators import retrieval as rt

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(11)
    rows = []
    for i in range(400):
        # "the" stands in all units, other words are the rarer the higher their number; some units are copies.
        own = [WORDS[min(int(rng.expovariate(.03)), 299)] for _ in range(rng.randrange(0, 30))]
        text = " ".join(["the"] * (1 + i % 3) + own) if i % 50 else ""
        rows.append((f"u{i:03d}", own[0] if own else None, text, text, "ab"[i % 2]))
    rows += [(f"c{i:02d}", "w1", "w7 w8 会话", "w7 w8 会话", "a") for i in range(40)]
    return spark.createDataFrame(rows, "unit_id string, title string, search_text string, text string, kind string").repartition(5).cache()


@pytest.fixture(scope="module")
def terms(spark):
    rng = random.Random(3)
    rows = [(q, t) for q in range(30) for t in {"the", *rng.choices(WORDS[:250], k=rng.randrange(1, 14))}]
    return spark.createDataFrame(rows + [(30, "w7"), (30, "w8"), (31, "unknown"), (32, "会")], "query_id int, term string")


@pytest.fixture(scope="module")
def index(units, tmp_path_factory):
    return ix.build_index(units, f"file://{tmp_path_factory.mktemp('index')}", ("kind",), block=8)


def found(df):
    return sorted((r.query_id, r.rank, r.unit_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 50, 1000])
def test_search_equals_scoring_everything(units, terms, index, k):
    assert found(ix.search(index, terms, k)) == found(rt.top_k(rt.bm25(terms, units), k))


def test_scope_holds_before_the_cut(units, terms, index):
    inside = index.vectors.where("kind = 'b'").select("unit_id")
    got = ix.search(index, terms, 5, lambda c: c.join(inside, "unit_id", "left_semi"))
    assert found(got) == found(rt.top_k(rt.bm25(terms, units).join(inside, "unit_id", "left_semi"), 5))


def test_ladder(units, terms, index):
    few = index.vectors.where("unit_id in ('c01', 'u001')").select("unit_id")
    got = ix.search_ladder(index, terms, 4, [lambda c: c.join(few, "unit_id", "left_semi"), None])
    scored = rt.bm25(terms, units).join(few.withColumn("in_scope", F.lit(True)), "unit_id", "left").na.fill(False).withColumn("in_section", F.lit(True))
    assert found(got) == found(rt.top_k(rt.relaxation(scored), 4))


def test_vectors_and_blocks(units, index):
    want = rt.postings(units)
    assert sorted(map(tuple, ix.field_terms(units).select("unit_id", "field", "term", "tf").collect())) == sorted(map(tuple, want.select("unit_id", "field", "term", "tf").collect()))
    rows = index.blocks.collect()
    assert all(len(r.units) == len(r.sats) == r.n <= 8 and r.top == r.sats[0] and list(r.sats) == sorted(r.sats, reverse=True) for r in rows)
    assert {r.term: r.df for r in index.lexicon.collect()} == {r.term: r.df for r in want.select("unit_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df")).collect()}


def test_weak_terms_do_not_name_candidates(spark, tmp_path):
    """One rare and one common word: units with the common word alone can't rank, so their postings are only looked up."""
    rows = [(f"u{i:04d}", "", "", "common " + ("rare " if i % 100 == 0 else "") + f"x{i}") for i in range(2000)]
    u = spark.createDataFrame(rows, "unit_id string, title string, search_text string, text string")
    index = ix.build_index(u, f"file://{tmp_path}/i", block=16)
    terms = spark.createDataFrame([(1, "common"), (1, "rare")], "query_id int, term string")
    got = ix.search(index, terms, 10)
    assert found(got) == found(rt.top_k(rt.bm25(terms, u), 10))


def test_stored_index_follows_its_files(spark, tmp_path):
    u = [("a", "", "", "one two"), ("b", "", "", "two")]
    path, schema = f"file://{tmp_path}/units", "unit_id string, title string, search_text string, text string"
    terms = spark.createDataFrame([(1, "two"), (1, "three")], "query_id int, term string")
    for rows, want in ((u, ["b", "a"]), ([*u, ("c", "", "", "three")], ["c", "b", "a"])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
        for _ in range(2):
            got = ix.search(ix.stored_index(spark.read.parquet(path), "t"), terms, 5)
            assert [r.unit_id for r in sorted(got.collect(), key=lambda r: r.rank)] == want


def test_empty_index(spark, units, terms, tmp_path):
    index = ix.build_index(units.limit(0), f"file://{tmp_path}/i")
    assert ix.search(index, terms, 5).collect() == []
    assert ix.search(ix.build_index(units, f"file://{tmp_path}/j"), terms.limit(0), 5).collect() == []


# --- cells -------------------------------------------------------------------------------------


def brute(queries, vectors, k, least=-2.0):
    out = []
    for q, qv, qg in queries:
        best = {}
        for u, v, g in vectors:
            if v is None or len(v) != len(qv) or any(x is None or not math.isfinite(x) for x in v) or (qg is not None and g != qg):
                continue
            n = np.linalg.norm(qv) * np.linalg.norm(v)
            s = round(float(np.dot(qv, v) / n), 6) if n else 0.0
            best[u] = max(best.get(u, -9), s)
        ranked = sorted(((-s, u) for u, s in best.items() if s >= least))[:k]
        out += [(q, i + 1, u, -s) for i, (s, u) in enumerate(ranked)]
    return sorted(out)


def close(got, want):
    """Equal but for scores on a rounding edge."""
    assert [(r[0], r[1]) for r in got] == [(r[0], r[1]) for r in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))
    assert sum(a[2] != b[2] for a, b in zip(got, want)) <= len(want) // 100


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    vectors = [(int(i), (centres[i % 12] + .25 * rng.normal(size=8)).tolist(), i % 3) for i in range(1500)]
    # Copies of one vector, a unit with two vectors, a zero vector, wrong size, null and infinite numbers.
    vectors += [(2000 + i, vectors[5][1], 2) for i in range(300)] + [(7, (-centres[0]).tolist(), 1)]
    vectors += [(3000, [0.0] * 8, 0), (3001, [1.0] * 7, 0), (3002, [None] + [1.0] * 7, 0), (3003, [math.inf] + [1.0] * 7, 0), (3004, None, 0)]
    queries = [(i, (centres[i % 12] + .3 * rng.normal(size=8)).tolist(), i % 3) for i in range(60)]
    return queries, vectors


SCHEMA = "{0} int, vector array<double>, group int"


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("least", [-2.0, 0.9])
def test_cells_equal_brute_force(spark, points, grouped, least, monkeypatch):
    monkeypatch.setattr(dn, "PART_NUMBERS", 800)
    queries, vectors = points
    q, v = (spark.createDataFrame(p, SCHEMA.format(n)).repartition(3) for p, n in ((queries, "query_id"), (vectors, "unit_id")))
    if not grouped:
        q, v, queries = q.drop("group"), v.drop("group"), [(a, b, None) for a, b, _ in queries]
    cells = dn.build_cells(v, 8, cells=20)
    close(found(dn.cell_search(q, cells, 5, least)), brute(queries, vectors, 5, least))


def test_far_cells_are_not_read(spark, points):
    """Clustered vectors: after its nearest cells a query meets few others."""
    queries, vectors = points
    v = spark.createDataFrame(vectors, SCHEMA.format("unit_id")).drop("group")
    cells = dn.build_cells(v, 8, cells=20)
    angle = np.arccos(np.clip(np.array([np.array(q) / np.linalg.norm(q) for _, q, _ in queries]) @ cells.centres.T, -1, 1))
    width = {r.cell: r.width for r in cells.extents.collect()}
    floor = {q: s for q, rank, _, s in brute([(a, b, None) for a, b, _ in queries], vectors, 5) if rank == 5}
    met = [sum(math.cos(max(0.0, angle[i][c] - w)) >= floor[i] for c, w in width.items()) for i in range(len(queries))]
    assert np.mean(met) < .5 * len(width)


def test_cells_of_nothing(spark, points):
    queries, vectors = points
    q, v = (spark.createDataFrame(p, SCHEMA.format(n)) for p, n in ((queries, "query_id"), (vectors, "unit_id")))
    assert dn.cell_search(q, dn.build_cells(v.limit(0), 8), 5).collect() == []
    assert dn.cell_search(q.limit(0), dn.build_cells(v, 8), 5).collect() == []
    assert dn.cell_search(q, dn.build_cells(v, 9), 5).collect() == []


# --- hubs --------------------------------------------------------------------------------------


def test_hub_chunks_are_even(spark):
    star = spark.range(60000).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), "id").alias("dst"), F.lit(1.0).alias("w"))
    rest = spark.range(500).select(F.concat(F.lit("m"), "id").alias("src"), F.lit("hub").alias("dst"), F.lit(.5).alias("w"))
    adjacency, hubs = rt.split_hubs(star.union(rest), "src", 1000)
    assert [(r.src, r.chunks) for r in hubs.collect()] == [("hub", 60)]
    sizes = [r["count"] for r in adjacency.where("src = 'hub'").groupBy("chunk").count().collect()]
    assert len(sizes) == 60 and max(sizes) < 1.2 * 1000 and sum(sizes) == 60000
    front = spark.createDataFrame([(1, "hub"), (2, "m3"), (3, "nowhere")], "query_id int, entity_id string")
    met = rt.meet(front, "entity_id", adjacency, hubs, "src").groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in met} == {1: 60000, 2: 1}


def test_reach_through_hubs_equals_plain(spark):
    rng = random.Random(5)
    edges = [("h", f"n{i}", round(rng.random(), 3)) for i in range(150)] + [(f"n{rng.randrange(150)}", f"x{i}", round(rng.random(), 3)) for i in range(100)]
    e = spark.createDataFrame(edges, "head string, tail string, confidence double")
    seeds = spark.createDataFrame([(1, "n3"), (2, "x5"), (3, "h")], "query_id int, entity_id string")

    def rows(df):
        return sorted((r.query_id, r.entity_id, r.hop, round(r.conf, 9)) for r in df.collect())

    assert rows(rt.graph_reach(seeds, e, 3, .1, hub=10)) == rows(rt.graph_reach(seeds, e, 3, .1))
    own = e.select(F.col("head").alias("head_id"), F.col("tail").alias("tail_id"), "confidence")
    start = seeds.select(F.col("entity_id").alias("seed_id"))
    both = [sorted(map(tuple, gr.neighbourhood_edges(start, own, 2, hub).collect())) for hub in (10, 50000)]
    assert both[0] == both[1] and both[0]


# --- trigrams, sets, co-mentions ---------------------------------------------------------------


def test_trigram_search_equals_plain(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    u = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(300)] + [(900, "abc"), (901, "abc"), (902, "")]
    q = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 7)))) for i in range(25)] + [(90, "abc"), (91, "zzzz"), (92, u[5][1])]

    def grams(text):
        return {p[i:i + 3] for w in text.split() for p in [f"  {w} "] for i in range(len(p) - 2)}

    def kept(text):
        return " ".join(w for w in text.split() if len(w) >= 2 and w not in rt.STOPWORDS_EN) or text

    for threshold in (.3, .6, 1.0):
        want = set()
        for i, t in q:
            for j, v in u:
                a, b = grams(kept(t)), grams(v)
                if a and b and round(len(a & b) / len(a | b), 6) >= threshold:
                    want.add((i, j, round(len(a & b) / len(a | b), 6)))
        got = rt.trigram_similarity(spark.createDataFrame(q, "query_id int, query string"), spark.createDataFrame(u, "unit_id int, text string").repartition(4), threshold)
        rows = [(r.query_id, r.unit_id, r.score) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_similar_sets_equal_plain(spark):
    from tessella.operators import dedup as dd

    rng = random.Random(9)
    sets = [(i, ["the"] + rng.choices([f"t{j}" for j in range(30)], k=rng.randrange(0, 12))) for i in range(150)] + [(500, []), (501, []), (502, ["the"]), (503, ["the", "the"])]
    df = spark.createDataFrame(sets, "id int, tokens array<string>").repartition(3)
    first = {}
    for i, t in sets:
        first.setdefault(frozenset(t), []).append(i)
    for threshold in (.5, .7, .9):
        want = sorted((min(min(a), min(b)), max(min(a), min(b)), round(len(x & y) / len(x | y), 6)) for x, a in first.items() for y, b in first.items()
                      if min(a) < min(b) and x and y and round(len(x & y) / len(x | y), 6) >= threshold)
        got = dd.similar_sets(df, threshold).collect()
        assert sorted((r.id_a, r.id_b, r.similarity) for r in got) == want
        copies = {min(v): len(v) for v in first.values()}
        assert all((r.copies_a, r.copies_b) == (copies[r.id_a], copies[r.id_b]) for r in got)


@pytest.mark.parametrize("patterns", [[("made_by", "part", "maker")], [("near", "*", "place"), ("made_by", "part", "maker"), ("any", "part", "*")]])
def test_strong_edges_equal_the_long_way(spark, patterns):
    """Keys under several types, repeated mentions, one crowded segment."""
    from tessella.operators import enrich as en

    rng = random.Random(10)
    refs = [(s, rng.choice(["part", "maker", "place"]), f"k{rng.randrange(12)}") for s in range(60) for _ in range(rng.randrange(6))]
    refs += [(s, "part", f"p{rng.randrange(8)}") for s in range(60)] + [(s, "maker", f"m{rng.randrange(4)}") for s in range(60) for _ in range(2)]
    refs += [(1, "part", f"p{i}") for i in range(100)] + [(1, "maker", f"m{i}") for i in range(100)] + [(2, "maker", ""), (3, "part", "p1"), (3, "part", "p1")]
    df = spark.createDataFrame(refs, "segment_id int, type string, key string").repartition(3)
    edges = gr.aggregate_edges(en.candidate_relations(en.co_mentions(df), patterns))
    want = gr.edge_strength(edges, df.where("length(key) > 0").select("segment_id", "key"), 60)
    columns = ["head", "relation_type", "tail", "cooccur", "first_segment", "npmi"]
    got = gr.strong_edges(df, patterns, 60, hub=20)
    # A key under several types may make one edge out of pairs of several types; the types named are then the least ones.
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


# --- as-of ---------------------------------------------------------------------------------------


def test_as_of_batches_equal_plain_with_a_hot_document(spark):
    """A document with very many links, links and builds at one time, ambiguous batches, stretches without links, nulls."""
    import datetime as dt

    from tessella.operators import lifecycle as lc

    rng = random.Random(12)
    start = dt.datetime(2020, 1, 1)
    links = [(1, rng.randrange(2), rng.randrange(5), start + dt.timedelta(minutes=10 * rng.randrange(40000))) for _ in range(20000)]
    links += [(d, rng.randrange(2), rng.randrange(3), start + dt.timedelta(days=rng.randrange(400))) for d in range(2, 20) for _ in range(rng.randrange(6))]
    links += [(2, 0, None, start), (3, 1, 1, None)]
    picks = [(b, d, s, start + dt.timedelta(days=rng.randrange(-5, 500))) for b in range(8) for d in range(1, 22) for s in rng.sample(range(3), rng.randrange(1, 3))]
    picks += [(99, 1, 0, links[0][3]), (98, 5, 0, None)]
    want = {}
    for b, d, s, t in picks:
        if t is not None:
            for x in links:
                if x[0] == d and x[1] == s and x[2] is not None and x[3] is not None and x[3] <= t:
                    want.setdefault((b, d), []).append((x[3], x[2]))
    expect = set()
    for key, marks in want.items():
        last = {v for t, v in marks if t == max(t for t, _ in marks)}
        if len(last) == 1:
            expect.add((*key, last.pop()))
    got = lc.backfill_batch(spark.createDataFrame(picks, "build_id int, document_id int, snapshot_id int, created_at timestamp"),
                            spark.createDataFrame(links, "document_id int, snapshot_id int, batch_id int, linked_at timestamp").repartition(4))
    assert {tuple(r) for r in got.collect()} == expect and len(expect) > 60
