"""Exact joins, searches and graph operators against brute force on small data, with skew and ties."""

import hashlib
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import catalog as ct
from tessella.operators import context as cx
from tessella.operators import dedup as dd
from tessella.operators import enrich as en
from tessella.operators import fusion as fu
from tessella.operators import graph as gr
from tessella.operators import lifecycle as lc
from tessella.operators import retrieval as rt
from tessella.sources import files as fl
from tessella.streaming import ledger as lg

rng = random.Random(7)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_simhash_matches_plain_python(spark):
    texts = [(1, "a b a c"), (2, ""), (3, "会话 session Session"), (4, "x")]
    got = {r["doc_id"]: r["fingerprint"] for r in dd.simhash(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    toks = {1: ["a", "b", "a", "c"], 2: [], 3: ["会", "话", "session", "session"], 4: ["x"]}
    for k, ts in toks.items():
        v = [0] * 64
        for t in ts:
            h = int(hashlib.md5(t.encode()).hexdigest(), 16)
            for i in range(64):
                v[i] += 1 if h >> i & 1 else -1
        want = sum(1 << i for i in range(64) if v[i] > 0)
        assert got[k] == (want - (1 << 64) if want >= 1 << 63 else want)


def test_near_pairs_matches_brute_force_with_hot_copies(spark):
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list(base)
    for b in base:
        for _ in range(4):
            x = b
            for i in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << i
            values.append(x)
    values += [base[0]] * 200  # a third of all rows are one copy
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    got = rows(dd.near_pairs(spark.createDataFrame(signed, "fingerprint long")), "a", "b", "distance")
    distinct = sorted({v for v, in signed})
    want = sorted((a, b, bin((a ^ b) & ((1 << 64) - 1)).count("1")) for a, b in itertools.combinations(distinct, 2) if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 3)
    assert got == want and want


def test_similar_sets_matches_brute_force(spark):
    sets = [(i, rng.sample("abcdefghijklmnopqrst", rng.randint(2, 10))) for i in range(60)]
    sets += [(100 + i, sets[0][1]) for i in range(30)] + [(500, ["z"]), (501, [])]
    got = rows(dd.similar_sets(spark.createDataFrame(sets, "id long, tokens array<string>"), 0.6), "id_a", "id_b", "similarity")
    first = {}
    for i, s in sets:
        first.setdefault(frozenset(s), i)
    want = sorted((min(i, j), max(i, j), round(len(a & b) / len(a | b), 6)) for (a, i), (b, j) in itertools.combinations(first.items(), 2) if a | b and len(a & b) / len(a | b) >= 0.6)
    assert got == want and want


def test_containing_matches_brute_force_on_both_ways(spark):
    texts = [(i, "".join(rng.choice("abc 会") for _ in range(30))) for i in range(80)]
    needles = ["a", "ab", "abc", "c a", "会", "会a", "zzz", "aaaa", ""]
    t = spark.createDataFrame(texts, "id long, text string")
    n = spark.createDataFrame([(x,) for x in needles], "term string")
    want = sorted((x, i) for x in needles if x for i, s in texts if x in s)
    assert rows(rt.containing(n, t), "term", "id") == want
    assert rows(rt.containing(n, t, max_shared=1), "term", "id") == want


def test_dense_top_k_shared_blockwise_and_grouped(spark):
    gen = np.random.default_rng(3)
    v = gen.normal(size=(300, 8)).round(2)
    v[10:20] = v[5]  # ties
    data = [(i, [float(x) for x in r], int(i % 3)) for i, r in enumerate(v)]
    df = spark.createDataFrame(data, "unit_id long, vector array<double>, group int")
    q = df.filter("unit_id < 12").withColumnRenamed("unit_id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)

    def want(grouped):
        out = []
        for i in range(12):
            s = np.round(unit[i] @ unit.T, 6)
            ok = [j for j in range(300) if not grouped or j % 3 == i % 3]
            out += [(i, j, n + 1) for n, j in enumerate(sorted(ok, key=lambda j: (-s[j], j))[:5])]
        return sorted(out)

    plain = df.drop("group")
    for queries, vectors, grouped in ((q.drop("group"), plain, False), (q, df, True)):
        for shared in (100, 3):
            got = rt.dense_top_k(queries, vectors, 5, 8, max_shared_queries=shared, block=4)
            assert rows(got, "query_id", "unit_id", "rank") == want(grouped)
    assert rt.dense_top_k(q, df, 5, 9).count() == 0  # wrong dimension


def test_bm25_prefers_title_hits_and_is_partition_independent(spark):
    u = spark.createDataFrame([("a", "smf", "smf x", "x"), ("b", "y", "smf y", "smf"), ("c", "z", "z", "z")], "unit_id string, title string, search_text string, text string")
    q = rt.query_terms(spark.createDataFrame([(1, "the SMF")], "query_id long, query string"))
    got = rows(rt.top_k(rt.bm25(q, u), 5), "rank", "unit_id")
    assert got == [(1, "a"), (2, "b")]
    assert rows(rt.bm25(q, u.repartition(7)), "unit_id", "score") == rows(rt.bm25(q, u.coalesce(1)), "unit_id", "score")


def test_query_terms_fall_back_to_all_tokens(spark):
    q = spark.createDataFrame([(1, "the of"), (2, "x 话 y")], "query_id long, query string")
    assert rows(rt.query_terms(q), "query_id", "term") == [(1, "of"), (1, "the"), (2, "话")]


def test_graph_reach_equals_path_enumeration(spark):
    nodes = "abcdefgh"
    edges = [(x, y, round(rng.uniform(0.5, 1), 2)) for x, y in itertools.combinations(nodes, 2) if rng.random() < 0.5]
    best = {}

    def walk(path, conf):
        n, hop = path[-1], len(path) - 1
        h, c = best.get(n, (hop, conf))
        best[n] = (min(h, hop), max(c, conf))
        if hop < 3:
            for x, y, w in edges:
                for a, b in ((x, y), (y, x)):
                    if a == n and b not in path and w >= 0.6:
                        walk(path + [b], conf * w)

    walk(["a"], 1.0)
    got = rt.graph_reach(spark.createDataFrame([(1, "a")], "query_id long, entity_id string"), spark.createDataFrame(edges, "head string, tail string, confidence double"), 3, 0.6)
    assert {r["entity_id"]: (r["hop"], round(r["conf"], 9)) for r in got.collect()} == {k: (h, round(c, 9)) for k, (h, c) in best.items()}


def test_expand_first_visit_and_budget(spark):
    edges = [("s", "a", "elaborates", "1"), ("s", "b", "causes", "2"), ("b", "c", "elaborates", "3"), ("a", "s", "next", "4"), ("a", "d", "next", "5")]
    r = spark.createDataFrame(edges, "source_id string, target_id string, relation_type string, relation_id string")
    seed = spark.createDataFrame([(1, "s")], "query_id long, segment_id string")
    assert rows(rt.expand(seed, r, 2), "segment_id", "distance") == [("a", 1), ("b", 1), ("c", 2), ("d", 2)]
    assert rows(rt.expand(seed, r, 2, budget=3), "segment_id", "distance") == [("a", 1), ("b", 1), ("c", 2)]
    assert rows(rt.expand(seed, r, 1, budget=1), "segment_id", "distance") == [("a", 1)]
    assert rows(rt.expand(seed, r, 1, types=["causes"]), "segment_id", "distance") == [("b", 1)]


def test_cascade_runs_later_levels_for_unanswered_queries_only(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    first = lambda x: x.filter("query_id = 1").withColumn("unit_id", F.lit("u1"))
    second = lambda x: x.filter("query_id <= 2").withColumn("unit_id", F.lit("u2"))
    assert rows(rt.cascade(q, [("one", first), ("two", second)]), "query_id", "source") == [(1, "one"), (2, "two")]


def test_npmi_edges_of_the_scale(spark):
    df = spark.createDataFrame([(0.6, 0.6, 0.2), (1.0, 1.0, 1.0), (0.5, 0.5, 0.0)], "h double, t double, b double")
    got = [round(r[0], 6) for r in df.select(gr.npmi(F.col("h"), F.col("t"), F.col("b"))).collect()]
    assert got[0] < 0 and got[1] == 1.0 and got[2] == -1.0


def test_co_mentions_fold_repeats_and_match_wildcards(spark):
    refs = spark.createDataFrame([(1, "nf", "SMF"), (1, "nf", "SMF"), (1, "if", "N4"), (2, "nf", "SMF")], "segment_id long, type string, key string")
    pairs = en.co_mentions(refs)
    assert rows(pairs, "head", "tail") == [("N4", "SMF"), ("SMF", "N4")]
    rel = en.candidate_relations(pairs, [("uses", "nf", "*")])
    assert rows(rel, "head", "relation_type", "tail") == [("SMF", "uses", "N4")]
    assert rows(en.off_schema_pairs(pairs, [("uses", "nf", "*")]), "head", "tail") == [("N4", "SMF")]


def test_merge_roots_follow_chains(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x")], "drop_id string, primary_id string")
    assert rows(gr.merge_roots(m), "drop_id", "primary_id") == [("a", "d"), ("b", "d"), ("c", "d")]


def test_entity_members_split_hot_lists(spark):
    e = spark.createDataFrame([("hot",), ("cold",)], "entity_id string")
    m = spark.createDataFrame([("hot", i, "m") for i in range(100)], "entity_id string, segment_id long, mention_text string")
    got = gr.entity_members(e, m, chunk=10).select("entity_id", F.size("members").alias("n")).collect()
    assert sum(r["n"] for r in got if r["entity_id"] == "hot") == 100 and max(r["n"] for r in got) < 40
    assert [r["n"] for r in got if r["entity_id"] == "cold"] == [0]


def test_fusion_ties_and_weights(spark):
    c = spark.createDataFrame([(1, "x", "a", 1.0, 1.0), (1, "x", "b", 1.0, 1.0), (1, "y", "b", 5.0, 0.5)], "query_id long, route string, unit_id string, score double, weight double")
    got = {r["unit_id"]: r["fusion_score"] for r in fu.rrf(c, weighted=True).collect()}
    assert got == {"a": round(1 / 61, 9), "b": round(1 / 62 + 0.5 / 61, 9)}


def test_llm_ranking_ignores_bad_indices(spark):
    c = spark.createDataFrame([(1, f"u{i}", 1.0 - i / 10, i + 1) for i in range(4)], "query_id long, unit_id string, score double, rank int")
    r = spark.createDataFrame([(1, [(2, 0.9), (2, 0.1), (9, 1.0), (-1, 1.0), (0, None)])], "query_id long, ranking array<struct<index:int,score:double>>")
    got = [(x["unit_id"], x["score"]) for x in fu.apply_ranking(c, r, window=3).orderBy("rank").collect()]
    assert got == [("u2", 0.9), ("u0", 1.0), ("u1", 0.9), ("u3", 0.7)]


def test_drop_similar_texts_is_greedy(spark):
    c = spark.createDataFrame([(1, "a", 3.0, "the same long text"), (1, "b", 2.0, "the same long text"), (1, "c", 1.0, "other words"), (1, "d", 0.5, "")], "query_id long, unit_id string, score double, text string")
    assert rows(fu.drop_similar_texts(c), "unit_id") == [("a",), ("c",), ("d",)]


def test_rerank_batches_respect_both_limits(spark):
    c = spark.createDataFrame([(1, f"u{i}", i, "x" * 50) for i in range(1, 8)], "query_id long, unit_id string, rank int, text string")
    got = fu.rerank_batches(c, doc_chars=40, batch_docs=3, batch_chars=100)
    assert rows(got, "rank", "batch_id") == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3)]
    assert got.agg(F.max(F.length("document"))).first()[0] == 40


def test_lifecycle_action_table(spark):
    cases = [
        ((None, "h", None, None, None, None), "NEW"), ((True, "h", "h", True, None, None), "SKIP"), ((True, "h", "h", False, None, None), "UPDATE"),
        ((True, "h", None, None, "h", True), "RESTORE"), ((True, "h", None, None, "h", None), "UPDATE"), ((True, "h", "g", True, "h", True), "UPDATE"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "k boolean, n string, ah string, ac boolean, hh string, hc boolean")
    got = [r[0] for r in df.coalesce(1).select(lc.lifecycle_action(*[F.col(c) for c in ("k", "n", "ah", "ac", "hh", "hc")])).collect()]
    assert got == [w for _, w in cases]


def test_publish_keeps_one_active_release(spark):
    old = spark.createDataFrame([(1, 1, "d", "prod", "active", None, 1)], "release_id long, build_id long, domain string, channel string, status string, previous_release_id long, activated_at long")
    new = spark.createDataFrame([(2, 2, "d", "prod", 5), (3, 3, "d", "prod", 9), (4, 4, "e", "prod", 1)], "release_id long, build_id long, domain string, channel string, activated_at long")
    out = lc.publish(old, new)
    assert rows(out, "release_id", "status") == [(1, "retired"), (2, "retired"), (3, "active"), (4, "active")]
    assert lc.duplicate_active(out).count() == 0


def test_open_stage_and_progress_edges(spark):
    e = spark.createDataFrame([(1, "r", 1, "s", "started", 10), (2, "r", 1, "s", "completed", 20), (3, "r", 1, "s", "started", 30), (4, "r", 2, "s", "completed", 5)],
                              "event_id long, run_id string, document_id long, stage string, status string, created_at long")
    assert rows(ct.open_stages(e), "document_id", "started_at") == [(1, 30)]


def test_evidence_roles(spark):
    df = spark.createDataFrame([("seed", 0.9, "satellite", None), ("seed", 0.9, "nucleus", None), ("support", 0.1, "nucleus", "contrasts_with"), ("context", 0.5, "standalone", None), ("context", 0.5, "satellite", None)],
                               "role string, score double, d string, rel string")
    got = [r[0] for r in df.coalesce(1).select(cx.evidence_role(*[F.col(c) for c in ("role", "score", "d", "rel")])).collect()]
    assert got == ["support", "direct_answer", "contrast", "support", "background"]


def test_upsert_modes(spark):
    s = "k int, v string, w string"
    old, new = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], s), spark.createDataFrame([(2, None, "z"), (3, "c", None)], s)
    assert rows(fl.upsert(old, new, ["k"]).na.fill("-"), "k", "v", "w") == [(1, "a", "x"), (2, "-", "z"), (3, "c", "-")]
    assert rows(fl.upsert(old, new, ["k"], "keep").na.fill("-"), "k", "v", "w") == [(1, "a", "x"), (2, "b", "z"), (3, "c", "-")]
    assert rows(fl.upsert(old, new, ["k"], "ignore").na.fill("-"), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]


def test_scan_decode_and_titles(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("x\n # Title \n")
    (tmp_path / "b.html").write_bytes('<meta charset="gb2312"><p>会话</p>'.encode("gb18030"))
    (tmp_path / "c.bin").write_bytes(b"\xff")
    (tmp_path / "bad.txt").write_bytes(b"ok \xff")
    (tmp_path / "manifest.json").write_text("{}")
    f = fl.scan_files(spark, str(tmp_path))
    got = {r["file_name"]: r for r in f.collect()}
    assert {n: r["outcome"] for n, r in got.items()} == {"a.md": "parsed", "b.html": "parsed", "c.bin": "unparsed", "bad.txt": "parsed", "manifest.json": "skipped"}
    assert "会话" in got["b.html"]["text"] and got["bad.txt"]["text"] == "ok �"
    titles = f.filter("outcome = 'parsed'").select(fl.infer_title(F.col("file_type"), F.col("text"), F.col("file_name")).alias("t"))
    assert sorted(r["t"] for r in titles.collect()) == ["Title", "b", "bad"]


def test_reload_tolerates_only_optional_tables(spark, tmp_path):
    df = spark.range(3)
    fl.dump_tables({"a": df}, str(tmp_path))
    got = fl.reload_tables(spark, str(tmp_path), {"a": df.schema, "b": df.schema}, optional=("b",))
    assert got["a"].count() == 3 and got["b"].count() == 0


def test_log_stream_and_stalled_stages(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    data = [(1, "r", 1, "s", "started", t(0)), (2, "r", 1, "s", "completed", t(30)), (3, "r", 2, "s", "started", t(5)), (4, "r", 2, "s", "completed", t(90)), (5, "r", 3, "s", "started", t(600))]
    df = spark.createDataFrame(data, "event_id long, run_id string, document_id long, stage string, status string, created_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lg.read_stream(spark, str(tmp_path / "in"), df.schema)
    assert rows(lg.drain(lg.stalled_stages(stream)), "event_id") == [(3,)]
    assert rows(lg.stalled_stages(df), "event_id") == [(3,), (5,)]
    q = fl.log_stream(stream.withColumn("text", F.lit("secret")), str(tmp_path / "log"), str(tmp_path / "cp"))
    q.awaitTermination()
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 5 and "text" not in back.columns
