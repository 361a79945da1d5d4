"""Co-mention edges counted in one pass, and type pairs outside the schema without their pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import enrich as en
from tessella.operators import graph as gr

PATTERNS = [[("made_by", "part", "maker")], [("near", "*", "place"), ("made_by", "part", "maker"), ("any", "part", "*")]]


def _refs(spark, mixed: bool):
    rng = random.Random(3)
    refs = [(s, "part", f"p{rng.randrange(9)}") for s in range(50) for _ in range(2)] + [(s, "maker", f"m{rng.randrange(5)}") for s in range(50)]
    refs += [(1, "part", f"p{i}") for i in range(60)] + [(1, "maker", f"m{i}") for i in range(60)] + [(2, "maker", "")]
    if mixed:
        refs += [(s, rng.choice(["part", "maker", "place"]), f"k{rng.randrange(6)}") for s in range(50) for _ in range(3)]
    return spark.createDataFrame(refs, "segment_id int, type string, key string").repartition(3)


def _rows(df, columns):
    return sorted(map(tuple, df.select(columns).collect()))


@pytest.mark.parametrize("patterns", PATTERNS)
@pytest.mark.parametrize("mixed", [False, True])
def test_edges_equal_the_long_way(spark, patterns, mixed):
    df = _refs(spark, mixed)
    want = gr.aggregate_edges(en.candidate_relations(en.co_mentions(df), patterns))
    assert _rows(gr.co_mention_edges(df, patterns, hub=20), want.columns) == _rows(want, want.columns)
    one = df.where("length(key) > 0").select("type", "key").distinct()
    named = one.where("key not in ('p3', 'm2')").select(
        F.concat_ws(":", "type", "key").alias("entity_id"), F.col("type").alias("node_type"), F.col("key").alias("canonical_name"))
    plain = gr.kept_edges(gr.strong_edges(df, patterns, 50, hub=20), named, -1.0)
    assert _rows(gr.kept_edges(gr.strong_edges(df, patterns, 50, 20, named), floor=-1.0), plain.columns) == _rows(plain, plain.columns)
    assert plain.count() > 20


def test_pairs_are_shuffled_once(spark):
    df = _refs(spark, False)
    named = df.select(F.col("key").alias("entity_id"), F.col("type").alias("node_type"), F.col("key").alias("canonical_name")).distinct()
    plan = gr.kept_edges(gr.strong_edges(df, PATTERNS[0], 50, 20, named))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(head", plan)) == 1 and "hashpartitioning(tail" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("patterns", PATTERNS)
@pytest.mark.parametrize("mixed", [False, True])
def test_off_schema_without_pairs(spark, patterns, mixed):
    df = _refs(spark, mixed)
    want = gr.off_schema_candidates(en.off_schema_pairs(en.co_mentions(df), patterns))
    assert _rows(gr.off_schema_summary(df, patterns), want.columns) == _rows(want, want.columns)
    plan = gr.off_schema_summary(df, patterns)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" in plan or "broadcast" in plan


def test_recompute_equals_a_rebuild(spark):
    df = _refs(spark, False).where("length(key) > 0")
    mentions = df.select("segment_id", F.col("key").alias("entity_id"), F.lit("auto").alias("resolve_status"))
    entities = df.select(F.col("key").alias("entity_id"), F.col("type").alias("node_type"), F.col("key").alias("canonical_name")).distinct()
    now = gr.rebuild_edges(mentions, entities, PATTERNS[0], 50, -1.0)
    stale = now.withColumn("confidence", F.when(F.col("head_id") == "p50", 0.0).otherwise(F.col("confidence")))
    changed = spark.createDataFrame([("p50",)], "entity_id string")
    got = gr.scoped_recompute(changed, stale, mentions, entities, PATTERNS[0], 50, -1.0)
    assert _rows(got, now.columns) == _rows(now, now.columns) and got.count() > 20
