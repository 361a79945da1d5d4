"""Context is put together from the documents found: the others' texts are not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.plans import derived as dv
from tessella.session import rows_of
from test_search_in_rows import shuffled


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('corpus')}"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.lit("Title"), F.repeat(F.lit("some words "), 30), F.concat(F.lit("last "), "id")).alias("text"),
                                    F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs.repartition(8).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("of", ["segments", "units", "relations"])
def test_rows_of_found_documents(spark, corpus, of):
    key = {"segments": "segment_id", "units": "unit_id", "relations": "source_id"}[of]
    few = spark.createDataFrame([("17#1",), ("2999#0",), ("17#2",)], "segment_id string")
    every = getattr(dv, of)(spark, corpus)
    before = shuffled(spark)
    got = getattr(dv, of)(spark, corpus, few).join(few.withColumnRenamed("segment_id", key), key).drop("x").collect()
    assert shuffled(spark) - before < 100
    assert sorted(got) == sorted(every.join(few.withColumnRenamed("segment_id", key), key).collect())


def test_rows_of_many_keys(spark):
    some = spark.range(100)
    assert rows_of(spark.range(1000), some, "id", rows=10).count() == rows_of(spark.range(1000), some, "id").count() == 100


def test_similar_sets_do_not_copy_sets_to_pairs(spark):
    from tessella.operators import dedup as dd

    rng = random.Random(4)
    sets = [(i, [f"rare{i % 10}"] + rng.sample([f"word number {j}" for j in range(1000)], 199)) for i in range(300)]
    sets += [(1000 + i, t[:197] + ["a", "b", "c"]) for i, t in sets[:20]] + [(2000, sets[0][1][::-1]), (2001, None), (2002, [])]
    df = spark.createDataFrame(sets, "id int, tokens array<string>").repartition(4).localCheckpoint()
    before = shuffled(spark, "Bytes")
    got = sorted((r.id_a, r.id_b, r.copies_a, r.copies_b, r.similarity) for r in dd.similar_sets(df, 0.7).collect())
    assert got == [(i, 1000 + i, 2 if i == 0 else 1, 1, round(197 / 203, 6)) for i in range(20)]
    assert shuffled(spark, "Bytes") - before < 3_000_000
