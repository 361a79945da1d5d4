"""A search scores units where their rows lie: what it shuffles does not grow with the units that share a term."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import index as ix
from tessella.operators import retrieval as rt


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    text = F.concat_ws(" ", F.lit("common often"), F.concat(F.lit("x"), F.col("id") % 7), F.concat(F.lit("y"), "id"))
    units = spark.range(4000).select(F.format_string("u%05d", "id").alias("unit_id"), F.lit("").alias("title"), F.lit("").alias("search_text"),
                                     text.alias("text"), F.concat(F.lit("c"), F.col("id") % 3).alias("kind")).repartition(4).cache()
    return units, ix.build_index(units, f"file://{tmp_path_factory.mktemp('rows')}", ("kind",))


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(q, t) for q in range(12) for t in ("common", "often", f"x{q % 7}", f"y{q}")], "query_id int, term string")


def rows(df):
    return sorted((r.query_id, r.rank, r.unit_id, r.score) for r in df.collect())


def shuffled(spark, what="Records"):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    jvm, store = spark._jvm, sc.statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(getattr(stages.apply(i), f"shuffleWrite{what}")() for i in range(stages.size()))


def test_shuffled_rows_are_bounded_by_tasks_and_k(spark, index, terms):
    before = shuffled(spark)
    got = rows(ix.search(index[1], terms, 5))
    assert shuffled(spark) - before < 4000
    assert got == rows(rt.top_k(rt.bm25(terms, index[0]), 5))


def test_scope_by_class(spark, index, terms):
    allowed = spark.createDataFrame([(q, c) for q in range(1, 12) for c in ("c0", "c2")[: 1 + q % 2]], "query_id int, class string")
    want = rt.bm25(terms, index[0]).join(index[0].select("unit_id", F.col("kind").alias("class")), "unit_id").join(allowed, ["query_id", "class"], "left_semi")
    assert rows(ix.search(index[1], terms, 5, ix.Classes(F.col("kind"), allowed))) == rows(rt.top_k(want, 5))


def test_slices_of_queries(index, terms):
    assert rows(ix.search(index[1], terms, 5, max_shared=10)) == rows(ix.search(index[1], terms, 5))


def test_scope_on_attributes_shuffles_no_units(spark, index, terms):
    before = shuffled(spark)
    got = rows(ix.search(index[1], terms, 5, ix.Where(F.col("kind") == "c1")))
    assert shuffled(spark) - before < 2000
    assert got == rows(rt.top_k(rt.bm25(terms, index[0]).join(index[0].where("kind = 'c1'").select("unit_id"), "unit_id", "left_semi"), 5))
    assert got == rows(ix.search(index[1], terms, 5, ix.Within(index[0].where("kind = 'c1'").select("unit_id"))))
