"""A stored table: untouched files keep their names, readers see whole versions, failed writes change nothing."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.sources import stored as st

SCHEMA = "k int, name string, v int"


def rows(df):
    return sorted((r.k, r.name, r.v) for r in df.collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def root(spark, tmp_path):
    st.create_stored(spark.createDataFrame([(i, f"n{i}", i) for i in range(200)], SCHEMA), f"file://{tmp_path}/t", ["k"], buckets=16)
    return f"file://{tmp_path}/t", tmp_path / "t"


def test_upsert_rewrites_touched_buckets_only(spark, root):
    url, path = root
    before, first = files(path), st.manifest(spark, url)
    new = spark.createDataFrame([(3, "x", None), (500, "y", 5)], SCHEMA)
    assert st.upsert_stored(new, url, "keep") == 1
    assert rows(st.read_stored(spark, url)) == sorted([(i, f"n{i}", i) for i in range(200) if i != 3] + [(3, "x", 3), (500, "y", 5)])
    assert before <= files(path)
    second = st.manifest(spark, url)
    changed = {b for b, f in second["folders"].items() if first["folders"].get(b) != f}
    assert 1 <= len(changed) <= 2 and len(second["folders"]) == 16
    # The older version can still be read.
    assert rows(st.read_stored(spark, url, 0)) == [(i, f"n{i}", i) for i in range(200)]
    assert st.upsert_stored(spark.createDataFrame([(3, "z", None)], SCHEMA), url) == 2
    assert (3, "z", None) in {(r.k, r.name, r.v) for r in st.read_stored(spark, url).collect()}
    assert st.versions(spark, url) == [0, 1, 2]


def test_failed_write_leaves_the_old_version(spark, root):
    url, _ = root
    bad = spark.createDataFrame([(3, "x", 1)], SCHEMA).withColumn("v", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        st.upsert_stored(bad, url)
    assert st.versions(spark, url) == [0] and st.read_stored(spark, url).count() == 200


def test_second_writer_of_a_version_fails(spark, root):
    url, _ = root
    content = {k: v for k, v in st.manifest(spark, url).items() if k != "version"}
    st._publish(spark, url, 1, content)
    with pytest.raises(RuntimeError, match="another writer"):
        st._publish(spark, url, 1, content)


def test_empty_tables_and_missing_ones(spark, tmp_path):
    url = f"file://{tmp_path}/e"
    with pytest.raises(FileNotFoundError):
        st.read_stored(spark, url)
    none = spark.createDataFrame([], SCHEMA)
    st.create_stored(none, url, ["k"])
    assert st.read_stored(spark, url).count() == 0
    st.upsert_stored(none, url)
    st.upsert_stored(spark.createDataFrame([(None, "a", 1), (1, "b", 2)], SCHEMA), url)
    assert {(r.k, r.name) for r in st.read_stored(spark, url).collect()} == {(None, "a"), (1, "b")}
