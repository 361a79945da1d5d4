"""A stored table with upserts: rows lie in folders by a hash of their key, a manifest says which folder holds which bucket.

An upsert rewrites only the buckets that its rows touch, into a new folder, and then puts the next manifest in place. Readers
take the newest manifest, so they see the table before or after an upsert, never between. A write that fails leaves
no manifest, and with it the old version. Two writers of one version: the second finds its manifest taken and fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.files import upsert

BUCKETS = 64


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions of the table, oldest first."""
    path, fs = _file_system(spark, f"{root}/manifests")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """Key, number of buckets, schema and the folder of every bucket that has rows."""
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no table at {root}")
    chosen = known[-1] if version is None else version
    text = spark.read.text(f"{root}/manifests/{chosen:012d}.json", wholetext=True).first()[0]
    return json.loads(text) | {"version": chosen}


def _publish(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Write a manifest aside and move it into place, which only one writer can."""
    aside, fs = _file_system(spark, f"{root}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(content), "utf-8"))
    out.close()
    place, _ = _file_system(spark, f"{root}/manifests/{version:012d}.json")
    if fs.exists(place) or not fs.rename(aside, place):
        fs.delete(aside, False)
        raise RuntimeError(f"version {version} of {root} was written by another writer")


def _write(df: DataFrame, root: str, key: list[str], buckets: int) -> dict[str, str]:
    """Rows into a new folder, one part of it per bucket; returns the folders by bucket."""
    spark, name = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{name}")
    path, fs = _file_system(spark, f"{root}/{name}")
    parts = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    return {p.split("=")[1]: f"{name}/{p}" for p in parts}


def _read(spark: SparkSession, root: str, known: dict, buckets: list[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(known["schema"])
    folders = [f"{root}/{f}" for b, f in known["folders"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def create_stored(df: DataFrame, root: str, key: list[str], buckets: int = BUCKETS) -> int:
    """First version of a table; ``key`` is unique in it."""
    folders = _write(df, root, key, buckets)
    _publish(df.sparkSession, root, 0, {"key": key, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": folders})
    return 0


def read_stored(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version of the table, or an older one."""
    return _read(spark, root, manifest(spark, root, version))


def upsert_stored(new: DataFrame, root: str, mode: str = "overwrite") -> int:
    """Next version with ``new`` merged in (modes of ``files.upsert``); returns its number. Rows without a whole key never match."""
    spark = new.sparkSession
    known = manifest(spark, root)
    key, buckets = known["key"], known["buckets"]
    touched = [str(r["b"]) for r in new.select(_bucket(key, buckets).alias("b")).distinct().collect()]
    old = _read(spark, root, known, touched)
    folders = known["folders"] | _write(upsert(old, new.select(*old.columns), key, mode).select(*old.columns), root, key, buckets)
    _publish(spark, root, known["version"] + 1, {k: known[k] for k in ("key", "buckets", "schema")} | {"folders": folders})
    return known["version"] + 1
