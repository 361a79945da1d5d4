"""Small helpers of the subpackage: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a folder of this machine only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/spark-shared-{os.getuid()}"
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it again: lineage ends there and survives lost executors.

    The shuffle files that led to it are let go as soon as the driver has collected its garbage, so that is
    done here.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    trim()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.settled_path = path
    return out


def trim() -> None:
    """Give memory that the driver's Python has freed back to the system, where the C library can: its JVM needs it next."""
    gc.collect()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if back:
        back(0)


def let_go(spark: SparkSession) -> None:
    """Have the shuffle files of jobs that are over deleted now, before a loop's next round writes as many again."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete a settled table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bucket(n: int, *cols: str | Column) -> Column:
    """A number from 0 to n - 1 that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(n))


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` columns, in tables that never part rows of equal keys.

    A table holds at least the rows of one batch up to its last key; the rest is carried over. So memory is bounded
    by a batch and the largest group.
    """
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = batch.num_rows
        last = [c[batch.num_rows - 1].as_py() for c in batch.columns[:keys]]
        same = np.ones(batch.num_rows, bool)
        for c, value in zip(batch.columns[:keys], last):
            same &= np.asarray(c.to_pandas() == value)
        cut = int(np.argmax(same)) if same.any() else batch.num_rows
        if cut == 0 and carried:
            before = [c[carried[0].num_rows - 1].as_py() for c in carried[0].columns[:keys]]
            if before == last:
                carried.append(batch)
                continue
        whole = carried + ([batch.slice(0, cut)] if cut else [])
        if whole:
            yield pa.Table.from_batches(whole)
        carried = [batch.slice(cut)]
    if carried:
        yield pa.Table.from_batches(carried)
