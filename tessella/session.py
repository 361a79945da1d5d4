"""Session helpers shared by tests, the bench and user jobs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tessella", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of this machine only for a local master, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names (see ``shared_folder``)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def rows_of(df: DataFrame, few: DataFrame, key: str, rows: int = 500_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``few``, cut where they lie, so that what follows shuffles only these.

    ``few`` is read twice; with more than ``rows`` distinct keys these are not handed to the tasks but shuffled.
    """
    keys = few.select(key).distinct()
    return df.join(F.broadcast(keys) if at_most(keys, rows) else keys, key, "left_semi")


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` holds no more than ``rows`` rows; reads at most ``rows + 1`` of them."""
    return df.limit(rows + 1).count() <= rows
