"""Tables that end a lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders by application, for sessions on one machine that name none, as in tests.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of the session, or a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        app = spark.sparkContext.applicationId
        found = _OWN[app] = _OWN.get(app) or f"file://{tempfile.mkdtemp(prefix='tables-')}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_tables(spark)}/{uuid.uuid4().hex}"


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Delete all tables that this application wrote to the shared folder; for when its results are written or read.

    DataFrames that read them, which is what most operators return, are of no use afterwards.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
