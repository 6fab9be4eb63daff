"""Tables in the folder that the driver and every executor share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) one is
made below the system's temporary folder. Tables are written as Parquet, so a lost executor costs a re-read at most.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a slash at its end."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step", codec: str = "snappy") -> DataFrame:
    """Writes the rows once and reads them back: the lineage before them is cut."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    for df in frames:
        if path := getattr(df, "_sluice_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
