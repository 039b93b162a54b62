"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``); they go when the program ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where none is set, a temporary one on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="trustlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def folder(spark: SparkSession, name: str = "io") -> str:
    """A new folder's name in the shared one; what is written there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.append((spark, path))
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` to a new table in the shared folder and read it back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, S112 - the session may have ended before
            continue
