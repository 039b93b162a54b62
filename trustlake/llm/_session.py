"""Session settings and tables in the shared folder that the operators of this subpackage use."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one HOT-th of all rows is frequent; there are fewer than HOT such keys.
HOT = 256
_left: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where none is set, a temporary one on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="trustlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; what is there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.add(path)
    return path


def stored(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` to a new table in the shared folder (a folder for each value of ``by``) and read it back."""
    path = own_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        _delete(table._stored_at)


def _delete(path: str) -> None:
    _left.discard(path)
    with contextlib.suppress(OSError):
        fs, at = filesystem(path)
        fs.delete_dir(at)


@atexit.register
def _clean() -> None:
    for path in list(_left):
        _delete(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``at``, the place of each row in ``order`` (from 0): a range exchange, and the sizes of its ranges added up."""
    made = stored(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("made", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("made", 33)
    sizes = made.groupBy(part.alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r.part, total))
        total += r["count"]
    # A row for each range.
    starts = df.sparkSession.createDataFrame(before, "part long, start long")
    return made.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("made").bitwiseAND((1 << 33) - 1)).drop("part", "start", "made")


def keyed_join(rows: DataFrame, facts: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, a table of one row a key with ``n``, the number of rows of that key.

    Frequent keys, fewer than ``HOT`` whatever the data, are broadcast, so
    their rows stay where they are. The others meet in a merge join, in which
    no key has more than one HOT-th of all rows. Both tables are read twice.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    frequent = facts.filter(F.col("n") * HOT > total)
    here = rows.join(F.broadcast(frequent), key)
    rest = rows.join(F.broadcast(frequent.select(*key)), key, "left_anti").join(facts.filter(F.col("n") * HOT <= total).hint("merge"), key, how)
    return here.unionByName(rest).drop("n")
