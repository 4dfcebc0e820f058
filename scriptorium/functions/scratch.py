"""Scratch space that every executor can reach, and the package for their Python workers."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of names and numbers goes to all executors.
FEW = 1 << 18


def scratch(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's (``spark.checkpoint.dir``), or in local mode, where none is set, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scriptorium-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, as they are partitioned, from files in the shared checkpoint folder: lineage ends here and lost executors lose
    nothing."""
    scratch(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    """A path in the checkpoint folder that nothing has been written to yet."""
    return f"{scratch(spark)}/{uuid.uuid4().hex}.parquet"


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a compressed table in the shared checkpoint folder, whose columns are read apart, as ``written`` ones are not."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(table: DataFrame, most: int = FEW) -> DataFrame:
    """A ``stored`` table to be joined to a far larger one: broadcast if it has few rows, so that the larger one stays where it is and folders
    without a match are not read. Spark sees a small table by itself only where it can estimate its size."""
    return F.broadcast(table) if table.count() <= most else table


def deleted(spark: SparkSession, *files: str) -> None:
    """Delete the folders of files that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in files}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@functools.lru_cache(maxsize=8)
def _shipped(app: str) -> bool:
    """Give this package to the Python workers of an application, once: executors need no checkout of it."""
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    SparkSession.active().sparkContext.addPyFile(str(archive))
    return True


def shipped(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's application."""
    _shipped(spark.sparkContext.applicationId)
