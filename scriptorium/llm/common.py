"""What the operators of this subpackage share: scratch space, Arrow batch limits and word counting."""

from __future__ import annotations

from itertools import count, islice
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.scratch import scratch, shipped, stored, written

__all__ = ["discarded", "fresh_names", "lookup", "python_workers", "scratch", "stored", "tasks", "whole_ids", "written"]

#: One white-space character, and one word, of the digest contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one Arrow batch brings to Python; documents are long, so far fewer than Spark's default of 10,000.
ARROW_ROWS = 256
#: Bytes after which an Arrow batch ends in any case, however long its texts are.
ARROW_BYTES = 32 << 20


def discarded(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    spark = df.sparkSession
    own = urlsplit(spark.sparkContext.getCheckpointDir()).path
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if urlsplit(path).path.startswith(own):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lookup(table: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A ``stored`` table of a number or two a row, to be joined to a far larger one: broadcast if it has at most ``most`` rows, so that hot
    keys of the larger one stay where they are; beyond that, joined as Spark sees fit."""
    return F.broadcast(table) if table.count() <= most else table


def fresh_names(df: DataFrame, n: int) -> list[str]:
    """Column names that a table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    return list(islice((x for x in (f"_own{k}" for k in count()) if x not in taken), n))


def whole_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs``, if its ids are integers; other types of ids have no place in the operators that order documents by them."""
    kind = dict(docs.dtypes)[id_col]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}: ids have to be integers here")
    return docs


def python_workers(spark: SparkSession) -> None:
    """Ready the session for Arrow functions: the package goes to the workers, and batches stay small whatever the length of a text.

    The two settings of batches stay with the session, since Spark reads them when a plan runs; rows and results are the same under any.
    """
    shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session has them set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def count_words(text: Column) -> Column:
    """Number of words as bigint; null counts none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")
