"""Exact dedup by a tree-merge of sorted digest runs (built-in functions only).

Every input partition sorts its rows by digest and keeps the best row of each before anything moves: these are the runs. Then runs meet
in binomial rounds: in each, run 2k+1 sends what it has to run 2k, both lie there in order of their digests, and one pass over the merged
order keeps the best identifier of each digest. A run is cut into ``RANGES`` ranges of digests, so every round has as many tasks as it can
use, the last one included, and a digest is in a run once, however many rows have it. An entry is only trusted where the independent check
value (64-bit hash and byte length of the normalised text) agrees as well, at every level, so two texts never meet on the digest alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import SPACE

#: Runs to begin with (input partitions share them if there are more), and leading hexadecimal digits of a digest that tell its range.
RUNS, RANGE_DIGITS = 32, 3
KEY = ("range", "digest", "check", "bytes")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chars, mark, digest, check, bytes) of each row; a null text counts as empty, mark is a hash of the text as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.regexp_replace(text, SPACE, "")
    return docs.select(
        F.col(id_col).alias("id"),
        F.char_length(text).cast("bigint").alias("chars"),
        F.xxhash64(text).alias("mark"),
        F.sha2(norm, 256).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.octet_length(norm).cast("bigint").alias("bytes"),
    )


def merged(run: DataFrame) -> DataFrame:
    """One entry per digest and run: the rows it stands for and the best of them."""
    return run.groupBy("run", *KEY).agg(F.sum("n").alias("n"), F.min("best").alias("best"))


def merge_runs(rows: DataFrame, runs: int = RUNS) -> DataFrame:
    """One row per different text: (digest, check, bytes, n, best), best being (less, none, id, mark) of the row that stays."""
    best = F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id"), F.col("mark"))
    part = F.conv(F.substring("digest", 1, RANGE_DIGITS), 16, 10).cast("int").alias("range")
    run = rows.select(F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), part, "digest", "check", "bytes", F.lit(1).cast("bigint").alias("n"), best.alias("best"))
    run = merged(run)
    while runs > 1:
        runs = -(-runs // 2)
        run = run.withColumn("run", F.floor(F.col("run") / 2).cast("int")).repartition("run", "range").sortWithinPartitions("run", *KEY)
        run = merged(run)
    return run.select("digest", "check", "bytes", "n", "best")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are after white space (U+0020, U+0009 to U+000D) is deleted. Of equal texts the row with the most
    code points stays, then the smallest id, then, of rows that repeat the id with another text, the one whose text has the least hash.
    Null text: as empty. Null id: last among equals. Rows that repeat both id and text are one row written twice: they count in
    ``group_size`` and share one decision. Other columns are ignored; an empty table gives an empty result.
    """
    rows = digests(docs, id_col, text_col)
    # Only texts that occur again need the join; the hot side is the rows' side, which adaptive execution splits.
    groups = merge_runs(rows).where(F.col("n") > 1).select(F.col("digest").alias("d2"), F.col("check").alias("c2"), F.col("bytes").alias("b2"), "n", "best")
    both = rows.join(groups, (F.col("digest") == F.col("d2")) & (F.col("check") == F.col("c2")) & (F.col("bytes") == F.col("b2")), "left")
    alone = F.col("n").isNull()
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark")) & (F.col("chars") == -F.col("best.less"))
    return both.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | stays).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
