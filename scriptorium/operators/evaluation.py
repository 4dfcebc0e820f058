"""Retrieval evaluation: runs (qid, doc_id, rank) against relevance judgements (qid, doc_id, rel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cut-offs.
NDCG, PRECISION, RECALL, F1 = 75, 15, 20, 25
METRICS = ("ndcg75", "rr", "p15", "r20", "f1_25", "ap")


def latest(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per key: the last by an ordinal column ``ord``, if there is one (else the largest by its values)."""
    rest = [c for c in rows.columns if c not in keys]
    order = [c for c in ("ord", *rest) if c in rows.columns]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*dict.fromkeys(order))).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def qrels_totals(qrels: DataFrame) -> DataFrame:
    """(qid, judged, relevant)."""
    once = latest(qrels, ("qid", "doc_id"))
    return once.groupBy("qid").agg(F.count("*").alias("judged"), F.sum((F.col("rel") > 0).cast("bigint")).alias("relevant"))


def gain(rank: Column, rel: Column) -> Column:
    return F.when(rank == 1, rel).otherwise(rel / F.log2(rank))


def ideal(qrels: DataFrame, k: int = NDCG) -> DataFrame:
    """(qid, idcg): the judged relevances in falling order, to rank k."""
    order = Window.partitionBy("qid").orderBy(F.desc("rel"))
    ranked = latest(qrels, ("qid", "doc_id")).select("qid", "rel", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
    return ranked.groupBy("qid").agg(F.sum(gain(F.greatest("rank", F.lit(1)), F.col("rel"))).alias("idcg"))


def gaps(run: DataFrame) -> DataFrame:
    """(qid, rows, least, most) of queries whose ranks are not 1 to n; empty if the run is sound."""
    once = latest(run, ("qid", "rank"))
    return once.groupBy("qid").agg(F.count("*").alias("rows"), F.min("rank").alias("least"), F.max("rank").alias("most")).where("least <> 1 OR most <> rows")


def unjudged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid) of the run without any relevant document."""
    return run.select("qid").distinct().join(qrels_totals(qrels).where("relevant > 0"), "qid", "left_anti")


def per_query(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, ndcg75, rr, p15, r20, f1_25, ap), unrounded, of the queries that have relevant documents. Ranks are trusted to be 1 to n."""
    judged = latest(qrels, ("qid", "doc_id")).select("qid", "doc_id", F.col("rel").cast("double").alias("rel"))
    rows = latest(run.select(*[c for c in ("qid", "rank", "doc_id", "ord") if c in run.columns]), ("qid", "rank")).join(judged, ["qid", "doc_id"], "left")
    rows = rows.withColumn("rel", F.coalesce("rel", F.lit(0.0))).withColumn("hit", (F.col("rel") > 0).cast("int"))
    rows = rows.withColumn("hits", F.sum("hit").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    upto = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).cast("double")
    sums = rows.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= NDCG, gain(F.greatest("rank", F.lit(1)), F.col("rel"))).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        upto(PRECISION).alias("hp"), upto(RECALL).alias("hr"), upto(F1).alias("hf"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
    )
    all_ = sums.join(qrels_totals(qrels).where("relevant > 0"), "qid").join(ideal(qrels), "qid")
    p, r = F.col("hf") / F1, F.col("hf") / F.col("relevant")
    return all_.select(
        "qid",
        F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.when(F.col("idcg") != 0, F.col("idcg"))).alias("ndcg75"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.col("hp") / PRECISION).alias("p15"),
        (F.col("hr") / F.col("relevant")).alias("r20"),
        F.when(F.col("hf") == 0, 0.0).otherwise(2 * p * r / F.when(F.col("hf") != 0, p + r)).alias("f1_25"),
        (F.col("precisions") / F.col("relevant")).alias("ap"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """One row of means over the evaluated queries; no row if there are none."""
    return metrics.agg(F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in METRICS]).where("queries > 0")
