"""Link analysis over edges (src, dst); parallel edges count, loops stay."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from scriptorium.functions.scratch import deleted, new_path, stored

#: Edges of one source in one part, and edges of a bucket.
SOURCE_EDGES, BUCKET_EDGES = 1 << 20, 1 << 22


def nodes(edges: DataFrame) -> DataFrame:
    """(page): every source and target."""
    return edges.select(F.col("src").alias("page")).union(edges.select("dst")).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("page")).agg(F.count("*").alias("cnt"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(page, cnt); pages without links to them are not in it."""
    return edges.groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("cnt"))


def dangling(edges: DataFrame) -> DataFrame:
    """(page): pages without links of their own."""
    return nodes(edges).join(edges.select(F.col("src").alias("page")).distinct(), "page", "left_anti")


def top_pages(values: DataFrame, value: str, k: int = 100, then: tuple[str, ...] = ("page",)) -> DataFrame:
    """(page, rank, value) of the k largest; ties by ``then``. Sorting to k rows comes before numbering them."""
    best = values.orderBy(F.desc(value), *then).limit(k)
    return best.select("page", F.row_number().over(Window.orderBy(F.desc(value), *then)).cast("bigint").alias("rank"), value)


def top_inlinks(edges: DataFrame, k: int = 100) -> DataFrame:
    """(page, rank, cnt). With an ordinal column ``ord``, ties go by first appearance as a target, else by page."""
    if "ord" not in edges.columns:
        return top_pages(in_degree(edges), "cnt", k)
    counts = edges.groupBy(F.col("dst").alias("page")).agg(F.count("*").alias("cnt"), F.min("ord").alias("first"))
    return top_pages(counts, "cnt", k, ("first", "page"))


@contextmanager
def bucketed(rows: DataFrame, buckets: int, *keys: str) -> Iterator[DataFrame]:
    """The rows from a table in the checkpoint folder that is bucketed by ``keys``: joins on these leave its rows where they are. The table
    goes when the context ends."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession)
    name = f"bucketed_{uuid.uuid4().hex}"
    try:
        rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        deleted(spark, f"{path}/x")


def counted(edges: DataFrame) -> DataFrame:
    """(src, dst, m): parallel edges as one row with their number."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("m"))


def weighted(edges: DataFrame, degree: DataFrame, most: int = SOURCE_EDGES) -> DataFrame:
    """(src, part, dst, weight): the share of a page's rank that goes to each of its targets. A page's targets are dealt out to parts of some
    ``most`` edges, as ``degree`` (page, cnt, parts) has it. Edges may be ``counted`` ones."""
    rows = (edges if "m" in edges.columns else counted(edges)).join(degree.withColumnRenamed("page", "src"), "src")
    part = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    return rows.select("src", part.alias("part"), "dst", (F.col("m") / F.col("cnt")).alias("weight"))


def contributions(weights: DataFrame, state: DataFrame) -> DataFrame:
    """(dst, got): what pages get by their links. Ranks go to the edges, which stay in their buckets, once for each part of a page's targets."""
    ranks = state.where("parts > 0").select(F.col("page").alias("src"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rank")
    return weights.join(ranks, ["src", "part"]).groupBy("dst").agg(F.sum(F.col("weight") * F.col("rank")).alias("got"))


def pagerank(edges: DataFrame, lam: float = 0.2, tau: float = 0.005, max_iter: int | None = None, most: int = SOURCE_EDGES) -> tuple[DataFrame, list[tuple[int, float]]]:
    """((page, rank), [(iteration, change)]): at least one iteration, until the L2 change is below tau or max_iter is reached.

    Edges are read once, and counted; they are written bucketed by source, and are not moved in any iteration; what moves are ranks and the sums of what pages get. A
    source of more than ``most`` edges is several parts, in different buckets. Each iteration's ranks are written to the shared checkpoint
    folder, those before are deleted, and two sums, observed as the rows are written, come to the driver.
    """
    spark = edges.sparkSession
    pairs = stored(counted(edges.select("src", "dst")))
    degree = stored(pairs.groupBy(F.col("src").alias("page")).agg(F.sum("m").alias("cnt")).withColumn("parts", F.ceil(F.col("cnt") / most).cast("int")))
    n_edges = degree.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_edges // BUCKET_EDGES))
    pages = nodes(pairs).join(degree.select("page", "parts"), "page", "left")
    state, trace = stored(pages.select("page", F.coalesce("parts", F.lit(0)).alias("parts"), F.lit(0.0).alias("rank"))), []
    n = state.count()
    lost, first = state.where("parts = 0").count() / max(n, 1), F.lit(1.0 / max(n, 1))
    if not n:
        return state.select("page", "rank"), trace
    with bucketed(weighted(pairs, degree, most), buckets, "src", "part") as weights:
        deleted(spark, *pairs.inputFiles())
        while (not trace or trace[-1][1] >= tau) and (max_iter is None or len(trace) < max_iter):
            now = state if trace else state.withColumn("rank", first)
            rank = F.lit(lam / n + (1 - lam) * lost / n) + (1 - lam) * F.coalesce("got", F.lit(0.0))
            after = now.withColumnRenamed("rank", "old").join(contributions(weights, now).withColumnRenamed("dst", "page"), "page", "left").select("page", "parts", "old", rank.alias("rank"))
            seen = Observation()
            sums = {"change": F.sqrt(F.sum(F.pow(F.col("rank") - F.col("old"), 2))), "lost": F.coalesce(F.sum(F.when(F.col("parts") == 0, F.col("rank"))), F.lit(0.0))}
            after = stored(after.observe(seen, *[c.alias(k) for k, c in sums.items()]).drop("old"))
            deleted(spark, *state.inputFiles())
            state, lost = after, seen.get["lost"]
            trace.append((len(trace) + 1, seen.get["change"]))
    deleted(spark, *degree.inputFiles())
    return state.select("page", "rank") if trace else state.select("page", first.alias("rank")), trace
