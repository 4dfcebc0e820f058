"""Readers of the native file formats, and of the driver tables as corpora and graphs. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.scratch import stored
from scriptorium.functions.text import ws_tokens

#: A scene of a JSON corpus; pieces of a file whose quotes are summed at once.
SCENE, PIECES = "playId string, sceneId string, sceneNum bigint, text string", 4096


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (file, at, mid, ...) with ``no``, the number of each in its file, from 0, and without ``at`` and ``mid``.

    ``at`` is where a split begins in its file and ``mid`` rises with the rows of a split; rows are stored, so both stay as they are. Rows are
    counted by split, and what splits before have is added: a row per split goes to the others, and no split is seen as a whole.
    """
    splits = rows.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("mid").alias("low"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("file").alias("file_"), F.col("at").alias("at_"), "low", F.coalesce(before, F.lit(0)).alias("before"))
    joined = rows.join(splits, (F.col("file") == F.col("file_")) & (F.col("at") == F.col("at_")))
    return joined.withColumn("no", F.col("before") + F.col("mid") - F.col("low")).drop("file_", "at_", "low", "before", "at", "mid")


def fragments(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, at, mid, value), stored: the lines of text files, or what stands between separators, as their splits are read. LF, CR and CRLF
    end lines, on either side of a split's end too; a file's last line need not be ended."""
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mid"), "value")
    return stored(rows)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, line) of plain text files, doc_id being the file's name and line_no counting from 0. Files are read in splits, so a
    large one is many tasks' work and no row holds more than a line."""
    return numbered(fragments(spark, path)).select(F.col("file").alias("doc_id"), F.col("no").alias("line_no"), F.col("value").alias("line"))


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of plain text files, the file's name as id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word), one per line, case kept."""
    return spark.read.text(path).select(F.col("value").alias("word"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(play_id, scene_id, scene_num, doc_ord, text) of a JSON file {"corpus": [{...}, ...]}, compressed or not, of any size.

    The file is read in pieces between opening braces. A piece that begins inside a string, as the quotes before it tell, goes on with the
    object before it; so every scene is put together from its own pieces, and is all that is parsed at once. Scenes are objects without
    objects inside. Quotes are counted by split first, then over splits; a file that is not compressed is many tasks' work.
    """
    rows = fragments(spark, path, "{")
    quotes = F.regexp_count(F.regexp_replace("value", r"(?s)\\.", ""), F.lit('"'))
    rows = stored(numbered(rows.withColumn("quotes", quotes.cast("bigint"))))
    rows = rows.withColumn("block", F.floor(F.col("no") / PIECES))
    inside = Window.partitionBy("file", "block").orderBy("no")
    blocks = rows.groupBy("file", "block").agg(F.sum("quotes").alias("q"))
    before = Window.partitionBy("file_").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("file").alias("file_"), F.col("block").alias("block_"), "q").withColumn("passed", F.coalesce(F.sum("q").over(before), F.lit(0))).drop("q")
    rows = rows.join(blocks, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    so_far = F.col("passed") + F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A piece begins an object if an even number of quotes stands before it; the others are counted with the last one that does.
    rows = stored(rows.select("file", "block", "no", "value", (so_far % 2 == 0).alias("begins")))
    last = rows.groupBy("file", "block").agg(F.max(F.when(F.col("begins"), F.col("no"))).alias("last"))
    last = last.select(F.col("file").alias("file_"), F.col("block").alias("block_"), F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    rows = rows.join(last, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    first = F.coalesce(F.max(F.when(F.col("begins"), F.col("no"))).over(inside), F.col("last"))
    whole = rows.withColumn("first", first).groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("no", "value"))).alias("p"))
    text = F.concat(F.lit("{"), F.regexp_extract(F.array_join(F.transform("p", lambda x: x.value), "{"), r"(?s)\A(.*\})", 1))
    scenes = stored(whole.select("file", "first", F.from_json(text, SCENE).alias("c")).where("c.sceneId IS NOT NULL OR c.text IS NOT NULL"))
    # Scenes get their place by the number of their first piece, in ranges again.
    placed = scenes.withColumn("block", F.floor(F.col("first") / PIECES))
    sums = placed.groupBy("file", "block").agg(F.count("*").alias("n"))
    sums = sums.select(F.col("file").alias("file_"), F.col("block").alias("block_"), F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = placed.join(sums, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("first")) - 1
    return placed.select(F.col("c.playId").alias("play_id"), F.col("c.sceneId").alias("scene_id"), F.col("c.sceneNum").alias("scene_num"), place.cast("bigint").alias("doc_ord"), F.col("c.text").alias("text"))


def _queries(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 4)
    at = lambda i: F.get("p", F.lit(i))
    return parts.select(at(0).alias("qname"), at(1).alias("level"), at(2).alias("how"), F.posexplode(F.slice("p", 4, 1 << 20)).alias("no", "term"))


def boolean_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qname, level, op, unit_no, unit array<string>); blank terms and lines with too few columns are skipped."""
    rows = _queries(spark, path).select("qname", "level", F.col("how").alias("op"), F.col("no").alias("unit_no"), ws_tokens(F.col("term")).alias("unit"))
    return rows.where(F.size("unit") > 0)


def ranked_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qname, level, model, qpos, term); blank terms are skipped, terms of several words match nothing."""
    return _queries(spark, path).where(F.trim("term") != "").select("qname", "level", F.col("how").alias("model"), F.col("no").alias("qpos"), "term")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of tab-separated lines, compressed or not."""
    return spark.read.schema("src string, dst string").option("sep", "\t").option("quote", "").csv(path)


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    rows = lines(spark, path).select(F.col("line_no").alias("ord"), ws_tokens(F.col("line")).alias("p"))
    return rows.where(F.size("p") >= least)


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rank, score, ord) of a TREC run."""
    at = lambda i: F.get("p", F.lit(i))
    return _fields(spark, path, 5).select(at(0).alias("qid"), at(2).alias("doc_id"), at(3).try_cast("int").alias("rank"), at(4).try_cast("double").alias("score"), "ord")


def qrels_file(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, rel, ord) of TREC relevance judgements."""
    at = lambda i: F.get("p", F.lit(i))
    return _fields(spark, path, 4).select(at(0).alias("qid"), at(2).alias("doc_id"), at(3).try_cast("double").alias("rel"), "ord")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of an input with too few splits to keep all cores busy (a file of one row group, say), dealt out anew; others stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() > 2 * cores else rows.repartition(2 * cores)


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scenes, sources as plays."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("play_id"), F.col("doc_id").cast("string").alias("scene_id"), F.col("doc_id").alias("scene_num"), F.col("doc_id").alias("doc_ord"), "text")


def conversations_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as scenes, conversations as plays."""
    turns = table(spark, sf_dir, "conversations")
    scene = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(F.col("conv_id").cast("string").alias("play_id"), scene.alias("scene_id"), F.col("turn").alias("scene_num"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_ord"), "text")


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the targets of their links."""
    return table(spark, sf_dir, "pages").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers of line items: returned ones point from part to supplier, others back. Cyclic, with parallel edges."""
    items = table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    back = F.col("l_returnflag") == "R"
    return items.select(F.when(back, part).otherwise(supplier).alias("src"), F.when(back, supplier).otherwise(part).alias("dst"))
