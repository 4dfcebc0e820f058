"""Boolean search with phrases: every query of a batch at once.

The words that have to meet in one scene are a group: all words of an AND query over scenes, else those of one word or phrase. A group is
looked for in slices of scenes, in three steps. Beside the blocks stands which slices have which word; only slices that have all words of a
group are read. In these, the places of the words' scenes are intersected, rarest word first, as arrays. For phrases, the positions of the
words in the scenes that are left are shifted by their place in the phrase and intersected, rarest first again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.scratch import stored
from scriptorium.operators.index import LEVELS, Index

OPS = ("and", "or")


def check(queries: DataFrame) -> DataFrame:
    """Queries whose op (in any case) and level are known; another value raises when the row is reached."""
    op = F.lower("op")
    good = op.isin(*OPS) & F.col("level").isin(*LEVELS)
    said = F.concat(F.lit("unknown op or level in query "), "qname")
    return queries.withColumn("op", F.when(good, op).otherwise(F.raise_error(said).cast("string")))


def words_of(queries: DataFrame) -> DataFrame:
    """(qname, level, op, grp, unit_no, phrase, off, term) of the queries' words. ``grp`` is -1 where all words of a query have to meet in one
    scene, else the number of the word or phrase; ``phrase`` is the number of its words."""
    known = check(queries).where(F.size("unit") > 0)
    whole = (F.col("op") == "and") & (F.col("level") == "scene")
    return known.select("qname", "level", "op", F.when(whole, F.lit(-1)).otherwise(F.col("unit_no")).alias("grp"), "unit_no", F.size("unit").alias("phrase"), F.posexplode("unit").alias("off", "term"))


def meetings(index: Index, words: DataFrame) -> DataFrame:
    """(qname, grp, segment, slice, bucket, span, term, n, all): which blocks each group's words have, and whether the slice has all of them.

    Only what is beside the blocks is read here.
    """
    asked = words.select("qname", "grp", "term").distinct()
    asked = index.placed(asked.withColumn("needs", F.count("*").over(Window.partitionBy("qname", "grp"))))
    found = index.blocks.select("segment", "bucket", "span", "slice", "term", "n").join(asked, ["segment", "bucket", "term"])
    have = F.count("*").over(Window.partitionBy("qname", "grp", "segment", "slice"))
    return found.withColumn("all", have == F.col("needs")).drop("needs")


def skipped(index: Index, queries: DataFrame) -> DataFrame:
    """(qname, blocks, read): blocks that the words of each query have, once for each group, and those that are read."""
    return meetings(index, words_of(queries)).groupBy("qname").agg(F.count("*").alias("blocks"), F.sum(F.col("all").cast("bigint")).alias("read"))


def met(arrays: Column) -> Column:
    """What all arrays of an array<struct<size, of>> have, the smallest array first."""
    ordered = F.array_sort(arrays)
    return F.aggregate(F.slice(ordered, 2, F.size(ordered)), F.get(ordered, F.lit(0)).of, lambda a, x: F.array_intersect(a, x.of))


def scenes_of(index: Index, words: DataFrame) -> DataFrame:
    """(qname, grp, ord, play): the scenes that have every word and phrase of a group."""
    keys = ["qname", "grp", "segment", "slice"]
    uses = words.groupBy("qname", "grp", "term").agg(F.collect_set(F.when(F.col("phrase") > 1, F.struct("unit_no", "phrase", "off"))).alias("uses"))
    chosen = stored(meetings(index, words).where("all").drop("all", "n").join(uses, ["qname", "grp", "term"]))
    some, in_phrase = not words.where("phrase > 1").isEmpty(), F.size("uses") > 0
    # Positions are read of words in phrases only.
    part = lambda which, positions: index.of_blocks(chosen.where(which), "n", "ords", "plays", positions.alias("positions"))
    blocks = part(~in_phrase, F.lit(None).cast("array<array<int>>"))
    blocks = blocks.unionByName(part(in_phrase, F.col("positions"))) if some else blocks
    # A group of rows here is what one slice has of a query's words. A generator gives the intersection, so that it is worked out once.
    groups = blocks.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("n", "ords", "plays", "positions", "uses")).alias("b"))
    hits = met(F.transform("b", lambda x: F.struct(x.n.alias("size"), x.ords.alias("of"))))
    groups = groups.select(*keys, "b", F.explode(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    first = F.get(F.col("b"), F.lit(0))
    scenes = F.filter(F.arrays_zip(first.ords.alias("ord"), first.plays.alias("play")), lambda x: F.array_contains("hits", x["ord"]))
    if not some:
        return groups.select("qname", "grp", F.inline(scenes))
    groups = groups.select(*keys, "hits", F.filter("b", lambda x: F.size(x.uses) > 0).alias("b"), scenes.alias("scenes"))
    # Phrases: the entries of the scenes that are left, once for each place that the word has in a phrase; a scene of no phrase has one without.
    entry = groups.select(*keys, "hits", F.inline("scenes"), F.size("b").alias("words"), F.explode_outer("b").alias("x"))
    of_scene = F.get(F.filter(F.arrays_zip(F.col("x.ords").alias("o"), F.col("x.positions").alias("p")), lambda e: e.o == F.col("ord")), F.lit(0)).p
    entry = entry.select(*keys, "ord", "play", of_scene.alias("positions"), F.explode_outer("x.uses").alias("use"))
    shifted = F.struct(F.size("positions").alias("size"), F.transform("positions", lambda p: p - F.col("use.off")).alias("of"))
    side = entry.groupBy(*keys, "ord", "play", F.col("use.unit_no").alias("unit_no")).agg(F.collect_list(shifted).alias("s"))
    there = F.col("unit_no").isNull() | (F.size(met(F.col("s"))) > 0)
    return side.groupBy(*keys, "ord", "play").agg(F.every(there).alias("there")).where("there").select("qname", "grp", "ord", "play")


def search(index: Index, queries: DataFrame) -> DataFrame:
    """(qname, ord, unit_id): AND in corpus order, OR by id. A query with an unknown word under AND has no rows; under OR the word counts
    for nothing. A phrase is in a unit if one scene has its words side by side.

    Hits are numbered in two levels: inside ranges of the order, which are written once, and by the sizes of the ranges before, so no
    task has all hits of a query.
    """
    words = words_of(queries)
    asked = words.groupBy("qname", "level", "op").agg(F.countDistinct("grp").alias("groups"))
    found = scenes_of(index, words).join(F.broadcast(asked), "qname")
    names = index.scenes.select(F.col("doc_ord").alias("ord"), "scene_id")
    scenes = found.where("level = 'scene'").join(names, "ord").select("qname", "op", "groups", "grp", F.col("scene_id").alias("unit_id"), "ord")
    plays = found.where("level = 'play'").select("qname", "op", "groups", "grp", F.col("play").alias("unit_id"), "ord")
    hits = scenes.unionByName(plays).groupBy("qname", "op", "groups", "unit_id").agg(F.countDistinct("grp").alias("have"), F.min("ord").alias("first"))
    hits = hits.where((F.col("op") == "or") | (F.col("have") == F.col("groups")))
    hits = stored(hits.select("qname", F.when(F.col("op") == "and", F.col("first")).alias("first"), "unit_id"))
    ranges = stored(hits.repartitionByRange("qname", F.col("first").asc_nulls_first(), "unit_id").withColumn("range", F.spark_partition_id()))
    sums = ranges.groupBy("qname", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("qname").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("qname", "range", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("qname", "range").orderBy(F.col("first").asc_nulls_first(), "unit_id"))
    return ranges.withColumn("no", inside).join(sums, ["qname", "range"]).select("qname", (F.col("before") + F.col("no")).cast("bigint").alias("ord"), "unit_id")
