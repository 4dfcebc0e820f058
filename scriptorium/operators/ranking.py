"""Ranked search: BM25 and query likelihood, all queries of a batch, of both levels, at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.scratch import stored
from scriptorium.operators.index import LEVELS, Index

MODELS = ("bm25", "ql")
#: Digits by which scores are told apart; equal ones go by the first query word that the unit has, then by its place in the corpus.
DIGITS = 9


def check(queries: DataFrame) -> DataFrame:
    """Queries whose model and level are known; another value raises when the row is reached."""
    good = F.col("model").isin(*MODELS) & F.col("level").isin(*LEVELS)
    said = F.concat(F.lit("unknown model or level in query "), "qname")
    return queries.withColumn("model", F.when(good, F.col("model")).otherwise(F.raise_error(said).cast("string")))


def top(scores: DataFrame, k: int) -> DataFrame:
    """(qname, unit_id, rank, score) of the k best of each query."""
    order = Window.partitionBy("qname").orderBy(F.desc(F.round("score", DIGITS)), "first", "unit_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("qname", "unit_id", F.col("rank").cast("bigint").alias("rank"), "score")


def terms_of(queries: DataFrame, model: str) -> DataFrame:
    """(qname, level, term, qf, qpos): different words, how often and where first."""
    own = check(queries).where(F.col("model") == model)
    return own.groupBy("qname", "level", "term").agg(F.count("*").alias("qf"), F.min("qpos").alias("qpos"))


def levels_of(terms: DataFrame) -> set[str]:
    return {r.level for r in terms.select("level").distinct().collect()}


def weighed(index: Index, known: DataFrame, level: str, k2: float) -> DataFrame:
    """(qname, term, qpos, weight, avdl) of (qname, term, qf, qpos, n): what a full occurrence of each word is worth to its query; negative if
    most units have it."""
    rows = known.withColumn("level", F.lit(level)).join(F.broadcast(index.stats(level)), "level")
    idf = F.ln((F.col("n_units") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    return rows.select("qname", "term", "qpos", (idf * ((k2 + 1) * F.col("qf") / (k2 + F.col("qf")))).alias("weight"), "avdl")


def saturation(tf: str, length: str, k1: float, b: float) -> Column:
    """The share of a word's weight that so many occurrences in a unit of such a length are worth: rises with tf, falls with the length."""
    return (k1 + 1) * F.col(tf) / (k1 * ((1 - b) + b * F.col(length) / F.col("avdl")) + F.col(tf))


def scored_blocks(index: Index, chosen: DataFrame, k1: float, b: float) -> DataFrame:
    """(qname, ord, score, first) of the scenes in blocks (qname, segment, bucket, span, slice, term, weight, avdl, qpos)."""
    rows = index.of_blocks(stored(chosen.drop("n", "most", "m")), F.arrays_zip("ords", "tfs", "lens").alias("e"))
    rows = rows.select("qname", "weight", "avdl", "qpos", F.inline("e"))
    score = F.col("weight") * saturation("tfs", "lens", k1, b)
    return rows.groupBy("qname", F.col("ords").alias("ord")).agg(F.sum(score).alias("score"), F.min(F.struct("qpos", F.col("ords").alias("ord"))).alias("first"))


def bounded(index: Index, terms: DataFrame, k1: float, k2: float, b: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the words, and scores of some: what ``bm25`` over scenes needs to score no more than it must.

    The first table has (qname, segment, slice, bucket, span, term, n, most, weight, avdl, qpos, role), ``most`` being the largest score that
    the word can give a scene of the block, from the bounds beside it (a word of negative weight gives most where it occurs least). A slice's
    bound is the sum of what its words can give; where all words are worth less than nothing, the best of them. The slices of the highest
    bounds that have k scenes together are scored at once (role 0); their k-th score is what others have to reach. Slices whose bound does are
    role 1, and the rest, role 2, have none of the k best. The second table has the scores of role 0.
    """
    own = index.blocks.select("segment", "bucket", "span", "slice", "term", "n", "least_tf", "most_tf", "least_len", "most_len")
    beside = stored(own.join(index.placed(terms.drop("level")), ["segment", "bucket", "term"]))
    weights = weighed(index, beside.groupBy("qname", "term", "qf", "qpos").agg(F.sum("n").alias("n")), "scene", k2)
    most = F.col("weight") * F.when(F.col("weight") >= 0, saturation("most_tf", "least_len", k1, b)).otherwise(saturation("least_tf", "most_len", k1, b))
    blocks = beside.drop("qf", "qpos").join(weights, ["qname", "term"]).select("qname", "segment", "slice", "bucket", "span", "term", "n", most.alias("most"), "weight", "avdl", "qpos")
    blocks = stored(blocks)
    bound = F.when(F.max("most") >= 0, F.sum(F.greatest("most", F.lit(0.0)))).otherwise(F.max("most"))
    slices = blocks.groupBy("qname", "segment", "slice").agg(bound.alias("bound"), F.max("n").alias("m"))
    order = Window.partitionBy("qname").orderBy(F.desc("bound"), "segment", "slice")
    best = slices.withColumn("no", F.row_number().over(order)).where(F.col("no") <= k)
    before = F.coalesce(F.sum("m").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    probes = stored(best.withColumn("before", before).where(F.col("before") < k).select("qname", "segment", "slice"))
    scores = stored(scored_blocks(index, blocks.join(F.broadcast(probes), ["qname", "segment", "slice"]), k1, b))
    order = Window.partitionBy("qname").orderBy(F.desc("score"))
    reached = scores.withColumn("no", F.row_number().over(order)).where(F.col("no") == k).select("qname", F.col("score").alias("reached"))
    role = F.when(F.col("probe"), 0).when(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - 10.0 ** (1 - DIGITS)), 1).otherwise(2)
    roles = slices.join(F.broadcast(probes.withColumn("probe", F.lit(True))), ["qname", "segment", "slice"], "left").join(F.broadcast(reached), "qname", "left")
    return blocks.join(roles.select("qname", "segment", "slice", role.alias("role")), ["qname", "segment", "slice"]), scores


def skipped(index: Index, queries: DataFrame, k1: float = 1.8, k2: float = 5.0, b: float = 0.75, k: int = 100) -> DataFrame:
    """(qname, blocks, scored): blocks that the words of each BM25 query over scenes have, and those that are scored."""
    blocks, _ = bounded(index, terms_of(queries, "bm25").where("level = 'scene'"), k1, k2, b, k)
    return blocks.groupBy("qname").agg(F.count("*").alias("blocks"), F.count(F.when(F.col("role") < 2, 1)).alias("scored"))


def bm25(index: Index, queries: DataFrame, k1: float = 1.8, k2: float = 5.0, b: float = 0.75, k: int = 100) -> DataFrame:
    """(qname, unit_id, rank, score). Negative idf stays negative; unknown words count for nothing.

    Over scenes, only slices that can hold one of the k best are scored (see ``bounded``); the result is that of scoring all.
    """
    terms, parts = terms_of(queries, "bm25"), []
    levels = levels_of(terms)
    if "play" in levels:
        tf = index.unit_tf("play", terms)
        known = terms.where("level = 'play'").join(tf.groupBy("term").agg(F.count("*").alias("n")), "term")
        rows = weighed(index, known, "play", k2).join(tf, "term").join(index.unit_len("play"), "unit_id")
        score = F.col("weight") * saturation("tf", "len", k1, b)
        parts.append(top(rows.groupBy("qname", "unit_id").agg(F.sum(score).alias("score"), F.min(F.struct("qpos", "first_ord")).alias("first")), k))
    if "scene" in levels or not parts:
        blocks, scores = bounded(index, terms.where("level = 'scene'"), k1, k2, b, k)
        scores = scores.unionByName(scored_blocks(index, blocks.where("role = 1").drop("role"), k1, b))
        best = top(scores.withColumnRenamed("ord", "unit_id"), k).withColumnRenamed("unit_id", "ord")
        names = index.scenes.select(F.col("doc_ord").alias("ord"), F.col("scene_id").alias("unit_id"))
        parts.append(names.join(F.broadcast(best), "ord").select("qname", "unit_id", "rank", "score"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ql(index: Index, queries: DataFrame, mu: float = 250.0, k: int = 100) -> DataFrame:
    """(qname, unit_id, rank, score): Dirichlet-smoothed likelihood over all query positions, for units that have at least one word.

    A word that a unit lacks adds the same as its smoothing, so it is added once per query and only the words present are joined.
    """
    terms = terms_of(queries, "ql")
    total = index.stats("scene").select("total_terms").scalar()
    smooth = terms.join(index.cf(terms), "term").select("qname", "level", "term", "qf", "qpos", (mu * F.col("cf") / total).alias("bg"))
    base = smooth.groupBy("qname").agg(F.sum(F.col("qf") * F.ln("bg")).alias("base"), F.sum("qf").alias("words"))
    gain = F.col("qf") * (F.ln(F.col("tf") + F.col("bg")) - F.ln("bg"))
    parts = []
    for level in sorted(levels_of(terms)):
        own = terms.where(F.col("level") == level)
        rows = smooth.where(F.col("level") == level).join(index.unit_tf(level, own), "term").groupBy("qname", "unit_id").agg(F.sum(gain).alias("gain"), F.min(F.struct("qpos", "first_ord")).alias("first"))
        rows = rows.join(base, "qname").join(index.unit_len(level), "unit_id")
        score = F.col("base") + F.col("gain") - F.col("words") * F.ln(F.col("len") + mu)
        parts.append(top(rows.select("qname", "unit_id", score.alias("score"), "first"), k))
    if not parts:
        parts = [index.blocks.sparkSession.createDataFrame([], "qname string, unit_id string, rank bigint, score double")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
