"""Mixing sources to target weights by a low-discrepancy schedule (built-in functions only).

1. Each source gets a target number of words by weight, none above ``MAX_EPOCHS`` times its size.
2. Slots 0, 1, 2, ... of ``block_words`` words each are dealt to sources: the golden-ratio point of a slot falls into one interval of
   the sources' cumulative target weights.
3. A source's slots are ranked; its documents, in shuffled order, form one stream that is cut into equal blocks of words. The slot of
   rank r takes block r modulo the number of blocks, so blocks repeat in epochs. The slot that reaches the target is cut there.
4. A document's share is the words of it in the blocks taken, and its place in the mix the slots that take them: ``mixed`` gives the
   rows in the order of their slots, so every stretch of the output is mixed to the targets.

Nothing grows beyond a task: ranks and stream positions are two-level prefix sums (over chunks or buckets, then inside one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import count_words, fresh_names, stored, written

#: Words of one block, most epochs of a source, cells of the grid over [0, 1) that finds a point's source, slots of a chunk; parts in which
#: rows that repeat id and text are numbered.
BLOCK_WORDS, MAX_EPOCHS, CELLS, CHUNK, PARTS = 1024, 3, 4096, 4096, 64
WEIGHTS = (1, 2, 3)
PHI = 0.6180339887498949


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target): the limit of sharing by weight and resharing what is above max_epochs sizes.

    Sources come by code point, null last; with rising ``cap / weight`` those below the water level are full, and the rest share by
    weight. One row per source, so windows over this table are over sources, never over documents.
    """
    srcs = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    srcs = srcs.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = left / open_weight
    srcs = srcs.withColumn("level", level).withColumn("free", F.col("cap") / F.col("weight") >= F.col("level"))
    running = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    water = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(running)
    target = F.when(water.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * water))
    return srcs.select("source", "source_size", "weight", target.alias("target"))


def golden(i: Column) -> Column:
    """frac(i * golden ratio), exact to 1e-9 for i up to 2**40: high and low bits of i are multiplied apart."""
    high, low = F.shiftright(i, 20), i.bitwiseAND(F.lit((1 << 20) - 1))
    step = (2**20 * PHI) % 1.0
    return F.pmod(F.pmod(high * F.lit(step), F.lit(1.0)) + low * F.lit(PHI), F.lit(1.0))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, rank, slot): the slots that each source needs to reach its target, in the order of the low-discrepancy points.

    A source short of slots after the last one (by the sequence's discrepancy, a few at most) gets the missing ranks in slots after it.
    """
    need = F.ceil(F.col("target") / F.lit(block_words)) + F.lit(MAX_EPOCHS + 1)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = F.sum("target").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shares = targets.where(F.col("target") > 0).select(
        "source", need.cast("bigint").alias("need"), whole.alias("all"), F.ceil(whole / F.lit(block_words)).alias("slots"),
        ((F.sum("target").over(by_name) - F.col("target")) / whole).alias("lo"), (F.sum("target").over(by_name) / whole).alias("hi"),
    ).withColumn("hi", F.when(F.lead("hi").over(by_name).isNull(), F.lit(2.0)).otherwise(F.lead("lo").over(by_name)))
    cells = shares.select("source", "need", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS)))).alias("cell"))
    slots = (
        shares.agg(F.ceil(F.max("all") / F.lit(block_words)).alias("slots")).where("slots > 0")
        .select("slots", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
        .repartition("chunk")
        .select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, "slots") - 1)).alias("slot"))
        .withColumn("u", golden(F.col("slot"))).withColumn("cell", F.floor(F.col("u") * CELLS))
    )
    dealt = slots.join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("source", "need", "chunk", "slot")
    counts = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    starts = counts.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.chunk") == F.col("s.chunk")))
    ranked = ranked.select("d.source", "d.need", (F.col("s.start") + F.col("d.inside")).alias("rank"), "d.slot").where(F.col("rank") < F.col("need"))
    had = counts.groupBy(F.col("source").alias("had")).agg(F.sum("n").alias("n"))
    short = shares.join(had, F.col("source").eqNullSafe(F.col("had")), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")).where(F.col("n") < F.col("need"))
    rest = short.select("source", "slots", "n", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("rank")).select("source", "rank", (F.col("slots") + F.col("rank") - F.col("n")).alias("slot"))
    return ranked.select("source", "rank", "slot").unionByName(rest)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per input row: (id_col, size, source_size, target, taken, first_slot, slots, mark); mark is a hash of the text.

    ``size`` is the number of words (null text: 0), ``taken`` the words of the document that the mix takes, repeats counted, ``first_slot``
    the first slot that takes any of them (null: none does) and ``slots`` those that take its first word, in order. A source's
    taken words are its target, rounded; no document exceeds three times its size. Null source: a source of its own, last. Null ids are
    shuffled as empty strings; rows that repeat an id are documents of their own. The order depends on ids and sizes only, so reruns
    agree. Targets and slots of sources are worked out from a row per source, in one task: sources are tens or thousands, not as many as
    documents. Other columns are ignored; an empty table gives an empty result.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), count_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark"))
    rows = written(rows.withColumn("bucket", F.substring("key", 1, 3)))
    targets = written(source_targets(rows).withColumn("goal", F.round("target").cast("bigint")))
    b = F.lit(block_words)

    # A source's stream: where each bucket starts, then where each document starts in its bucket.
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "bucket", (F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("from"))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "mark")
    placed = rows.withColumn("nth", F.row_number().over(in_bucket)).withColumn("off", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.alias("p").join(sums.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.bucket") == F.col("s.bucket")))
    placed = placed.select("p.id", "p.source", "p.bucket", "p.nth", "p.size", "p.mark", (F.col("s.from") + F.coalesce("p.off", F.lit(0))).alias("lo"))

    # Slot of rank r: block r modulo the blocks, cut where the source reaches its goal.
    slots = schedule(targets, block_words).alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    blocks = F.ceil(F.col("t.source_size") / b)
    epoch, block = F.floor(F.col("d.rank") / blocks), F.pmod(F.col("d.rank"), blocks)
    start = epoch * F.col("t.source_size") + block * b
    length = F.least(b, F.col("t.source_size") - block * b)
    slots = slots.select(F.col("t.source").alias("source"), block.alias("block"), length.alias("len"), F.least(length, F.col("t.goal") - start).alias("take"), "d.slot").where("take > 0")
    full = F.col("take") == F.col("len")
    taken = slots.groupBy("source", "block").agg(F.sum(full.cast("bigint")).alias("times"), F.coalesce(F.max(F.when(~full, F.col("take"))), F.lit(0)).alias("part"), F.min(F.when(full, F.col("slot"))).alias("whole_slot"), F.min(F.when(~full, F.col("slot"))).alias("part_slot"), F.sort_array(F.collect_list(F.struct("slot", "take"))).alias("slots"))

    # A document's pieces, one for each block that it reaches into.
    last = F.floor((F.col("lo") + F.greatest(F.col("size"), F.lit(1)) - 1) / b)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / b), last)))
    pieces = pieces.withColumn("a", F.greatest("lo", F.col("block") * b)).withColumn("z", F.least(F.col("lo") + F.col("size"), (F.col("block") + 1) * b))
    pieces = pieces.alias("p").join(taken.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block")), "left")
    in_part = F.col("p.a") < F.least(F.col("p.z"), F.col("p.block") * b + F.coalesce("t.part", F.lit(0)))
    first = F.when(F.col("p.z") > F.col("p.a"), F.least("t.whole_slot", F.when(in_part, F.col("t.part_slot"))))
    own = F.transform(F.filter("t.slots", lambda s: F.col("p.block") * b + s.take > F.col("p.lo")), lambda s: s.slot)
    words = (F.col("p.z") - F.col("p.a")) * F.coalesce("t.times", F.lit(0)) + F.greatest(F.lit(0), F.least(F.col("p.z"), F.col("p.block") * b + F.coalesce("t.part", F.lit(0))) - F.col("p.a"))
    done = pieces.groupBy("p.source", "p.bucket", "p.nth", "p.id", "p.size", "p.mark").agg(F.sum(words).cast("bigint").alias("taken"), F.min(first).alias("first_slot"), F.max(F.when((F.col("p.a") == F.col("p.lo")) & (F.col("p.z") > F.col("p.a")), own)).alias("slots"))
    done = done.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return done.select(F.col("d.id").alias(id_col), F.col("d.size").alias("size"), F.col("t.source_size").alias("source_size"), F.col("t.target").alias("target"), F.col("d.taken").alias("taken"), F.col("d.first_slot").alias("first_slot"), F.coalesce("d.slots", F.array().cast("array<bigint>")).alias("slots"), F.col("d.mark").alias("mark"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: int) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes its words, to the nearest whole time (0 to 3), in slot order.

    Each time stands at a slot that takes the row's first word. Rows without words are not taken. Rows that repeat id and text come
    together as often as all of them are taken, shared out evenly and some of them once more for what is left, at the slots of one of them.
    An empty table gives an empty one.
    """
    id_, mark, times_, more, slots, first, time, part, sum_id, sum_mark, sum_part, n_, before, nth = fresh_names(docs, 14)
    taken = mix(docs, id_col, text_col, source_col, **how).where("size > 0")
    times, n = F.sum(F.round(F.col("taken") / F.col("size"))).cast("bigint"), F.count("*")
    times = taken.groupBy(F.col(id_col).alias(id_), F.col("mark").alias(mark)).agg(
        F.floor(times / n).cast("int").alias(times_), F.pmod(times, n).alias(more), F.max("slots").alias(slots), F.min("first_slot").alias(first),
    )
    times = written(times.where((F.col(times_) > 0) | (F.col(more) > 0)))

    def rows(some: DataFrame) -> DataFrame:
        return docs.join(some, F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text_col) == F.col(mark)))

    def repeated(some: DataFrame) -> DataFrame:
        again = some.where(F.col(times_) > 0).withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times_))))
        at = F.coalesce(F.get(F.col(slots), F.col(time) - 1), F.get(F.col(slots), F.size(slots) - 1), F.col(first))
        return again.select(*docs.columns, at.alias(time))

    def in_order(some: DataFrame) -> DataFrame:
        return some.repartitionByRange(time, id_col).sortWithinPartitions(time, id_col).select(*docs.columns)

    even, uneven = times.where(F.col(more) == 0), times.where(F.col(more) > 0)
    if uneven.isEmpty():
        return in_order(repeated(rows(even)))
    # Repeated rows are numbered part by part, so that no task gets all rows of a group.
    parts = stored(rows(uneven).withColumn(part, F.floor(F.rand(3) * PARTS)))
    sums = parts.groupBy(id_, mark, part).agg(F.count("*").alias(n_))
    sums = sums.withColumn(before, F.sum(n_).over(Window.partitionBy(id_, mark).orderBy(part)) - F.col(n_))
    sums = sums.select(F.col(id_).alias(sum_id), F.col(mark).alias(sum_mark), F.col(part).alias(sum_part), before)
    numbered = parts.withColumn(nth, F.row_number().over(Window.partitionBy(id_, mark, part).orderBy(F.lit(0))))
    numbered = numbered.join(sums, F.col(id_).eqNullSafe(F.col(sum_id)) & (F.col(mark) == F.col(sum_mark)) & (F.col(part) == F.col(sum_part)))
    numbered = numbered.withColumn(times_, F.col(times_) + (F.col(before) + F.col(nth) <= F.col(more)).cast("int"))
    return in_order(repeated(rows(even)).unionByName(repeated(numbered)))
