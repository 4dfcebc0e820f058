"""N-gram Jaccard self-join by MinHash banding.

1. A document is the set of its ``NGRAM``-word strings. Documents with equal sets are one node from here on, so copies cost nothing more
   and are never expanded into pairs.
2. Each node has ``bands`` x ``rows`` MinHash values, chosen for the recall wanted at the threshold; one row per band goes to the bucket
   of the band's values. Nodes that share a bucket are candidates.
3. Candidates are narrowed down by their signatures (16 bits of each MinHash value): a pair at the threshold agrees in fewer than
   ``least_agreeing`` values with a probability below ``LOSS``. Each bucket's nodes meet its leader first. Nodes that are not in their
   leader's group by then meet all nodes of the bucket that are in other groups, block by block, so a bucket full of near copies costs
   one comparison a node. The groups are the connected components of what agrees.
4. Only groups are verified, on full n-gram sets: the nodes of a group are dealt to blocks, by size and hash, and a task per two blocks
   takes the common n-grams of all their pairs as a product of two 0/1 matrices. A link is between sizes of a ratio of at least the
   threshold, so only blocks of the same or the next size meet. Rows grow with nodes x blocks; pairs are never rows. A node's set is
   sent once for each block it meets, which is once for all groups of up to a block.
5. A task returns how many documents and how many sets each node is linked to, and the least node it is connected with; classes are
   the connected components over these, by label propagation with pointer jumping.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.anchors import hash_between, keyed, mixed, prefix_hashes, raw, word_symbols
from scriptorium.llm.common import discarded, fresh_names, python_workers, stored, tasks

#: Words of an n-gram, least Jaccard similarity of a link, share of links at that similarity that must meet in some bucket, rows of a band.
NGRAM, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
#: Probability that the signatures of a pair at the threshold are taken for too different.
LOSS = 1e-7
#: Nodes of a block of signatures; nodes and n-grams of a block of sets, by expectation; columns of a matrix, and pairs, at a time.
SIGNATURES, BLOCK_NODES, BLOCK_GRAMS, COLUMNS, PAIRS = 1024, 512, 500_000, 4096, 1 << 16
#: Node ids are 64-bit hashes of sets: of n different sets, n**2 / 2**65 pairs are expected to be taken for equal.
SALT = np.uint64(0xA0761D6478BD642F)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands of ``rows`` values by which a pair at the threshold shares a bucket with probability ``recall``."""
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows))))


def least_agreeing(samples: int, threshold: float = THRESHOLD, loss: float = LOSS) -> int:
    """Most values that a pair at the threshold fails to agree in with a probability of at most ``loss``."""
    below = 0.0
    for k in range(samples + 1):
        below += math.comb(samples, k) * threshold**k * (1 - threshold) ** (samples - k)
        if below > loss:
            return k
    return samples


def ngram_sets(texts: pa.Array, ngram: int = NGRAM) -> list[np.ndarray]:
    """Sorted different hashes of each text's n-grams; a text of fewer words has one n-gram of all its words, an empty one none."""
    data, offsets = raw(texts)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    values, bounds, _, _ = word_symbols(data, offsets)
    out = []
    for a, z in zip(bounds, bounds[1:], strict=False):
        sums = prefix_hashes(values[a:z])
        at = np.arange(max(z - a - ngram + 1, min(z - a, 1)))
        out.append(np.unique(hash_between(sums, at, np.minimum(at + ngram, z - a))))
    return out


def minhashes(grams: np.ndarray, count: int) -> np.ndarray:
    """Least value of each of ``count`` random linear maps over a set."""
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)
    least = np.full(count, ~np.uint64(0))
    for at in range(0, len(grams), 2048):
        np.minimum(least, (grams[at : at + 2048, None] * a + b).min(axis=0), out=least)
    return least


def nodes_of(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """(id, mark, node, grams, buckets, signature) of ``keyed`` rows; documents without words are left out."""
    python_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mixed(np.arange(1, bands + 1, dtype=np.uint64) * SALT)
        for batch in batches:
            sets = ngram_sets(batch.column(2), ngram)
            some = [i for i, s in enumerate(sets) if len(s)]
            node, grams, buckets, signatures = [], [], [], []
            for i in some:
                s = sets[i]
                node.append(int(mixed(np.array([mixed(s ^ SALT).sum(dtype=np.uint64) + np.uint64(len(s))])).view(np.int64)[0]))
                grams.append(len(s))
                values = minhashes(s, bands * rows)
                key = salts.copy()
                for k in range(rows):
                    key = mixed(key ^ values.reshape(bands, rows)[:, k])
                buckets.append(key.view(np.int64))
                signatures.append((mixed(values) >> np.uint64(48)).astype(np.uint16).tobytes())
            take = pa.array(some, pa.int64())
            columns = [pa.array(node, pa.int64()), pa.array(grams, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=["id", "mark", "node", "grams", "buckets", "signature"])

    return docs.mapInArrow(run, "id bigint, mark bigint, node bigint, grams bigint, buckets array<bigint>, signature binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, of the nodes in ``edges`` (a, b)."""
    ways = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), "label")
        far = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        after = stored(step.join(far, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), F.col("label").alias("was")))
        done = after.where("label <> was").isEmpty()
        discarded(labels)
        labels = after.select("node", "label")
        if done:
            discarded(ways)
            return labels


def alike(one: np.ndarray, two: np.ndarray, n: np.ndarray, m: np.ndarray, least: int, threshold: float) -> np.ndarray:
    """Whether each pair of signatures agrees enough, and sizes n and m allow a link at all."""
    return ((one == two).sum(axis=1) >= least) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)


def signature_rows(column: pa.Array) -> np.ndarray:
    """One row of 16-bit values per signature."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint16).reshape(len(column), -1)


def led(met: DataFrame, nodes: DataFrame, least: int, threshold: float) -> DataFrame:
    """(a, b): the nodes b of each bucket that agree with its leader a, the least of them."""
    leaders = met.groupBy(F.col("bucket").alias("bucket_")).agg(F.min("node").alias("a"))
    pairs = met.join(leaders, F.col("bucket") == F.col("bucket_")).where("node <> a").select("a", F.col("node").alias("b")).distinct()
    one = nodes.select(F.col("node").alias("a_"), F.col("grams").alias("n"), F.col("signature").alias("x"))
    two = nodes.select(F.col("node").alias("b_"), F.col("grams").alias("m"), F.col("signature").alias("y"))
    both = pairs.join(one, F.col("a") == F.col("a_")).join(two, F.col("b") == F.col("b_")).select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                yield batch.select([0, 1]).filter(pa.array(alike(signature_rows(batch.column(4)), signature_rows(batch.column(5)), n, m, least, threshold)))

    return both.mapInArrow(run, "a bigint, b bigint")


def meetings(block: Column, blocks: Column, other: Column, others: Column, *key: Column) -> tuple[Column, Column]:
    """Tiles of a node in one of ``blocks`` blocks of one side, and of one in one of ``others`` blocks of the other side."""
    name = lambda i, j: F.xxhash64(*key, i, j)
    until = lambda n: F.sequence(F.lit(0), n - 1)
    return F.transform(until(others), lambda j: name(block, j)), F.transform(until(blocks), lambda i: name(i, other))


def left_over(met: DataFrame, nodes: DataFrame, groups: DataFrame, least: int, threshold: float) -> DataFrame:
    """(a, b): labels of groups to be joined, because nodes of both share a bucket and agree; leaders have been met before."""
    own = met.join(groups, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    state = own.groupBy(F.col("bucket").alias("bucket_")).agg(F.count("*").alias("n"), F.min(F.struct("node", "label")).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high"))
    state = state.where("n > 2 AND low < high").select("bucket_", "n", F.col("lead.label").alias("main"))
    own = stored(own.join(state, F.col("bucket") == F.col("bucket_")).select("bucket", "node", "label", "n", (F.col("label") != F.col("main")).alias("apart")))
    rests = own.where("apart").groupBy(F.col("bucket").alias("bucket_")).agg(F.count("*").alias("rest"))
    count = lambda n: F.ceil(n / SIGNATURES).cast("int")
    dealt = own.join(rests, F.col("bucket") == F.col("bucket_")).withColumn("blocks", count(F.col("rest"))).withColumn("others", count(F.col("n")))
    at = F.xxhash64(F.lit(5), "node")
    here, there = meetings(F.pmod(at, F.col("blocks")).cast("int"), F.col("blocks"), F.pmod(at, F.col("others")).cast("int"), F.col("others"), F.col("bucket"))
    side = lambda tiles, s: F.transform(tiles, lambda t: F.struct(t.alias("tile"), F.lit(s).alias("side")))
    both = F.when(F.col("apart"), F.concat(side(here, 0), side(there, 1))).otherwise(side(there, 1))
    dealt = dealt.select("node", "label", F.explode(both).alias("t")).select(F.col("node").alias("node_"), "label", "t.tile", "t.side")
    rows = dealt.join(nodes.select("node", "grams", "signature"), F.col("node_") == F.col("node")).select("tile", "side", "label", "grams", "signature")
    rows = rows.repartition(tasks(rows.sparkSession), "tile").sortWithinPartitions("tile", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(table: pa.Table) -> pa.RecordBatch:
            """Whole tiles, sorted; each row of side 0 meets all rows of side 1 of its tile."""
            tile, zero = table["tile"].to_numpy(), table["side"].to_numpy() == 0
            label, grams, values = table["label"].to_numpy(), table["grams"].to_numpy(), signature_rows(table["signature"].combine_chunks())
            starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            n = np.add.reduceat(zero.astype(np.int64), starts)
            m = np.diff(np.append(starts, len(tile))) - n
            one = np.flatnonzero(zero)
            many, first = np.repeat(m, n), np.repeat(starts + n, n)
            low, high, at = [], [], 0
            while at < len(one):
                to = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), PAIRS, "right")) + at)
                x = np.repeat(one[at:to], many[at:to])
                y = np.repeat(first[at:to] - (np.cumsum(many[at:to]) - many[at:to]), many[at:to]) + np.arange(len(x))
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                hit = alike(values[x], values[y], grams[x], grams[y], least, threshold)
                low.append(np.minimum(label[x[hit]], label[y[hit]])), high.append(np.maximum(label[x[hit]], label[y[hit]]))
                at = to
            pairs = np.unique(np.stack([np.concatenate(low or [np.zeros(0, np.int64)]), np.concatenate(high or [np.zeros(0, np.int64)])], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
                table = pa.Table.from_batches(held)
                tile = table["tile"].to_numpy()
                whole = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
                if whole >= SIGNATURES:
                    yield compared(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
        if held:
            yield compared(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def candidate_groups(nodes: DataFrame, least: int, threshold: float) -> DataFrame:
    """(node, label) of the nodes that may have links: those of one label include all that a node of it can be similar to."""
    found = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = found.groupBy(F.col("bucket").alias("bucket_")).agg(F.count("*").alias("n")).where("n > 1")
    met = stored(found.join(shared, F.col("bucket") == F.col("bucket_"), "left_semi").select("bucket", "node"))
    groups = components(led(met, nodes, least, threshold))
    more = stored(left_over(met, nodes, groups, least, threshold))
    if more.isEmpty():
        return groups
    joined = components(more).select(F.col("node").alias("label_"), F.col("label").alias("to"))
    labels = groups.unionByName(more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(groups, "node", "left_anti").select("node", F.col("node").alias("label")))
    return stored(labels.join(joined, F.col("label") == F.col("label_"), "left").select("node", F.coalesce("to", "label").alias("label")))


def common_grams(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Number of common n-grams of each set of ``one`` with each of ``two``."""
    words = np.intersect1d(np.unique(np.concatenate(one)), np.unique(np.concatenate(two)), assume_unique=True)
    out, width = np.zeros((len(one), len(two)), np.int64), min(COLUMNS, len(words))

    def places(sets: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(words, np.intersect1d(s, words, assume_unique=True)) for s in sets]

    def matrix(at: list[np.ndarray], first: int) -> np.ndarray:
        found = np.zeros((len(at), width), np.float32)
        for row, k in zip(found, at, strict=True):
            row[k[np.searchsorted(k, first) : np.searchsorted(k, first + width)] - first] = 1
        return found

    x, y = places(one), places(two)
    for first in range(0, len(words), max(width, 1)):
        out += (matrix(x, first) @ matrix(y, first).T).astype(np.int64)
    return out


def least_connected(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Of each node, the least one it is connected with by the links of a symmetric matrix."""
    low = nodes.copy()
    while True:
        new = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == low).all():
            return low
        low = new


def verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(node, low, n_docs, n_sets): for each two blocks that a node is in, the least node it is connected with there, and to how many
    documents and sets of other nodes it is linked there."""
    # Sizes of one band differ by less than the threshold's ratio, so the partners of a node are in its own band and the two beside it.
    width = max(-np.log(threshold) * (1 + 1e-9), 1e-9)
    members = groups.join(nodes, "node").select("node", "label", "id", "mark", "times", "grams", F.floor(F.log("grams") / F.lit(float(width))).alias("band"))
    members = stored(members)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int")
    blocks = members.groupBy("label", "band").agg(blocks.alias("blocks"), F.count("*").alias("n"))
    whole = members.groupBy("label").agg(F.count("*").alias("all"), F.sum("grams").alias("sum")).where((F.col("all") <= BLOCK_NODES) & (F.col("sum") <= BLOCK_GRAMS)).select("label", F.lit(True).alias("whole"))
    beside = [blocks.select("label", (F.col("band") + k).alias("band"), F.col("blocks").alias(name)) for k, name in ((1, "below"), (-1, "above"))]
    blocks = blocks.drop("n").join(beside[0], ["label", "band"], "left").join(beside[1], ["label", "band"], "left").join(whole, "label", "left")
    dealt = members.join(blocks, ["label", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    # A tile is two blocks; side 0 is the smaller band, or the smaller block of a band, and 2 both sides where a block meets itself.
    j, at = F.col("block"), lambda name: F.sequence(F.lit(0), F.coalesce(F.col(name), F.lit(0)) - 1)
    tile = lambda band, i, next_, k, side: F.struct(F.xxhash64("label", band.alias("b"), i, next_, k).alias("tile"), side.cast("int").alias("side"))
    none = F.expr("cast(array() as array<struct<tile:bigint,side:int>>)")
    own = F.transform(at("blocks"), lambda k: tile(F.col("band"), F.least(j, k), F.lit(0), F.greatest(j, k), F.when(k == j, 2).when(j < k, 0).otherwise(1)))
    up = F.when(F.col("above") > 0, F.transform(at("above"), lambda k: tile(F.col("band"), j, F.lit(1), k, F.lit(0)))).otherwise(none)
    down = F.when(F.col("below") > 0, F.transform(at("below"), lambda k: tile(F.col("band") - 1, k, F.lit(1), j, F.lit(1)))).otherwise(none)
    # A group of no more than a block meets in one tile, whatever its bands.
    all_ = F.array(F.struct(F.xxhash64("label").alias("tile"), F.lit(2).alias("side")))
    tiles = F.when(F.coalesce("whole", F.lit(False)), all_).otherwise(F.concat(own, up, down))
    return in_tiles(docs, dealt.withColumn("tiles", tiles), ngram, threshold)


def in_tiles(docs: DataFrame, dealt: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(node, low, n_docs, n_sets) of nodes (node, id, mark, times, tiles) whose sets meet in tiles, those of side 0 or 2 with those of side 1
    or 2: for each tile that a node is in, the least node it is connected with there, and to how many documents and sets of other nodes it
    is linked there."""
    dealt = dealt.select("node", F.col("id").alias("id_"), F.col("mark").alias("mark_"), "times", "tiles")
    texts = docs.join(dealt, F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_"))).select("node", "times", "tiles", "text")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in ngram_sets(batch.column(3), ngram)], pa.binary())], names=["node", "times", "tiles", "grams"])

    # Rows that repeat id and text give the same set again.
    rows = texts.mapInArrow(sets, "node bigint, times bigint, tiles array<struct<tile:bigint,side:int>>, grams binary").dropDuplicates(["node"])
    rows = rows.select("node", "times", F.explode("tiles").alias("t"), "grams").select("t.tile", "t.side", "node", "times", "grams")
    rows = rows.repartition(tasks(rows.sparkSession), "tile").sortWithinPartitions("tile")

    def count(held: list[tuple]) -> tuple[np.ndarray, ...]:
        side, nodes_, times = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 3))
        grams = [np.frombuffer(r[4], np.uint64) for r in held]
        size, here = np.array([len(g) for g in grams], np.int64), [np.flatnonzero(side != 1), np.flatnonzero(side != 0)]
        near = np.zeros((len(held), len(held)), bool)
        if len(here[0]) and len(here[1]):
            common = common_grams([grams[i] for i in here[0]], [grams[i] for i in here[1]])
            near[np.ix_(*here)] = common >= threshold * (size[here[0]][:, None] + size[here[1]][None, :] - common) - 1e-9
            near |= near.T
            np.fill_diagonal(near, False)
        return nodes_, least_connected(near, nodes_), near.astype(np.int64) @ times, near.sum(axis=1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c).astype(np.int64)) if out else pa.array([], pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)]
            return pa.RecordBatch.from_arrays(columns, names=["node", "low", "n_docs", "n_sets"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    out.append(count(held))
                    held = []
                held.append(row)
            if len(out) > 64:
                yield flush()
                out = []
        if held:
            out.append(count(held))
        yield flush()

    return rows.mapInArrow(run, "node bigint, low bigint, n_docs bigint, n_sets bigint")


def tile(*key: Column, side: int) -> Column:
    return F.struct(F.xxhash64(*key).alias("tile"), F.lit(side).alias("side"))


def spanning(docs: DataFrame, nodes: DataFrame, groups: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """(a, b): links whose components are those of all links, without looking at all of them.

    Each group's sets meet its leader first, the one that most rows have. What is linked to it is in one component; only the rest then meets
    the whole group. In a group of copies of one text that is next to nothing, and the work is linear in the group. Groups are cut into
    blocks, each of which the leader goes to.
    """
    members = stored(groups.join(nodes, "node").select("node", "label", "id", "mark", "times", "grams"))
    blocks = lambda: F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("grams") / BLOCK_GRAMS)).cast("int")
    until = lambda n: F.sequence(F.lit(0), n - 1)
    sizes = members.groupBy(F.col("label").alias("label_")).agg(blocks().alias("blocks"), F.max(F.struct("times", (-F.col("node")).alias("minus"), "node"))["node"].alias("leader"))
    dealt = stored(members.join(sizes, F.col("label") == F.col("label_")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("label_"))
    to_all = F.transform(until(F.col("blocks")), lambda k: tile(F.col("label"), k, side=0))
    star = stored(in_tiles(docs, dealt.withColumn("tiles", F.when(F.col("node") == F.col("leader"), to_all).otherwise(F.array(tile(F.col("label"), F.col("block"), side=1)))), ngram, threshold))
    links = star.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    apart = star.where("n_sets = 0").select(F.col("node").alias("node_")).distinct()
    apart = stored(dealt.where("node <> leader").join(apart, F.col("node") == F.col("node_"), "left_semi").select("node", "label", "grams"))
    if apart.isEmpty():
        return links
    rests = apart.groupBy(F.col("label").alias("label_")).agg(blocks().alias("rests"))
    whole = dealt.join(rests, F.col("label") == F.col("label_")).join(apart.select(F.col("node").alias("node_"), F.lit(True).alias("rest")), F.col("node") == F.col("node_"), "left")
    own = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("rests")).cast("int")
    met = F.transform(until(F.col("rests")), lambda k: tile(F.col("label"), k, F.col("block"), side=1))
    meets = F.transform(until(F.col("blocks")), lambda k: tile(F.col("label"), own, k, side=0))
    found = in_tiles(docs, whole.withColumn("tiles", F.when(F.col("rest"), F.concat(met, meets)).otherwise(met)), ngram, threshold)
    return links.union(found.where("node <> low").select("node", "low"))


def candidates(docs: DataFrame, ngram: int, threshold: float, recall: float, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, mark, node, ...) of all documents with words; (node, at, id, mark, times, grams, buckets, signature) of their different sets;
    (node, label) of those that may have links, in groups that no link leaves."""
    bands = bands_for(threshold, recall, rows)
    members = stored(nodes_of(docs, ngram, bands, rows))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    nodes = members.groupBy("node").agg(F.min(order).alias("at"), F.count("*").alias("times"), F.first("grams").alias("grams"), F.first("buckets").alias("buckets"), F.first("signature").alias("signature"))
    nodes = stored(nodes.select("node", "at.id", "at.mark", "times", "grams", "buckets", "signature"))
    return members, nodes, candidate_groups(nodes, least_agreeing(bands * rows, threshold), threshold)


def similar_nodes(docs: DataFrame, ngram: int, threshold: float, recall: float, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, mark, node) of all documents with words; classes (node, label) of the nodes that have links; (node, times, n_docs, n_sets) of
    the nodes that other rows share or that have links: their rows, and the documents and sets of other nodes they are linked to."""
    members, nodes, groups = candidates(docs, ngram, threshold, recall, rows)
    found = stored(verified(docs, nodes, groups, ngram, threshold))
    classes = components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    linked = found.groupBy(F.col("node").alias("node_")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_sets").alias("n_sets"))
    counts = nodes.select("node", "times").join(linked, F.col("node") == F.col("node_"), "left").where("times > 1 OR n_docs > 0")
    counts = counts.select("node", "times", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_sets", F.lit(0)).alias("n_sets"))
    return members.select("id", "mark", "node"), classes, counts


def labelled_rows(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, mark, node, class_id, class_size) of documents with words."""
    labelled = members.join(classes, "node", "left").select("id", "mark", "node", F.coalesce("label", "node").alias("label"))
    sizes = labelled.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    sizes = sizes.where("class_size > 1")
    return labelled.join(sizes, "label", "left").select("id", "mark", "node", F.when(F.col("class_size").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("bigint").alias("class_size"))


def join_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per input row: (id_col, class_id, class_size, n_links, n_sets, mark).

    A class is a connected component of links, copies included; ``class_id`` is its least id (null only if all its ids are), and
    ``class_size`` its number of rows. ``n_links`` counts the other rows that are similar to the row, rows with an equal set included;
    ``n_sets`` the different sets other than its own among them. ``mark`` is a hash of the text, which tells rows that repeat an id apart;
    rows that repeat id and text are copies of each other. Null and empty texts have no n-grams: each such row is a class of its own,
    without links. Ids are integers. Other columns are ignored; an empty table gives an empty result.
    """
    rows_ = keyed(docs, id_col, text_col)
    members, classes, counts = similar_nodes(rows_, ngram, threshold, recall, rows)
    counts = counts.select(F.col("node").alias("node_"), (F.col("times") - 1 + F.col("n_docs")).alias("n_links"), "n_sets")
    done = labelled_rows(members, classes).join(counts, F.col("node") == F.col("node_"), "left")
    done = done.select("id", "mark", "class_id", "class_size", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_links", "n_sets")))
    none = F.lit(0).cast("bigint")
    empty = rows_.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("id", "mark", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"), none.alias("n_links"), none.alias("n_sets"))
    return done.unionByName(empty).select(F.col("id").alias(id_col), "class_id", "class_size", "n_links", "n_sets", "mark")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: float) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose class has a row of smaller id.

    Rows that repeat the least id of a class with another text stay only where their text is the first by hash; rows that repeat id and
    text all stay. Rows without words, and rows whose class has no id at all, stay. Ids are integers; an empty table gives an empty one.
    """
    how = {"ngram": NGRAM, "threshold": THRESHOLD, "recall": RECALL, "rows": ROWS} | how
    rows_ = keyed(docs, id_col, text_col)
    members, nodes, groups = candidates(rows_, **how)
    classes = components(spanning(rows_, nodes, groups, how["ngram"], how["threshold"]))
    found = labelled_rows(members.select("id", "mark", "node"), classes).where("class_size > 1")
    firsts = found.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy(F.col("class_id").alias("class_")).agg(F.min("mark").alias("first"))
    joined = found.join(firsts, F.col("class_id") == F.col("class_"), "left").where(F.col("class_id").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("class_id")) | (F.col("mark") != F.col("first"))))
    id_, mark = fresh_names(docs, 2)
    gone = joined.select(F.col("id").alias(id_), F.col("mark").alias(mark)).distinct()
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (text == F.col(mark)), "left_anti")
