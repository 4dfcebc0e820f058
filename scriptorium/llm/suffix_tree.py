"""Substring dedup of words by prefix-partitioned suffix trees.

1. Segments (see anchors) say which stretches share an anchor with a stretch of another document. Equal segments collapse to one,
   labelled with the smallest and the largest of its documents, before anything moves.
2. Of each different segment the suffix at each window start is a leaf, taken to the depth of ``WINDOW`` words and spelled as names of
   ``STEP`` words each, with the segment's two documents.
3. Suffixes are dealt to groups by variable-length prefixes: groups are counted, and where one has more than ``GROUP_SUFFIXES``, its prefix
   is made longer by a name, again and again. In its partition each group is sorted; as many neighbouring groups as fit in memory make one
   subtree, and where more come together, they are cut where a prefix changes.
4. At the depth of ``WINDOW`` words, a node's smallest document is the least of its leaves'. Leaves with a larger document, the node's own
   or another leaf's, are repeats of it. A prefix that has come to the full depth is such a node by itself, and a partial aggregate finds its
   smallest document before the shuffle.
5. Neighbouring repeats of a segment with the same smallest document are one: the maximal repeat, (offset, windows, document), which every
   occurrence of the segment in a later document loses. Nothing is removed but by these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.anchors import covered, fields, find_segments, hash_between, keyed, packed, prefix_hashes, run_of, same_row, start_of, unpacked, word_symbols, words
from scriptorium.llm.common import discarded, lookup, stored, tasks

#: Words of a repeat, of an anchor's string and of one name.
WINDOW, GRAM, STEP = 50, 20, 10
#: Suffixes of one subtree, and of a group that needs no longer prefix.
TREE_SUFFIXES, GROUP_SUFFIXES = 200_000, 20_000
LAST = (1 << 63) - 1


class SubTree:
    """Suffix tree of sorted suffixes, each a row of names, as the common-prefix depths of neighbours."""

    def __init__(self, names: np.ndarray) -> None:
        self.names = names
        differs = names[1:] != names[:-1]
        self.depth = np.where(differs.any(axis=1), differs.argmax(axis=1), names.shape[1])

    def nodes(self, depth: int) -> np.ndarray:
        """First leaf of each subtree below an edge that reaches ``depth`` names, in leaf order."""
        return np.append(0, np.flatnonzero(self.depth < depth) + 1)

    def least(self, depth: int, labels: np.ndarray) -> np.ndarray:
        """Of each leaf, the smallest label below the node at ``depth`` names that it is under."""
        nodes = self.nodes(depth)
        return np.repeat(np.minimum.reduceat(labels, nodes), np.diff(np.append(nodes, len(labels))))


#: The segments of a row whose suffixes go to the trees; the row's id and last are their documents. Half an anchor beside the hash is enough.
PLAN = "array<struct<half:int,seg:bigint,start:int,run:int,last:bigint>>"
LEAF = "half int, seg bigint, off int, least bigint"
RESULT = "n_words bigint, n_removed bigint, kept string, kept_sha256 string"
RESULT_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string())


def result(text: bytes, starts: np.ndarray, ends: np.ndarray, keep_text: bool) -> tuple:
    found = text.split()  # at ASCII white space
    kept = list(compress(found, (~covered(starts, ends, len(found))).tolist())) if len(starts) else found
    text = b" ".join(kept)
    return len(found), len(found) - len(kept), text.decode() if keep_text else None, hashlib.sha256(text).hexdigest()


def order() -> Column:
    """Null ids come last."""
    return F.coalesce("id", F.lit(LAST))


def half(anchor: str = "anchor") -> Column:
    return F.shiftright(F.col(anchor), 32).cast("int")


def planned(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The segments whose suffixes go to the trees, by the row that has them first, (id, mark, wanted); and all segments that may have
    anything to lose, (anchor, seg, id, mark, place)."""
    found = stored(find_segments(docs, words, window, gram).drop("twice"))
    # Only anchors that two documents have matter; that leaves a fraction of the segments.
    again = found.groupBy(F.col("anchor").alias("anchor_")).agg(F.min(order()).alias("first_"), F.max(order()).alias("final")).where("first_ < final").select("anchor_")
    near = stored(found.join(again, F.col("anchor") == F.col("anchor_")).select("anchor", "seg", "id", "mark", "place"))
    discarded(found)
    segs = near.groupBy("anchor", "seg").agg(F.min(order()).alias("first"), F.max(order()).alias("last"), F.min(F.struct(order().alias("order"), "id", "mark", "place")).alias("at"))
    # Windows can only repeat between segments of an anchor that begin in different documents.
    anchors = segs.groupBy(F.col("anchor").alias("a3")).agg(F.min("first").alias("low"), F.max("first").alias("high"))
    wanted = segs.join(anchors, F.col("anchor") == F.col("a3")).where("low < high OR first < last")
    wanted = wanted.select("at.id", "at.mark", F.struct(half().alias("half"), "seg", start_of(F.col("at.place")).alias("start"), run_of(F.col("at.place")).alias("run"), "last").alias("x"))
    return wanted.groupBy("id", "mark").agg(F.collect_list("x").alias("wanted")), near


def settled(docs: DataFrame, plan: DataFrame, near: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Every ``keyed`` row, with its result if no document shares anything with it, else with its packed text and segments."""
    open_ = near.groupBy("id", "mark").agg(F.lit(True).alias("open")).select(F.col("id").alias("id3"), F.col("mark").alias("mark3"), "open")
    plan = plan.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "wanted")
    plan = open_.join(plan, F.col("id3").eqNullSafe(F.col("id2")) & (F.col("mark3") == F.col("mark2")), "left")
    both = packed(docs).join(plan, same_row("id3", "mark3"), "left").select("id", "mark", "packed", "wanted", F.coalesce("open", F.lit(False)).alias("open"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = unpacked(batch.column(2))
            rows = [(None,) * 4 if open_ else result(data[offsets[i] : offsets[i + 1]].tobytes(), none, none, keep_text) for i, open_ in enumerate(batch.column(4).to_pylist())]
            rest = [pc.if_else(batch.column(4), batch.column(k), pa.scalar(None, batch.column(k).type)) for k in (2, 3)]
            results = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 4, RESULT_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *results, *rest], names=["id", "mark", "n_words", "n_removed", "kept", "kept_sha256", "packed", "wanted"])

    return stored(both.mapInArrow(run, f"id bigint, mark bigint, {RESULT}, packed binary, wanted {PLAN}"))


def suffixes(rows: DataFrame, window: int, step: int) -> DataFrame:
    """(first, last, half, seg, off, n0, n1, ...): the suffix at each window of the wanted segments, as names of ``step`` words. The first
    name has 64 bits and the others 32, so two suffixes are told apart by 64 + 32 * (names - 1) of them."""
    depth = -(-window // step)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(1))
            values, bounds, _, _ = word_symbols(data, offsets)
            for i, (id_, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                x, first = fields(wanted), LAST if id_ is None else id_
                count = x["run"]
                nth = np.repeat(np.arange(len(count)), count)
                off = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = x["start"][nth] + off
                sums = prefix_hashes(values[bounds[i] : bounds[i + 1]])
                names = [hash_between(sums, at + k, at + min(k + step, window)).view(np.int64) for k in range(0, window, step)]
                names = [names[0], *((n >> 32).astype(np.int32) for n in names[1:])]
                columns = [pa.array(np.full(len(at), first)), pa.array(x["last"][nth]), pa.array(x["half"][nth].astype(np.int32)), pa.array(x["seg"][nth]), pa.array(off.astype(np.int32)), *(pa.array(n) for n in names)]
                yield pa.RecordBatch.from_arrays(columns, names=["first", "last", "half", "seg", "off", *(f"n{k}" for k in range(depth))])

    kinds = ", ".join(f"n{k} {'int' if k else 'bigint'}" for k in range(depth))
    rows = rows.where(F.size("wanted") > 0)
    return rows.select("id", "packed", "wanted").mapInArrow(run, f"first bigint, last bigint, half int, seg bigint, off int, {kinds}")


def grouped(rows: DataFrame, depth: int, group_suffixes: int) -> tuple[DataFrame, bool]:
    """The suffixes with ``length``, the names of their prefix, and ``group``: prefixes of more than ``group_suffixes`` become longer.
    And whether any comes to the full depth.

    Prefixes are counted by a few values of their hash first, as many as fits the number of suffixes, and only those of values that are
    large enough by the whole hash. At most one prefix in ``group_suffixes`` suffixes is large, so the tables of large prefixes are
    small against the suffixes. Prefixes of one hash would become longer together, which does no harm.
    """
    deep = False
    cells = F.lit(max(1024, 8 * rows.count() // group_suffixes))
    names, length, under = [F.col(f"n{k}") for k in range(depth)], F.lit(1), rows.select(*[f"n{k}" for k in range(depth)])
    for k in range(1, depth):
        prefix = F.xxhash64(*names[:k])
        full = under.groupBy(F.pmod(prefix, cells).alias("cell")).agg(F.count("*").alias("n")).where(F.col("n") > group_suffixes).select("cell")
        named = under.join(lookup(stored(full)), F.pmod(prefix, cells) == F.col("cell"), "left_semi").groupBy(prefix.alias(f"p{k}")).agg(F.count("*").alias("n"))
        large = stored(named.where(F.col("n") > group_suffixes).select(f"p{k}"))
        if large.isEmpty():
            break
        large = lookup(large)
        last, under = under, stored(under.join(large, prefix == F.col(f"p{k}"), "left_semi"))
        if k > 1:
            discarded(last)
        rows = rows.join(large, prefix == F.col(f"p{k}"), "left")
        length = length + F.col(f"p{k}").isNotNull().cast("int")
        deep = k == depth - 1
    rows = rows.withColumn("length", length)
    return rows.withColumn("group", F.xxhash64("length", *[F.when(F.col("length") > k, n) for k, n in enumerate(names)])), deep or depth == 1


def tree_hits(rows: DataFrame, any_deep: bool, depth: int, tree_suffixes: int) -> DataFrame:
    """(half, seg, off, least) of the leaves that have a larger document than the least one below their node at full depth, of ``grouped``
    suffixes."""
    columns = [f"n{k}" for k in range(depth)]

    def spelled(table: pa.Table) -> np.ndarray:
        return np.stack([table[c].to_numpy().astype(np.int64) for c in columns], axis=1)

    def hits(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if len(table):
            least = SubTree(spelled(table)).least(depth, table["first"].to_numpy())
            found = table.select(["half", "seg", "off"]).append_column("least", pa.array(least))
            yield from found.filter(pa.array(table["last"].to_numpy() > least)).to_batches()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count < tree_suffixes:
                continue
            table = pa.Table.from_batches(held)
            common = SubTree(spelled(table)).depth
            # Cut where the shortest prefix changes; if all suffixes are equal, one of the smallest document goes on alone.
            for length in range(1, depth + 1):
                if len(cuts := np.flatnonzero(common < length)):
                    yield from hits(table.slice(0, int(cuts[-1]) + 1))
                    table = table.slice(int(cuts[-1]) + 1)
                    break
            else:
                yield from hits(table)
                table = table.take(pa.array([int(np.argmin(table["first"].to_numpy()))]))
                table = table.set_column(table.schema.get_field_index("last"), "last", table["first"])
            held, count = table.to_batches(), len(table)
        if held:
            yield from hits(pa.Table.from_batches(held))

    dealt = rows.where(F.col("length") < depth).repartition(tasks(rows.sparkSession), "group").sortWithinPartitions(*columns, "first")
    found = dealt.select(*columns, "first", "last", "half", "seg", "off").mapInArrow(run, LEAF)
    if not any_deep:
        return found
    deep = rows.where(F.col("length") == depth)
    least = deep.groupBy(*(F.col(c).alias(f"{c}_") for c in columns)).agg(F.min("first").alias("least"), F.max("last").alias("most")).where("least < most")
    below = deep.join(least, [F.col(c) == F.col(f"{c}_") for c in columns]).where(F.col("last") > F.col("least"))
    return found.unionByName(below.select("half", "seg", "off", "least"))


def maximal(hits: DataFrame) -> DataFrame:
    """(half, seg, repeats) of leaves: of each segment the maximal repeats (off, n, least), which are neighbouring windows with one smallest
    document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for leaves in batch.column(2):
                x = fields(leaves)
                order_ = np.argsort(x["off"], kind="stable")
                off, least = x["off"][order_], x["least"][order_]
                begins = np.flatnonzero(np.append(True, (off[1:] != off[:-1] + 1) | (least[1:] != least[:-1])))
                ends = np.append(begins[1:], len(off))
                out.append([{"off": int(off[a]), "n": int(z - a), "least": int(least[a])} for a, z in zip(begins, ends, strict=True)])
            kind = pa.list_(pa.struct([("off", pa.int32()), ("n", pa.int32()), ("least", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["half", "seg", "repeats"])

    leaves = hits.groupBy("half", "seg").agg(F.collect_list(F.struct("off", "least")).alias("leaves"))
    return leaves.mapInArrow(run, "half int, seg bigint, repeats array<struct<off:int,n:int,least:bigint>>")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, step: int = STEP,
    group_suffixes: int = GROUP_SUFFIXES, tree_suffixes: int = TREE_SUFFIXES, keep_text: bool = True,
) -> DataFrame:
    """One row per input row: (id_col, n_words, n_removed, kept, kept_sha256); kept words are joined by one space.

    Removed is each word in a window of ``window`` words whose words also start in a document with a smaller id; judged on the input.
    Words are runs of bytes other than U+0020 and U+0009 to U+000D. Null text: no words. Null id: after every other id, as
    2**63 - 1, of which it is one document. Rows that
    repeat an id are one document here, so they remove nothing from each other. Without keep_text, kept is null. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    plan, near = planned(rows, window, gram)
    first = settled(rows, plan, near, window, keep_text)
    open_ = first.where(F.col("packed").isNotNull())
    depth = -(-window // step)
    hits = tree_hits(*grouped(stored(suffixes(open_, window, step)), depth, group_suffixes), depth, tree_suffixes)
    repeats = maximal(hits).select(F.col("half").alias("h2"), F.col("seg").alias("s2"), "repeats")
    placed = near.join(repeats, (half() == F.col("h2")) & (F.col("seg") == F.col("s2")))
    start = start_of(F.col("place"))
    lost = F.filter("repeats", lambda x: order() > x.least)
    windows = F.transform(lost, lambda x: F.struct((start + x.off).alias("at"), x.n.alias("n")))
    placed = placed.select("id", "mark", windows.alias("windows")).where(F.size("windows") > 0)
    placed = placed.groupBy(F.col("id").alias("id2"), F.col("mark").alias("mark2")).agg(F.flatten(F.collect_list("windows")).alias("windows"))
    both = open_.join(placed, same_row("id2", "mark2"), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(1))
            out = []
            for i, windows in enumerate(batch.column(2)):
                x = fields(windows)
                out.append(result(data[offsets[i] : offsets[i + 1]].tobytes(), x["at"], x["at"] + x["n"] + window - 1, keep_text))
            results = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, RESULT_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *results], names=["id", "n_words", "n_removed", "kept", "kept_sha256"])

    last = both.select("id", "packed", "windows").mapInArrow(run, f"id bigint, {RESULT}")
    columns = ["n_words", "n_removed", "kept", "kept_sha256"]
    return first.where(F.col("packed").isNull()).select("id", *columns).unionByName(last).withColumnRenamed("id", id_col)
