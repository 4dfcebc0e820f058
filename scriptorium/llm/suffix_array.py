"""Suffix-array dedup of bytes by a run-length index.

1. Segments (see anchors) say which stretches of the corpus share an anchor with another stretch. Equal segments collapse to one
   with a count: every window of a segment that occurs twice is repeated.
2. The other stretches whose anchor has more than one text go to the index, one text of each. Texts of an anchor stay together, and
   whole anchors fill a block of about a quarter of ``BLOCK_BYTES``, or one of them a block of at most that.
3. Of each block a run-compressed Burrows-Wheeler transform is built, with the suffix positions sampled at the ends of its runs. Only
   there is a common prefix with the suffix next in order ever measured; inside a run it is one less than that of the position before,
   so one stream over the text gives the matching statistic of every position: the longest string there that also starts elsewhere.
   Repetitive texts have few runs.
4. Places within a match of ``WINDOW`` bytes or more are marked, and the marked bytes of each document removed.

An anchor with more text than a block holds (a passage in very many contexts) is cut by content: its segments are cut anew by a longer
anchor, which takes in more of the context. Equal windows have equal anchors of any length, so none is lost, and each group goes to an
index. Windows whose longer anchor is still that of more text than a block holds, most of the window being the same in thousands of
contexts, meet by their own hash.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.anchors import byte_values, covered, fields, find_segments, hash_between, keyed, octets, packed, prefix_hashes, run_of, runs_of, same_row, segments, start_of, strong_between, strong_sums, unpacked
from scriptorium.llm.common import discarded, lookup, stored, tasks

#: Bytes of a match that is removed, bytes of an anchor's string, most bytes of one index.
WINDOW, GRAM, BLOCK_BYTES = 400, 160, 1 << 21


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only groups of suffixes that are still equal are sorted again. The last symbol is unique."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    rank = np.empty(n, np.int32)

    def groups(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each of some sorted keys (the first place of its group, so finished ranks never change); whether it is not alone."""
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        return np.maximum.accumulate(np.where(new[:-1], place, 0)), ~(new[:-1] & new[1:])

    rank[order], tied = groups(symbols[order], np.arange(n, dtype=np.int32))
    open_ = np.flatnonzero(tied).astype(np.int32)  # places in order whose suffix is not alone
    depth = 1
    while len(open_):
        at = order[open_]
        key = rank[at] * np.int64(n + 1)
        key += np.where(at < n - depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        by = np.argsort(key)
        at = at[by]
        order[open_] = at
        rank[at], tied = groups(key[by], open_)
        open_ = open_[tied]
        depth *= 2
    return order


def common_prefix(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, by binary search on hashes.

    The search goes by the first of the two hashes, which never takes equal strings for different ones. What it finds has to agree by both;
    where it does not, the search is done again by both.
    """
    n = len(sums[0]) - 1

    def search(between: Callable[..., np.ndarray], of: np.ndarray | tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int32), np.minimum(most, n - np.maximum(a, b)).astype(np.int32)
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = between(of, a, a + mid) == between(of, b, b + mid)
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    found = search(hash_between, sums[0], a, b)
    wrong = np.flatnonzero(strong_between(sums, a, a + found) != strong_between(sums, b, b + found))
    if len(wrong):
        found[wrong] = search(strong_between, sums, a[wrong], b[wrong])
    return found


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with suffix positions sampled at both ends of each run."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        self.starts = np.cumsum([0, *(len(x) + 1 for x in texts)])
        n = int(self.starts[-1])
        symbols, values = np.empty(n, np.int32), np.empty(n, np.uint64)
        table = byte_values()
        for i, (x, at) in enumerate(zip(texts, self.starts, strict=False)):
            symbols[at : at + len(x)] = x.astype(np.int32) + len(texts)
            values[at : at + len(x)] = table[x]
            symbols[at + len(x)] = i  # each text's end is a symbol of its own, so no match goes over it
            values[at + len(x)] = np.uint64(2 * i + 2)
        order = suffix_order(symbols)
        last = symbols[order - 1]
        edge = np.flatnonzero(last[1:] != last[:-1])  # place of each run's last suffix, but for the final run
        self.heads = np.append(order[:1], order[edge + 1])  # suffix at the first place of each run ...
        self.before = np.append(order[-1:], order[edge])  # ... and the one before it in order
        self.ends, self.after = np.append(order[edge], order[-1:]), np.append(order[edge + 1], order[:1])
        self.runs = len(edge) + 1
        self.size = n
        self._sums = strong_sums(values)
        self._longest = int(max((len(x) for x in texts), default=0))

    def _stream(self, at: np.ndarray, other: np.ndarray, whole: bool) -> np.ndarray:
        """Common prefix of every position with its neighbour in order: measured at sampled positions, one less from there on."""
        length = common_prefix(self._sums, at, other, self._longest + 1)
        length[-1 if not whole else 0] = 0  # the first and the last suffix in order have no neighbour on one side
        by = np.argsort(at)
        at, length = at[by], length[by]
        places = np.arange(self.size, dtype=np.int32)
        latest = np.searchsorted(at, places, "right") - 1
        return np.where(latest >= 0, np.maximum(length[latest] - (places - at[latest]), 0), 0)

    def matching_statistics(self) -> np.ndarray:
        """Of each position, the length of the longest string there that also starts at another position."""
        return np.maximum(self._stream(self.heads, self.before, True), self._stream(self.ends, self.after, False))


def repeated_windows(texts: list[np.ndarray], window: int) -> list[np.ndarray]:
    """Of each text, whether the ``window`` bytes from each place on also start elsewhere in these texts."""
    index = RunLengthIndex(texts)
    stats = index.matching_statistics() >= window
    return [stats[a : a + len(x)] for a, x in zip(index.starts, texts, strict=False)]


#: What is known of a row after its own segments: the result, or else the text and what to cut from it.
PLAN = "array<struct<anchor:bigint,start:int,run:int,n:bigint,bytes:bigint>>"
RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
RESULT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())


def result(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep_text: bool) -> tuple:
    gone = covered(starts, ends, len(text))
    kept = text[~gone].tobytes()
    return len(text), int(gone.sum()), len(runs_of(gone)[0]), kept if keep_text else None, hashlib.sha256(kept).hexdigest()


def planned(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(id, mark, copied, wanted) of the ``keyed`` rows with anything to do: stretches that are repeated for certain, segments to index."""
    found = stored(find_segments(docs, octets, window, gram))
    # Only anchors that occur again matter; that leaves a fraction of the segments.
    again = found.groupBy(F.col("anchor").alias("anchor_")).agg(F.count("*").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high"), F.max("twice").alias("twice_"))
    again = again.where("n > 1 OR twice_").select("anchor_", (F.col("twice_") | (F.col("low") != F.col("high"))).alias("several"))
    near = stored(found.join(again, F.col("anchor") == F.col("anchor_")).select("anchor", "seg", "id", "mark", "place", "several"))
    discarded(found)
    segs = near.groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.max("several").alias("several"), F.min(F.struct("id", "mark", "place")).alias("at"))

    # All windows of a segment that occurs more than once are repeated.
    copies = segs.where("n > 1").select(F.col("anchor").alias("a2"), F.col("seg").alias("s2"))
    copied = near.join(copies, (F.col("anchor") == F.col("a2")) & (F.col("seg") == F.col("s2")), "left_semi")
    start, run = start_of(F.col("place")), run_of(F.col("place"))
    copied = copied.select("id", "mark", F.struct(F.lit(None).cast("bigint").alias("anchor"), start.alias("start"), run.alias("run"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("bytes")).alias("x"))

    # One text of each other segment goes to the index, with the size of all that share its anchor.
    several = segs.where("several").withColumn("start", start_of(F.col("at.place"))).withColumn("run", run_of(F.col("at.place")))
    sizes = several.groupBy(F.col("anchor").alias("a3")).agg(F.sum(F.col("run") + window).alias("bytes"))
    wanted = several.join(sizes, F.col("anchor") == F.col("a3")).select("at.id", "at.mark", F.struct("anchor", "start", "run", "n", "bytes").alias("x"))
    return copied.unionByName(wanted).groupBy("id", "mark").agg(
        F.collect_list(F.when(F.col("x.anchor").isNull(), F.struct("x.start", "x.run"))).alias("copied"),
        F.collect_list(F.when(F.col("x.anchor").isNotNull(), F.col("x"))).alias("wanted"),
    )


def settled(docs: DataFrame, plan: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Every ``keyed`` row, with its result if nothing of it goes to the index, else with its packed text, stretches and segments."""
    plan = plan.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "copied", "wanted")
    both = packed(docs).join(plan, same_row("id2", "mark2"), "left").select("id", "mark", "packed", "copied", "wanted")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(2))
            rows = []
            for i, (copied, wanted) in enumerate(zip(batch.column(3), batch.column(4), strict=True)):
                if wanted.is_valid and len(wanted):
                    rows.append((None,) * 5)
                else:
                    x = fields(copied)
                    rows.append(result(data[offsets[i] : offsets[i + 1]], x["start"], x["start"] + x["run"] + window - 1, keep_text))
            done = pa.array([r[0] is not None for r in rows], pa.bool_())
            rest = [pc.if_else(done, pa.scalar(None, batch.column(k).type), batch.column(k)) for k in (2, 3, 4)]
            results = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, RESULT_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *results, *rest], names=["id", "mark", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "packed", "copied", "wanted"])

    return stored(both.mapInArrow(run, f"id bigint, mark bigint, {RESULT}, packed binary, copied array<struct<start:int,run:int>>, wanted {PLAN}"))


def cut(rows: DataFrame, window: int) -> DataFrame:
    """(anchor, id, mark, start, run, n, bytes, piece) of each wanted segment, piece being its text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(2))
            for i, wanted in enumerate(batch.column(3)):
                x = fields(wanted)
                pieces = [data[offsets[i] + a : offsets[i] + a + n + window - 1].tobytes() for a, n in zip(x["start"].tolist(), x["run"].tolist(), strict=True)]
                same = [pa.array([batch.column(k)[i].as_py()] * len(pieces), pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x["anchor"]), *same, pa.array(x["start"], pa.int32()), pa.array(x["run"], pa.int32()), pa.array(x["n"]), pa.array(pieces, pa.binary())], names=["anchor", "id", "mark", "start", "run", "n", "piece"])

    return rows.select("id", "mark", "packed", "wanted").mapInArrow(run, PIECES)


PIECES = "anchor bigint, id bigint, mark bigint, start int, run int, n bigint, piece binary"


def finer(pieces: DataFrame, window: int, gram: int) -> DataFrame:
    """Pieces cut anew where their windows' anchors of ``gram`` bytes change; each window is in one of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, mark, start, n, piece in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5, 6)), strict=True):
                data = np.frombuffer(piece, np.uint8)
                for _, anchor, _, at, count, _ in segments(data, np.array([0, len(data)]), window, gram):
                    many = len(anchor)
                    texts = [piece[a : a + c + window - 1] for a, c in zip(at.tolist(), count.tolist(), strict=True)]
                    same = [pa.array([x] * many, pa.int64()) for x in (id_, mark)]
                    columns = [pa.array(anchor.view(np.int64)), *same, pa.array((start + at).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array([n] * many, pa.int64()), pa.array(texts, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "mark", "start", "run", "n", "piece"])

    return pieces.mapInArrow(run, PIECES)


def cut_finer(pieces: DataFrame, window: int, gram: int, block_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Pieces of large anchors by anchors that are longer by three quarters of the way to a window: those whose anchors fit into a block, and
    those whose anchors do not, if there are any."""
    cut_ = stored(finer(pieces, window, (gram + 3 * window) // 4))
    large = cut_.groupBy(F.col("anchor").alias("a2")).agg(F.sum(F.length("piece")).alias("bytes")).where(F.col("bytes") > block_bytes).select("a2")
    large = stored(large)
    if large.isEmpty():
        return cut_, None
    large = lookup(large)
    return cut_.join(large, F.col("anchor") == F.col("a2"), "left_anti"), cut_.join(large, F.col("anchor") == F.col("a2"), "left_semi")


def indexed_spans(rows: DataFrame, window: int, gram: int, block_bytes: int) -> DataFrame:
    """(id, mark, start, end): of the segments that occur once, the stretches covered by windows that also start elsewhere."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            ids, marks, starts, ends = [], [], [], []
            if held:
                for (_, id_, mark, start, run, n, _), hit in zip(held, repeated_windows([x[-1] for x in held], window), strict=True):
                    if n == 1:  # of those that occur again, all is marked anyway
                        for a, z in zip(*runs_of(hit[:run]), strict=True):
                            ids.append(id_), marks.append(mark), starts.append(start + int(a)), ends.append(start + int(z) + window - 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["id", "mark", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if row[0] != last and size + len(row[-1]) > block_bytes // 4:
                    yield from flush()
                    held, size = [], 0
                last = row[0]
                held.append((*row[:-1], np.frombuffer(row[-1], np.uint8)))
                size += len(row[-1]) + 1
        yield from flush()

    def single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, id_, mark, start, run, n, piece in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                sums, at = prefix_hashes(byte_values()[np.frombuffer(piece, np.uint8)]), np.arange(run)
                key = hash_between(sums, at, at + window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([id_] * run, pa.int64()), pa.array([mark] * run, pa.int64()), pa.array((start + at).astype(np.int32)), pa.array([n] * run, pa.int64())], names=["window", "id", "mark", "start", "n"])

    part = lambda hot: rows.withColumn("wanted", F.filter("wanted", lambda w: (w.bytes > block_bytes) if hot else (w.bytes <= block_bytes))).where(F.size("wanted") > 0)
    pieces, rest = [cut(part(False), window)], None
    if not part(True).isEmpty():
        more, rest = cut_finer(cut(part(True), window), window, gram, block_bytes)
        pieces.append(more)
    dealt = functools.reduce(DataFrame.unionByName, pieces).repartition(tasks(rows.sparkSession), "anchor").sortWithinPartitions("anchor")
    spans = dealt.mapInArrow(index, "id bigint, mark bigint, start int, end int")
    if rest is None:
        return spans
    windows = stored(rest.mapInArrow(single, "window bigint, id bigint, mark bigint, start int, n bigint"))
    again = windows.groupBy(F.col("window").alias("w2")).agg(F.sum("n").alias("times")).where("times > 1").select("w2")
    return spans.unionByName(windows.where("n = 1").join(again, F.col("window") == F.col("w2"), "left_semi").select("id", "mark", "start", (F.col("start") + window).alias("end")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """One row per input row: (id_col, n_bytes, n_removed, n_spans, kept binary, kept_sha256); without keep_text, kept is null.

    Removed is each byte of the UTF-8 text that lies in a string of ``window`` bytes which also starts at another place, of this row or
    of any other; judged on the input. Null text: as empty. Null and repeated ids: rows of their own; repeated rows are copies of each
    other. Kept bytes need not be whole characters. Other columns are ignored; an empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    first = settled(rows, planned(rows, window, gram), window, keep_text)
    open_ = first.where(F.col("packed").isNotNull())
    spans = indexed_spans(open_, window, gram, block_bytes).groupBy(F.col("id").alias("id2"), F.col("mark").alias("mark2")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = open_.join(spans, same_row("id2", "mark2"), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(1))
            out = []
            for i, (copied, spans) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = fields(copied), fields(spans)
                starts, ends = np.concatenate([x["start"], y["start"]]), np.concatenate([x["start"] + x["run"] + window - 1, y["end"]])
                out.append(result(data[offsets[i] : offsets[i + 1]], starts, ends, keep_text))
            results = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, RESULT_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *results], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    last = both.select("id", "packed", "copied", "spans").mapInArrow(run, f"id bigint, {RESULT}")
    columns = ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
    return first.where(F.col("packed").isNull()).select("id", *columns).unionByName(last).withColumnRenamed("id", id_col)
