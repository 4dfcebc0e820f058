"""Which parts of a corpus can hold a repeated window at all, found without moving texts.

A window is ``window`` consecutive symbols (words or bytes) of one document. Its anchor is the least hash of the ``gram``-symbol strings
in it, so equal windows have equal anchors wherever they stand. Neighbouring windows mostly share their anchor: such a run of windows is
a segment, and one row per segment goes to the shuffle. Segments of equal text collapse before anything else is done with them, so a
group of copies counts as one however large it is.

Hashes are polynomials modulo 2**64 over random 64-bit symbol values. Strings of over a thousand symbols can be made whose polynomials
agree modulo 2**64 in any base (Thue-Morse), so wherever longer stretches are told apart by a hash, it is put together with a polynomial
modulo a prime, where they do not. Texts count as equal if anchor, length and hash agree.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import python_workers, whole_ids

#: Most symbols hashed at once, and most windows of one segment (a longer run is cut; that is allowed anywhere).
CHUNK, MAX_RUN = 1 << 19, 4096
PRIME, PRIME_BASE = (1 << 31) - 1, 1_103_515_245
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


@functools.cache
def byte_values() -> np.ndarray:
    """A random 64-bit value of each byte."""
    return np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    both = []
    for x in (_BASE, inverse):
        out = np.full(n + 1, x, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


@functools.cache
def prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the prime's base and of its inverse modulo the prime."""
    both = []
    for x in (PRIME_BASE, pow(PRIME_BASE, -1, PRIME)):
        out = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:
            to = min(done, n + 1 - done)
            out[done : done + to] = out[:to] * np.uint64(pow(x, done, PRIME)) % np.uint64(PRIME)
            done += to
        both.append(out)
    return both[0], both[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = the hash of symbols[i:j], times base**i."""
    up, _ = powers(1 << max(10, int(len(symbols)).bit_length()))
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def hash_between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(1 << max(10, int(len(sums) - 1).bit_length()))
    return mixed((sums[end] - sums[start]) * down[start])


def strong_sums(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of ``prefix_hashes``, and those modulo the prime, which are not reduced: 2**33 of them fit into 64 bits."""
    up, _ = prime_powers(1 << max(10, int(len(symbols)).bit_length()))
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols >> np.uint64(33)) * up[: len(symbols)] % np.uint64(PRIME), out=out[1:])
    return prefix_hashes(symbols), out


def strong_between(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of 64 bits that rests on both polynomials."""
    _, down = prime_powers(1 << max(10, int(len(sums[1]) - 1).bit_length()))
    by_prime = (sums[1][end] - sums[1][start]) % np.uint64(PRIME) * down[start] % np.uint64(PRIME)
    return mixed(hash_between(sums[0], start, end) ^ by_prime * _MIX[0])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after another: (hash of each word, word offsets of each text, byte start and end of each word).

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D, in one text.
    """
    inside = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    values = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # words of some CHUNK bytes at a time
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        sums = prefix_hashes(byte_values()[data[starts[at] : ends[to - 1]]])
        values[at:to] = hash_between(sums, starts[at:to] - starts[at], ends[at:to] - starts[at])
        at = to
    return values | np.uint64(1), np.searchsorted(starts, offsets), starts, ends


def segments(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, anchor, hash, start, windows, twice) of each segment; twice: the anchor occurs again, so windows may repeat inside."""
    lengths = np.diff(offsets)
    begin = 0
    while begin < len(lengths):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK, "right")) - 1)
        if lengths[begin] > CHUNK:  # one long text, in pieces that overlap by a window less one
            for at in range(0, max(1, int(lengths[begin]) - window + 1), CHUNK - window):
                piece = symbols[offsets[begin] + at : min(offsets[begin] + at + CHUNK - 1, offsets[begin + 1])]
                for out in _chunk(piece, np.array([0, len(piece)]), window, gram):
                    yield (out[0] + begin, out[1], out[2], out[3] + at, *out[4:])
            end = begin + 1
        else:
            for out in _chunk(symbols[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin], window, gram):
                yield (out[0] + begin, *out[1:])
        begin = end


def _chunk(symbols: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    symbols = byte_values()[symbols] if symbols.dtype == np.uint8 else symbols
    starts, ends = offsets[:-1], offsets[1:]
    texts = np.flatnonzero(ends - starts >= window)
    if not len(texts):
        return
    sums = strong_sums(symbols)
    places = np.arange(len(symbols) - gram + 1)
    grams = hash_between(sums[0], places, places + gram)
    least = sliding_min(grams, window - gram + 1)
    n = len(least)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = least[1:] != least[:-1]
    cut[starts[texts]] = True
    cut[ends[texts] - window + 1] = True  # after the last window of a text
    edges = np.flatnonzero(cut)
    head, run = edges[:-1], np.diff(edges)
    text = np.searchsorted(starts, head, "right") - 1
    own = head + window <= ends[text]
    head, run, text = head[own], run[own], text[own]
    if len(run) and run.max() > MAX_RUN:
        parts = -(-run // MAX_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        head, run, text = np.repeat(head, parts) + nth * MAX_RUN, np.minimum(np.repeat(run, parts) - nth * MAX_RUN, MAX_RUN), np.repeat(text, parts)
    seen = np.zeros(n + 1, np.int64)
    np.cumsum(grams[:n] == least, out=seen[1:])
    twice = seen[head + run - 1] > seen[head]
    yield text, least[head], strong_between(sums, head, head + run + window - 1) ^ mixed(run.astype(np.uint64)), head - starts[text], run, twice


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array, without a copy of the bytes; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_symbols(data, offsets)[:2]


def octets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): rows are known by id and a hash of their text, so that repeated and null ids do no harm."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return whole_ids(docs, id_col).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def find_segments(docs: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """(anchor, seg, id, mark, place, twice), one row per segment of the ``keyed`` rows; see ``start_of`` and ``run_of`` for place."""
    python_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = symbols(*raw(batch.column(2)))
            for text, anchor, seg, start, count, twice in segments(values, offsets, window, gram):
                ids, marks = batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text))
                columns = [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), ids, marks, pa.array(start * (2 * MAX_RUN) + count), pa.array(twice)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "id", "mark", "place", "twice"])

    return docs.mapInArrow(run, "anchor bigint, seg bigint, id bigint, mark bigint, place bigint, twice boolean")


def start_of(place: Column) -> Column:
    """First symbol of a segment."""
    return F.floor(place / (2 * MAX_RUN)).cast("int")


def run_of(place: Column) -> Column:
    """Number of windows of a segment."""
    return F.pmod(place, F.lit(2 * MAX_RUN)).cast("int")


def packed(docs: DataFrame) -> DataFrame:
    """(id, mark, packed) of ``keyed`` rows: each text as a zstandard frame, for the way to other executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, offsets = raw(batch.column(2))
            frames = [pack(data[a:z]) for a, z in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(frames, pa.binary())], names=["id", "mark", "packed"])

    return docs.mapInArrow(run, "id bigint, mark bigint, packed binary")


def unpacked(frames: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of packed texts, one after another."""
    unpack = zstandard.ZstdDecompressor().decompress
    texts = [unpack(x.as_buffer()) for x in frames]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def same_row(id_: str, mark: str) -> Column:
    """Join condition on the (id, mark) of a ``keyed`` row."""
    return F.col("id").eqNullSafe(F.col(id_)) & (F.col("mark") == F.col(mark))


def covered(starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Boolean mask of the places below ``length`` that some [start, end) covers."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(ends, length), -1)
    return np.cumsum(edge[:-1]) > 0


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def fields(structs: pa.ListScalar) -> dict[str, np.ndarray]:
    """The fields of an array of structs of numbers, none of them null; no entries if the array is null."""
    if not structs.is_valid:
        return defaultdict(lambda: np.zeros(0, np.int64))
    return {f.name: structs.values.field(i).to_numpy().astype(np.int64) for i, f in enumerate(structs.values.type)}
