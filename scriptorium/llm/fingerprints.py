"""Document fingerprints by consistent weighted sampling.

A term is a word; its weight is the number of times it occurs, times its length in bytes, so that the frequent short words weigh little.
Each of ``SAMPLES`` samples draws, for each term, two gamma variates and a uniform one that depend on the term and the sample alone, and
keeps the term and level of the least draw. Two documents keep the same with the probability of their generalised Jaccard similarity
(sum of least weights over sum of greatest), so the share of equal samples estimates it; its standard error is below
0.5 / sqrt(SAMPLES). A term is the 64-bit hash of its word. Its variates are put together from rows of tables of ``ROWS`` rows, picked by
three parts of the hash: a gamma(2, 1) variate as the sum of two exponential ones, the uniform one as the sum of two modulo 1. So two of
``ROWS`` ** 3 terms have no draw in common, however many words there are, and the tables stay small.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.anchors import mixed, raw, word_symbols
from scriptorium.llm.common import python_workers, tasks, whole_ids

SAMPLES, ROWS, SEED = 128, 1 << 14, 7


@functools.lru_cache(maxsize=1)
def draws(samples: int) -> tuple[np.ndarray, ...]:
    """Tables of exponential variates (two), of uniform ones (two), and of the log of gamma(2, 1) variates; a column per sample."""
    rng = np.random.default_rng(SEED)
    shape = (ROWS, samples)
    return (
        rng.standard_exponential(shape, np.float32) + np.float32(1e-6), rng.standard_exponential(shape, np.float32),
        rng.random(shape, np.float32), rng.random(shape, np.float32), np.log(rng.standard_gamma(2.0, shape, np.float32) + np.float32(1e-12)),
    )


def sample(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The 16-bit mark of each sample of one weighted set of 64-bit terms; all marks of the empty set are 0."""
    if not len(terms):
        return np.zeros(samples, np.uint16)
    least, mark = np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64)
    every, part_of = np.arange(samples), np.uint64(ROWS - 1)
    r1, r2, b1, b2, c = draws(samples)
    for at in range(0, len(terms), 1024):
        part = terms[at : at + 1024]
        i, j, k = ((part >> np.uint64(shift) & part_of).astype(np.int64) for shift in (0, 14, 28))
        r = r1[i] + r2[j]
        b = b1[i] + b2[j]
        b -= b >= 1
        level = np.floor(np.log(weights[at : at + 1024]).astype(np.float32)[:, None] / r + b)
        score = c[k] - r * (level - b + np.float32(1))
        best = score.argmin(axis=0)
        own = score[best, every]
        better = own < least
        least[better] = own[better]
        mark[better] = (part[best] * np.uint64(0x9E3779B97F4A7C15) + level[best, every].astype(np.int64).astype(np.uint64))[better]
    return (mixed(mark) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def signatures(texts: list[str]) -> np.ndarray:
    """One row of marks per text."""
    data, offsets = raw(pa.array(texts, pa.string()))
    if not len(data):
        return np.zeros((len(texts), SAMPLES), np.uint16)
    values, bounds, starts, ends = word_symbols(data, offsets)
    terms, lengths = mixed(values), (ends - starts).astype(np.float64)
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    for i, (a, z) in enumerate(zip(bounds, bounds[1:], strict=False)):
        if z > a:
            own, place = np.unique(terms[a:z], return_inverse=True)
            out[i] = sample(own, np.bincount(place, lengths[a:z]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(marks: np.ndarray) -> str:
    return marks.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, fingerprint), 4 hex digits a sample. Null text: as empty, whose fingerprint is all zeros.

    Equal texts have equal fingerprints. Ids are of any type; null and repeated ones are rows like others. Other columns are ignored; an
    empty table gives an empty result.
    """
    python_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = signatures([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([as_text(m) for m in marks], pa.string())], names=[id_col, "fingerprint"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, last, id, text): every row in the part of its id range, and in each part, marked as last, the row that follows the part.

    Parts are sorted inside their partition by id (null ids last), then text. Only the bounds of the parts go to the driver. The texts
    are shuffled once.
    """
    rows = whole_ids(docs, id_col).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low = rows.agg(F.min("id")).first()[0]
    parts = 4 * tasks(docs.sparkSession)
    bounds = sorted({int(x) for x in rows.select("id").where("id IS NOT NULL").approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)} - {low}) if low is not None else []
    part = F.lit(0)
    if bounds:
        # The number of bounds not above the id, by binary search in a constant array.
        table = F.array(*[F.lit(x) for x in bounds])
        steps = len(bounds).bit_length()
        part = F.aggregate(
            F.array(*[F.lit(1 << k) for k in reversed(range(steps))]), F.lit(0),
            lambda at, step: F.when((at + step <= len(bounds)) & (F.coalesce(F.get(table, at + step - 1), F.lit(0)) <= F.col("id")), at + step).otherwise(at),
        )
        part = F.when(F.col("id").isNull(), F.lit(len(bounds))).otherwise(part)
    rows = rows.withColumn("part", part).withColumn("last", F.lit(False))
    # The first row of each part: its least id, then the least text of the few rows that have it.
    least = rows.groupBy("part").agg(F.min("id").alias("low")).select(F.col("part").alias("p2"), "low")
    firsts = rows.join(F.broadcast(least), (F.col("part") == F.col("p2")) & F.col("id").eqNullSafe(F.col("low"))).groupBy("part", "id").agg(F.min("text").alias("text"))
    before = F.pmod(F.col("part") - 1, F.lit(len(bounds) + 1))
    rows = rows.unionByName(firsts.select("id", "text", before.alias("part"), F.lit(True).alias("last")))
    return rows.repartition(tasks(docs.sparkSession), "part").sortWithinPartitions("part", "last", F.col("id").asc_nulls_last(), "text").select("part", "last", "id", "text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last quarter (floor of a quarter of the code points) replaced by as many code points from the start of the
    next row's text, or all of it; the row after the last is the first. Rows that repeat an id are ordered by text. Null text: as empty.
    Null ids come last; ordered by their texts, they are all in one task, row by row. Other columns are ignored; an empty table gives an empty
    result; the only row of a table is its own next.
    """
    python_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the latest row: its next one is not known yet
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            own = signatures([r[3] for r in rows])
            rows = [(*r, s) for r, s in zip(rows, own, strict=True)]
            rows = [held, *rows] if held else rows
            both = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[1] and a[0] == b[0]]
            texts = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in both]
            edited = signatures(texts)
            out = [
                (a[2], len(a[3]), hashlib.sha256(t.encode()).hexdigest(), as_text(a[4]), as_text(e), likeness(a[4], e), likeness(a[4], b[4]))
                for (a, b), t, e in zip(both, texts, edited, strict=True)
            ]
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            held = rows[-1] if rows else held

    return in_order(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
