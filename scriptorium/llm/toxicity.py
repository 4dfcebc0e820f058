"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text.

``zstandard.train_dictionary`` gets a sample of each document of its class: of the text, the word beginnings that mark the class (by how
many documents of each class have them). Trained on the texts as they are, dictionaries fill up with what all texts have in common, and
tell the classes apart far worse (README has the figures). Both dictionaries end in the same common words of ordinary text. A window of
a text that compresses to fewer bytes with the toxic dictionary has what toxic text has. Windows are so short that their literals stay
bytes, and each ends in a tail that both dictionaries hold: without it, most windows would not compress at all and the differences would
drown. From the windows' differences come five figures per text: the largest, how many reach a threshold (log and share), and their sum
by length and by its root. The threshold and a logistic curve over these figures are calibrated on labelled rows that gave nothing to the
dictionaries.

Fitting takes at most ``FIT_ROWS`` labelled rows of at most ``FIT_CHARS`` code points each, those with the least hash of the id, so its
cost does not grow with the corpus. Scoring reads every whole text.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import python_workers

#: Bounds of the sample for fitting, bytes of a window, and the score from which a text is called toxic.
FIT_ROWS, FIT_CHARS, WINDOW, REJECT = 8_000, 20_000, 60, 0.3
#: Lengths in bytes of word beginnings, least documents of one that marks a class, scores from which it does (fitting picks one), and common
#: words of a dictionary. The shortest beginning is as long as the shortest match. A trained dictionary has ``ROOM`` bytes, and ``ROOMS`` more
#: for each byte of its marks; the trainer needs ``SAMPLES`` documents.
BEGINNINGS, LEAST_DOCS, LEVELS, COMMON = (6, 7, 8, 10, 12), 4, (6.0, 5.0, 4.5, 4.0, 3.7), 1_500
ROOM, ROOMS, SAMPLES = 512, 2, 8
#: What every window ends in; both dictionaries end in it too.
TAIL = b"<0123456789abcdef>"


@dataclass(frozen=True)
class Model:
    """Dictionaries, the threshold of a window's difference, and the logistic curve over standardised figures."""

    toxic: bytes
    ordinary: bytes
    threshold: int
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def plain(text: str | None) -> bytes:
    """Lower case, with single spaces between words and at both ends."""
    return f" {' '.join((text or '').lower().split())} ".encode()


@functools.lru_cache(maxsize=8)
def compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=15, chain_log=14, search_log=4, min_match=6, target_length=8, strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    words = zstandard.ZstdCompressionDict(content + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


def windows(text: bytes, size: int = WINDOW) -> Iterator[bytes]:
    """The text in pieces of at most ``size`` bytes, cut at spaces where it can be; neighbours share the space."""
    at = 0
    while True:
        end = text.rfind(b" ", at + 1, at + size) + 1
        if end <= at + 1 or at + size >= len(text):
            end = min(len(text), at + size)
        yield text[at:end]
        if end >= len(text):
            return
        at = end - (text[end - 1] == 0x20 and end - at > 1)


def differences(text: bytes, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Of each window of the text, the bytes by which the toxic dictionary compresses it better."""
    one, other = compressor(toxic).compress, compressor(ordinary).compress
    return np.array([len(other(w)) - len(one(w)) for w in (w + TAIL for w in windows(text))])


def figures(gains: np.ndarray, threshold: int) -> tuple[float, ...]:
    reached, total = int((gains >= threshold).sum()), float(np.clip(gains, 0, None).sum())
    return float(gains.max()), np.log1p(reached), reached / len(gains), total / len(gains), total / len(gains) ** 0.5


def marks(own: list[bytes], others: list[bytes]) -> list[list[bytes]]:
    """For each of ``LEVELS``, all word beginnings that are in so far more of our documents than of the others, best first."""

    def beginnings(text: bytes) -> set[bytes]:
        words = {b" " + w + b" " for w in text.split()}
        return {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}

    # Most beginnings are in a document or two: counts by hash tell which are worth a place of their own.
    rough = np.zeros(1 << 20, np.int32)
    for text in own:
        np.add.at(rough, [crc32(x) & 0xFFFFF for x in beginnings(text)], 1)
    ours, theirs = Counter(), Counter()
    for text in own:
        ours.update(x for x in beginnings(text) if rough[crc32(x) & 0xFFFFF] >= LEAST_DOCS)
    for text in others:
        theirs.update(x for x in beginnings(text) if ours.get(x, 0) >= LEAST_DOCS)
    n, m = max(1, len(own)), max(1, len(others))

    def z(x: bytes) -> float:
        rate = (ours[x] + theirs[x]) / (n + m)
        return (ours[x] / n - theirs[x] / m) / np.sqrt(rate * (1 - rate) * (1 / n + 1 / m) + 1e-12)

    scored = {x: z(x) for x, k in ours.items() if k >= LEAST_DOCS}
    best: list[bytes] = []
    for x in sorted((x for x, s in scored.items() if s > min(LEVELS)), key=lambda x: (-scored[x], -len(x), x)):
        if not any(x in y or y in x for y in best):
            best.append(x)
    return [[x for x in best if scored[x] > level] for level in LEVELS]


def trained(own: list[bytes], texts: list[bytes]) -> bytes:
    """Content of a dictionary trained on what the texts have of the marks, after those that the trainer has left out; the marks alone if
    there is too little to train on."""
    samples = [b"\0".join(found) for found in ([x for x in own if x in t] for t in texts) if found]
    if len(samples) >= SAMPLES:
        try:
            content = zstandard.train_dictionary(ROOM + ROOMS * sum(map(len, own)), samples).as_bytes()
            return b"\0".join([*(x for x in own[::-1] if x not in content), content])
        except zstandard.ZstdError:  # the trainer finds nothing that repeats often enough
            pass
    return b"\0".join(own[::-1])


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> list[tuple[bytes, bytes]]:
    """A pair for each of ``LEVELS``, equal ones once. The content that is nearest to a text in a dictionary is cheapest to refer to: common
    words stand last in both, and the trainer puts what occurs most often last."""
    common = b"".join(b" " + w for w, _ in sorted(Counter(w for t in ordinary for w in t.split()).items(), key=lambda x: (-x[1], x[0]))[:COMMON][::-1])
    pairs = zip(marks(toxic, ordinary), marks(ordinary, toxic), strict=True)
    return list(dict.fromkeys((b"\0".join([trained(own, toxic), common]), b"\0".join([trained(other, ordinary), common])) for own, other in pairs))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights, the bias last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return w


def fit(rows: Iterable[tuple[int | None, str | None, int]]) -> Model | float:
    """Model of (id, text, label) rows; without rows of both classes, the share of label 1 (0.0 of no rows) as every text's score."""
    rows = sorted(((plain(t), int(y)) for _, t, y in rows), key=lambda r: (r[0][::-1], r[1]))
    # Every third row, in an order that has to do with the text alone, is for the curve.
    build, tune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    if len({y for _, y in build}) < 2 or len({y for _, y in tune}) < 2:
        return float(np.mean([y for _, y in rows])) if rows else 0.0
    labels, best = np.array([y for _, y in tune], float), None
    for toxic, ordinary in train_dictionaries([t for t, y in build if y], [t for t, y in build if not y]):
        gains = [differences(t, toxic, ordinary) for t, _ in tune]
        for threshold in range(1, 9):
            x = np.array([figures(g, threshold) for g in gains])
            centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
            w = logistic((x - centre) / scale, labels)
            p = np.clip(1 / (1 + np.exp(-np.clip((x - centre) / scale @ w[:-1] + w[-1], -30, 30))), 1e-9, 1 - 1e-9)
            loss = -float(np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)))
            if best is None or loss < best[0] - 1e-9:
                best = loss, Model(toxic, ordinary, threshold, tuple(centre), tuple(scale), tuple(w[:-1]), float(w[-1]))
    return best[1]


def score_text(model: Model | float, text: str | None) -> float:
    if isinstance(model, float):
        return model
    x = figures(differences(plain(text), model.toxic, model.ordinary), model.threshold)
    z = sum((v - c) / s * w for v, c, s, w in zip(x, model.centre, model.scale, model.weights, strict=True)) + model.bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: str):
    """Rows that fitting never sees: crc32 of the id as text leaves 2 modulo 4. Null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model | float:
    """Model of a bounded sample of the labelled rows that are not held out: at most ``fit_rows``, repeated ids included. Null labels and
    ids and longer texts are left out; without any row, or with one class only, the model is a number, every text's score."""
    sample = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    sample = sample.where(~held_out("id")).orderBy(F.xxhash64("id"), "id", "label").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= FIT_CHARS)
    # The sample's size is bounded by fit_rows, so it may go to every executor; ids that repeat must not make it larger.
    rows = texts.join(F.broadcast(sample), "id").orderBy(F.xxhash64("id"), "id", "label", F.xxhash64("text")).limit(fit_rows)
    return fit((r.id, r.text, r.label) for r in rows.collect())


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """One row per input row: (id_col, held_out, score, predicted); predicted is 1 from ``reject`` on.

    Null texts are scored as empty ones: an empty text is one window without any difference. Null and repeated ids: a row each. Other
    columns are ignored; an empty table gives an empty result.
    """
    python_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_text(model, t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=[id_col, "held_out", "score"])

    kind = dict(docs.dtypes)[id_col]
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= reject).cast("int"))


def keep_clean(docs: DataFrame, model: Model | float, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score below ``reject``; a null text is scored as an empty one."""
    python_workers(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score_text(model, t) < reject for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
