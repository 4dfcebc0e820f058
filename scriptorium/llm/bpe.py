"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before the encoder sees them, at white space that follows something else: no match of the split pattern reaches
from a visible character into the white space after it, so the ids are those of the uncut text. Very long runs of white space do not go
through the library's pattern, which fails on them: such a run is one match, but for its last character if something follows, and is
encoded as that. Texts go through Arrow in small batches; the encoder is made once per Python worker.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from scriptorium.llm.common import python_workers

#: Code points after which a text is cut at the next safe place.
PIECE = 20_000
SAFE = re.compile(r"(?<=\S)(?=[ \n])")
#: White space by the Unicode property, which the split pattern goes by, and code points from which a run of it is long.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 10_000
RUN = re.compile(f"(?<![{WHITE}])[{WHITE}]{{{LONG_RUN},}}")


@functools.lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> tuple[tiktoken.Encoding, list[str]]:
    """The encoding of a rank file, without special tokens, and the decimal form of each id."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), [str(i) for i in range(max(ranks.values()) + 1)]


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """Cut a long text where no match of the split pattern can cross."""
    at = 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(coder: tiktoken.Encoding, text: str) -> list[int]:
    ids: list[int] = []
    at = 0
    for run in RUN.finditer(text) if len(text) >= LONG_RUN else ():
        for piece in pieces(text[at : run.start()]):
            ids += coder.encode_ordinary(piece)
        at = run.end() - (run.end() < len(text))
        ids += coder._encode_single_piece(text[run.start() : at].encode())
    for piece in pieces(text[at:]):
        ids += coder.encode_ordinary(piece)
    return ids


def bpe_encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: (id_col, ids array<int>, n_tokens, ids_sha256, decoded_sha256); without keep_ids, ids is null.

    The digests are of the ids in decimal joined by commas, and of the bytes that the ids decode to. Null and empty texts have no ids
    and decode to no bytes. Null and repeated ids: a row each. Other columns are ignored; an empty table gives an empty result.
    """
    python_workers(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names = encoder(rank_file, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = encode_text(coder, text or "")
                digest = hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest()
                rows.append((ids if keep_ids else None, len(ids), digest, hashlib.sha256(coder.decode_bytes(ids)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            types = (pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def bpe_decode(encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, bytes binary): the raw bytes of each row's ids; null ids give null. Bytes need not be whole characters."""
    python_workers(encoded.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = encoder(rank_file, pattern)
        for batch in batches:
            raw = [None if ids is None else coder.decode_bytes(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")
