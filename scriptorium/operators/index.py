"""A positional index over a two-level corpus: scenes (documents) in plays (groups of documents).

Scenes are in slices of 2**``SLICE_BITS``. A block is what one slice has of one term: the scenes' places in the corpus (rising), with the
occurrences, length, play, id and positions of each, and beside these their number, least and greatest place, and bounds of occurrences and
lengths. Blocks of different terms meet if they are of one slice, so an intersection is a join on slices, and whatever has no partner or
cannot score high enough is left out before its contents are read; a term that every scene has is as many blocks as there are slices.

An index is a folder of segments, each written once: ``build`` writes the first, ``append`` one more for new scenes, ``merge`` puts all into
one. Blocks are in folders by a hash of the term and one of the slice, their numbers taken from the size of the corpus, and sorted by term
inside. Files are written with Parquet's delta encodings, so places and positions cost their gaps, and without what the rest of a block
tells (``thinned``; ``filled`` has it again). A small table lists the live segments; its last version counts, so a search never sees half of
a segment.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.scratch import FEW, deleted, lookup, new_path, shipped, stored

LEVELS = ("scene", "play")
#: Scenes of a slice, as a power of two; tokens of a folder of blocks, and scenes whose blocks are together in the folders of a term.
SLICE_BITS, FOLDER_TOKENS, SPAN_SCENES = 7, 2 << 20, 1 << 16
#: Tokens with which a slice ends before it has all its scenes, but for one scene that has more.
SLICE_TOKENS = 1 << 21
#: Postings that are packed at once, and blocks of an Arrow batch.
PACK_POSTINGS, ROWS = 1 << 21, 4096
#: What is beside a block's contents, and these: arrays with an entry per scene, in step.
BESIDE = ("segment", "bucket", "span", "slice", "term", "n", "lo", "hi", "least_tf", "most_tf", "least_len", "most_len")
#: No block is of the empty term. Folders are only pruned by a table with a filter.
SOME = "term <> ''"
BLOCK = ("segment", "bucket", "span", "slice", "term")
CONTENTS = {"ords": "bigint", "tfs": "bigint", "lens": "bigint", "plays": "string", "ids": "string", "positions": "array<int>"}
MADE = (
    "slice bigint, term string, n bigint, lo bigint, hi bigint, least_tf bigint, most_tf bigint, least_len bigint, most_len bigint, "
    + ", ".join(f"{c} array<{t}>" for c, t in CONTENTS.items())
)
POSTING = ["term", "slice", "ord", "len", "play", "id", "positions"]
COUNTS = "term string, unit_id string, tf bigint, first_ord bigint"
PACKED = "bucket int, span int, postings binary, scenes binary"
BLOCKS = f"{MADE}, segment string, bucket int, span int"
#: A scene, as packs have it once; Parquet's encodings of a pack's two tables.
SCENE = ["slice", "ord", "len", "play", "id"]
ENCODED = {"scene.list.element": "DELTA_BINARY_PACKED", "positions.list.element.list.element": "DELTA_BINARY_PACKED", "term": "DELTA_BYTE_ARRAY"}
ENCODED_SCENE = {c: "DELTA_BYTE_ARRAY" if c in ("play", "id") else "DELTA_BINARY_PACKED" for c in SCENE}
LENGTHS = "play_id string, scene_id string, doc_ord bigint, len bigint"
SCENES = "play_id string, scene_id string, doc_ord bigint, len bigint, segment string"
LIVE = "segment string, buckets int, spans int, version int"
DELTA = {"parquet.writer.version": "v2", "compression": "zstd"}


def unit(level: str) -> str:
    """Name of the column that holds the units of a level."""
    if level not in LEVELS:
        raise ValueError(f"level {level!r} is neither of {LEVELS}")
    return f"{level}_id"


def split_words(texts):
    """Arrow lists of the words of texts, as ``ws_tokens`` has them (null: none): Arrow's white space is Python's. Splitting here takes a seventh of
    the CPU seconds that an expression does, and tokens need not go to the Python workers."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    words, lens = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, "")  # white space at either end leaves an empty word there
    ends = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum(lens)]]
    kind = pa.ListArray if words.type == pa.string() else pa.LargeListArray
    return kind.from_arrays(pa.array(ends.astype(np.int32 if kind is pa.ListArray else np.int64)), words.filter(real))


def lengths(batches):
    """From Arrow batches of (play_id, scene_id, doc_ord, text) to (play_id, scene_id, doc_ord, len)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lens = split_words(batch.column("text")).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lens)], names=["play_id", "scene_id", "doc_ord", "len"])


def tokenized(batches):
    """From Arrow batches of (play, id, ord, text) to (play, id, ord, tokens)."""
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], split_words(batch.column("text"))], names=["play", "id", "ord", "tokens"])


def counts(batches):
    """From Arrow batches of (unit_id, ord, text) to (term, unit_id, tf, first_ord), a row for each word and unit of a batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    last = np.iinfo(np.int64).max
    for batch in batches:
        tokens = split_words(batch.column("text"))
        words, lens = tokens.flatten().dictionary_encode(), tokens.value_lengths().to_numpy(zero_copy_only=False)
        if len(words):
            units = pc.dictionary_encode(batch.column("unit_id"), null_encoding="encode")
            ords = np.repeat(pc.fill_null(batch.column("ord"), last).to_numpy(), lens)
            key = np.repeat(units.indices.to_numpy().astype(np.int64), lens) * len(words.dictionary) + words.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            unit, term = np.divmod(key[first], len(words.dictionary))
            least = np.minimum.reduceat(ords[order], first)
            columns = [words.dictionary.take(pa.array(term)), units.dictionary.take(pa.array(unit)), pa.array(np.diff(np.r_[first, len(key)])), pa.array(least, mask=least == last)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COUNTS.split(", ")])


def counted(corpus: DataFrame, level: str) -> DataFrame:
    """(term, unit_id, tf, first_ord) of all words of a corpus: what ``unit_tf`` of its index has, without the index. Words are counted where
    their texts are, and what is shuffled are numbers of words and units; no places, blocks or files are made."""
    shipped(corpus.sparkSession)
    rows = corpus.select(F.col(unit(level)).alias("unit_id"), F.col("doc_ord").alias("ord"), "text").mapInArrow(counts, COUNTS)
    return rows.groupBy("term", "unit_id").agg(F.sum("tf").alias("tf"), F.min("first_ord").alias("first_ord"))


def folder_of(term: Column, folders: Column) -> Column:
    """The number of a term's folder, as ``packed`` has it."""
    return F.pmod(F.crc32(term), folders).cast("int")


@dataclass(frozen=True)
class Index:
    """The live segments of an index: (segment, buckets, spans) of each, blocks (columns BESIDE and CONTENTS), and scenes (play_id, scene_id,
    doc_ord, len)."""

    path: str
    segments: tuple[tuple[str, int, int], ...]
    blocks: DataFrame
    scenes: DataFrame

    def placed(self, table: DataFrame) -> DataFrame:
        """A table with a column ``term``, and with the ``segment`` and ``bucket`` in which each segment has the term's blocks; stored, and
        broadcast if it is small, so that no block of another term is shuffled."""
        live = F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(b).alias("buckets")) for s, b, _ in self.segments])
        own = stored(table.select("*", F.inline(live)).withColumn("bucket", folder_of(F.col("term"), F.col("buckets"))).drop("buckets"))
        return lookup(own.where(SOME))

    def of_terms(self, terms: DataFrame | None) -> DataFrame:
        """Blocks, of some terms only if a table (term) is given: folders without any of them are not read, nor are columns not asked for."""
        return self.blocks if terms is None else self.blocks.join(self.placed(terms.select("term").distinct()), ["segment", "bucket", "term"], "left_semi")

    def of_blocks(self, chosen: DataFrame, *contents: Column | str, most: int = FEW) -> DataFrame:
        """Contents of the blocks that a ``stored`` table (segment, bucket, span, slice, term, ...) names, and its other columns. Where they are
        too many to be broadcast, blocks of other terms are left out before any is shuffled."""
        own = self.blocks.select(*BLOCK, *contents)
        if chosen.count() <= most:
            return own.join(F.broadcast(chosen.where(SOME)), list(BLOCK))
        terms = lookup(stored(chosen.select("segment", "bucket", "term").distinct()).where(SOME))
        return own.join(terms, ["segment", "bucket", "term"], "left_semi").join(chosen, list(BLOCK))

    def entries(self, blocks: DataFrame, *contents: str) -> DataFrame:
        """(term, ord, one column per content without its s) of blocks: a row per scene that has the term."""
        columns = ["ords", *contents]
        return blocks.select("term", F.inline(F.arrays_zip(*columns))).toDF("term", *[c.removesuffix("s") for c in columns])

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, play_id, scene_id, doc_ord, positions), positions from 0."""
        rows = self.entries(self.of_terms(terms), "plays", "ids", "positions")
        return rows.toDF("term", "doc_ord", "play_id", "scene_id", "positions").select("term", "play_id", "scene_id", "doc_ord", "positions")

    def unit_tf(self, level: str, terms: DataFrame | None = None) -> DataFrame:
        """(term, unit_id, tf, first_ord): occurrences in each unit, and where in the corpus the first one is."""
        if unit(level) == "play_id":
            return self.entries(self.of_terms(terms), "tfs", "plays").groupBy("term", F.col("play").alias("unit_id")).agg(F.sum("tf").alias("tf"), F.min("ord").alias("first_ord"))
        rows = self.entries(self.of_terms(terms), "tfs", "ids")
        return rows.select("term", F.col("id").alias("unit_id"), "tf", F.col("ord").alias("first_ord"))

    def unit_len(self, level: str) -> DataFrame:
        """(unit_id, len); units without tokens have length 0."""
        rows = self.scenes.select(F.col(unit(level)).alias("unit_id"), "len")
        return rows if level == "scene" else rows.groupBy("unit_id").agg(F.sum("len").alias("len"))

    def df(self, level: str, terms: DataFrame | None = None) -> DataFrame:
        """(term, n): units that have the term; of scenes, from what is beside the blocks."""
        if unit(level) == "scene_id":
            return self.of_terms(terms).groupBy("term").agg(F.sum("n").alias("n"))
        return self.unit_tf(level, terms).groupBy("term").agg(F.count("*").alias("n"))

    def cf(self, terms: DataFrame | None = None) -> DataFrame:
        """(term, cf): occurrences in the collection."""
        own = F.aggregate("tfs", F.lit(0).cast("bigint"), lambda a, x: a + x)
        return self.of_terms(terms).groupBy("term").agg(F.sum(own).alias("cf"))

    def stats(self, level: str) -> DataFrame:
        """One row (level, n_units, total_terms, avdl)."""
        return self.unit_len(level).agg(F.lit(level).alias("level"), F.count("*").alias("n_units"), F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("total_terms"), F.avg("len").alias("avdl"))


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at ``path``, as its last version has it."""
    live = spark.read.schema(LIVE).parquet(f"{path}/live")
    rows = live.collect()  # a row per segment and version
    version = max(r.version for r in rows)
    segments = tuple(sorted((r.segment, r.buckets, r.spans) for r in rows if r.version == version))
    read = lambda kind, schema: spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/segment={s}" for s, *_ in segments])
    return Index(path, segments, filled(read("blocks", BLOCKS)), read("scenes", SCENES))


def _made_live(spark: SparkSession, path: str, segments: list[tuple[str, int, int]], version: int) -> Index:
    spark.createDataFrame(segments, "segment string, buckets int, spans int").coalesce(1).write.parquet(f"{path}/live/version={version}")
    return open_index(spark, path)


def _last_version(spark: SparkSession, path: str) -> int:
    return spark.read.schema(LIVE).parquet(f"{path}/live").agg(F.max("version")).first()[0]


def scenes_of(postings):
    """The different scenes (SCENE) of a table of postings, in the order of their places, and the number of each posting's."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    number = np.zeros(len(postings), np.int64)
    for c in SCENE:
        own = pc.dictionary_encode(postings[c].combine_chunks(), null_encoding="encode")
        number = pc.dictionary_encode(pa.array(number * len(own.dictionary) + own.indices.to_numpy())).indices.to_numpy().astype(np.int64)
    first = np.unique(number, return_index=True)[1]
    scenes = postings.select(SCENE).take(pa.array(first)).combine_chunks()
    order = np.lexsort((scenes["ord"].to_numpy(), scenes["slice"].to_numpy()))
    return scenes.take(pa.array(order)), np.argsort(order)[number]


def filed(table, encodings: dict[str, str]) -> bytes:
    """A table as a Parquet file in memory."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = pa.BufferOutputStream()
    pq.write_table(table, out, compression="zstd", use_dictionary=False, column_encoding=encodings, write_statistics=False, store_schema=False)
    return out.getvalue().to_pybytes()


def packed(postings, buckets: int, spans: int):
    """An Arrow batch (PACKED) of a table of postings (POSTING): those of each folder by their terms as one small Parquet file, and the scenes
    that they are in as another, so that what belongs to a scene is not repeated by each of its words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    postings = postings.combine_chunks()
    terms = postings["term"].combine_chunks()
    by_name = pc.sort_indices(terms.dictionary)
    code, names = np.argsort(by_name.to_numpy())[terms.indices.to_numpy(zero_copy_only=False)], terms.dictionary.take(by_name)
    scenes, scene = scenes_of(postings)
    own = np.array([zlib.crc32(t.encode()) % buckets for t in names.to_pylist()], np.int64)[code]
    numbers, at = np.unique(scenes["slice"].to_numpy(), return_inverse=True)
    folder = own * spans + np.array([zlib.crc32(str(n).encode()) % spans for n in numbers], np.int64)[at][scene]
    order = np.lexsort((scene, code, folder))
    folder, code, scene, positions = folder[order], code[order], scene[order], postings["positions"].combine_chunks().take(pa.array(order))
    first, files = np.flatnonzero(np.r_[True, folder[1:] != folder[:-1]]), []
    for a, b in zip(first, np.r_[first[1:], len(folder)], strict=True):
        starts = np.flatnonzero(np.r_[True, code[a + 1 : b] != code[a : b - 1]])
        ends = pa.array(np.r_[starts, b - a].astype(np.int32))
        used, places = np.unique(scene[a:b], return_inverse=True)
        columns = [names.take(pa.array(code[a:b][starts])), pa.ListArray.from_arrays(ends, pa.array(places.astype(np.int32))), pa.ListArray.from_arrays(ends, positions.slice(a, b - a))]
        files.append((filed(pa.Table.from_arrays(columns, names=["term", "scene", "positions"]), ENCODED), filed(scenes.take(pa.array(used)), ENCODED_SCENE)))
    columns = [pa.array((folder[first] // spans).astype(np.int32)), pa.array((folder[first] % spans).astype(np.int32)), *(pa.array(f, pa.binary()) for f in zip(*files, strict=True))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])


def read_pack(postings, scenes):
    """The table of postings (POSTING) that ``packed`` made two files of."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    terms, scenes = (pq.ParquetFile(pa.BufferReader(f.as_buffer())).read(use_threads=False).combine_chunks() for f in (postings, scenes))
    numbers, positions = terms["scene"].combine_chunks(), terms["positions"].combine_chunks().flatten()
    at = np.repeat(np.arange(len(terms), dtype=np.int32), numbers.value_lengths().to_numpy(zero_copy_only=False))
    named = pa.DictionaryArray.from_arrays(pa.array(at), terms["term"].combine_chunks())
    return pa.Table.from_arrays([named, *scenes.take(numbers.flatten()).columns, positions], names=POSTING)


def packs(tables, buckets: int, spans: int, most: int = PACK_POSTINGS):
    """Packed postings of tables, ``most`` or somewhat more at once."""
    import pyarrow as pa

    kept, n = [], 0
    for table in itertools.chain(tables, [None]):
        if table is not None:
            kept.append(table)
            n += table.num_rows
        if kept and (table is None or n >= most):
            yield packed(pa.concat_tables(kept).unify_dictionaries(), buckets, spans)
            kept, n = [], 0


def sliced(slice_bits: int, buckets: int, spans: int, slice_tokens: int = SLICE_TOKENS, terms: list[str] | None = None):
    """From Arrow batches of (play, id, ord, tokens) to packed postings: as many rows as a slice has, or as have so many tokens, are one slice.
    With ``terms``, postings are of these only, and slices, places and lengths as they are with all."""

    def tables(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, rest, whole = TaskContext.get().partitionId() << 33, None, 1 << slice_bits
        for batch in itertools.chain(batches, [None]):
            rows = [t for t in (rest, batch and pa.Table.from_batches([batch])) if t is not None]
            rows = pa.concat_tables(rows).combine_chunks() if rows else None
            at, n = 0, rows.num_rows if rows else 0
            lens = rows["tokens"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
            while at < n and (batch is None or at + whole <= n or int(lens[at:].sum()) > slice_tokens):
                size = max(1, int(np.searchsorted(np.cumsum(lens[at : at + whole]), slice_tokens, "right")))
                if (made := slice_postings(rows.slice(at, size), lens[at : at + size], number, terms)) is not None:
                    yield made
                number, at = number + 1, at + size
            rest = rows.slice(at) if at < n else None

    return lambda batches: packs(tables(batches), buckets, spans)


def slice_postings(rows, lens, number: int, terms: list[str] | None = None):
    """The postings of one slice, a row for each scene that has the term; None if there are none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = lambda c: rows[c].combine_chunks()
    words = column("tokens").flatten()
    scene, place = np.repeat(np.arange(len(lens)), lens), np.arange(len(words)) - np.repeat(np.cumsum(lens) - lens, lens)
    if terms is not None:
        own = np.flatnonzero(pc.is_in(words, value_set=pa.array(terms, words.type)).to_numpy(zero_copy_only=False))
        words, scene, place = words.take(pa.array(own)), scene[own], place[own]
    if not len(words):
        return None
    words = words.dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    at = np.argsort(code, kind="stable")
    code, scene, place = code[at], scene[at], place[at]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (scene[1:] != scene[:-1])])
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(code)].astype(np.int32)), pa.array(place.astype(np.int32)))
    scene, terms = scene[first], pa.DictionaryArray.from_arrays(pa.array(code[first]), words.dictionary)
    play, id_ = (column(c).take(pa.array(scene)) for c in ("play", "id"))
    columns = [terms, pa.array(np.full(len(scene), number)), pa.array(column("ord").to_numpy(zero_copy_only=False)[scene]), pa.array(lens[scene]), play, id_, positions]
    return pa.Table.from_arrays(columns, names=POSTING)


def recut(lows: list[int], buckets: int, spans: int):
    """From Arrow batches of (term, ords, lens, plays, ids, positions) of blocks to packed postings, in slices that begin at the places ``lows``."""

    def tables(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                terms, lengths = batch.column("term").dictionary_encode(), batch.column("ords").value_lengths().to_numpy(zero_copy_only=False)
                terms = pa.DictionaryArray.from_arrays(pa.array(np.repeat(terms.indices.to_numpy(zero_copy_only=False), lengths)), terms.dictionary)
                ords, *rest = (batch.column(c).flatten() for c in ("ords", "lens", "plays", "ids", "positions"))
                slices = np.searchsorted(np.array(lows), ords.to_numpy(zero_copy_only=False), "right") - 1
                yield pa.Table.from_arrays([terms, pa.array(slices), ords, *rest], names=POSTING)

    return lambda batches: packs(tables(batches), buckets, spans)


def unpacked(batches):
    """From packed postings, those of a folder after each other, to blocks in the order of terms and slices."""
    import pyarrow as pa

    rows = (row for batch in batches for row in zip(*(batch.column(c.split()[0]) for c in PACKED.split(", ")), strict=True))
    for (bucket, span), own in itertools.groupby(rows, key=lambda r: (r[0].as_py(), r[1].as_py())):
        postings = pa.concat_tables([read_pack(*files) for _, _, *files in own]).unify_dictionaries().combine_chunks()
        made = grouped(postings, bucket, span)
        for at in range(0, made.num_rows, ROWS):
            yield made.slice(at, ROWS)


def grouped(postings, bucket: int, span: int):
    """An Arrow batch of the blocks of a folder."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    terms = postings["term"].combine_chunks()
    rank = np.argsort(pc.sort_indices(terms.dictionary).to_numpy(zero_copy_only=False))
    code, slices, ords, lens = rank[terms.indices.to_numpy(zero_copy_only=False)], *(postings[c].to_numpy() for c in ("slice", "ord", "len"))
    order = np.lexsort((ords, slices, code))
    code, slices, ords, lens = code[order], slices[order], ords[order], lens[order]
    plays, ids, positions = (postings[c].combine_chunks().take(pa.array(order)) for c in ("play", "id", "positions"))
    tfs = positions.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (slices[1:] != slices[:-1])])
    ends = np.r_[first, len(code)]
    bounds = [f.reduceat(x, first) for x in (ords, tfs, lens) for f in (np.minimum, np.maximum)]
    contents = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x) for x in (pa.array(ords), pa.array(tfs), pa.array(lens), plays, ids, positions)]
    folder = [pa.array(np.full(len(first), x, np.int32)) for x in (bucket, span)]
    columns = [pa.array(slices[first]), terms.dictionary.take(pc.sort_indices(terms.dictionary)).take(pa.array(code[first])), pa.array(np.diff(ends)), *map(pa.array, bounds), *contents, *folder]
    return pa.RecordBatch.from_arrays(columns, names=[*(c.split()[0] for c in MADE.split(", ")), "bucket", "span"])


def thinned(batches):
    """Blocks (MADE, bucket, span) as files have them, half as large: greatest values are what they are more than the least, and so are places
    but for the first, which has no entry, and occurrences and lengths, which have entries only if they differ. A difference of places that
    is no 64-bit number is not taken: the complement of the greatest place, below zero, tells. Ids have entries only if they are not the digits of their places."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns, strict=True))
        n, lo, hi = (columns[c].to_numpy() for c in ("n", "lo", "hi"))
        starts = np.cumsum(n) - n

        def entries(values, own, bounds=np.r_[starts, n.sum()]):
            """Lists of those entries that stay."""
            ends = np.r_[0, np.cumsum(own)][bounds].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), values.filter(pa.array(own)))

        wide, later = hi - lo < 0, np.ones(n.sum(), bool)
        later[starts] = False
        ords, ids = columns["ords"].flatten(), columns["ids"].flatten()
        columns["ords"] = entries(pa.array(ords.to_numpy() - np.repeat(np.where(wide, 0, lo), n)), later)
        columns["hi"] = pa.array(np.where(wide, ~hi, hi - lo))
        other = ~pc.fill_null(pc.equal(ids, ords.cast(ids.type)), False).to_numpy(zero_copy_only=False)
        columns["ids"] = entries(ids, np.repeat(np.logical_or.reduceat(other, starts) if len(n) else n > 0, n))
        for name, kind in (("tfs", "tf"), ("lens", "len")):
            least, most = (columns[f"{which}_{kind}"].to_numpy() for which in ("least", "most"))
            columns[name] = entries(pa.array(columns[name].flatten().to_numpy() - np.repeat(least, n)), np.repeat(most > least, n))
            columns[f"most_{kind}"] = pa.array(most - least)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=batch.schema.names)


def filled(files: DataFrame) -> DataFrame:
    """Blocks again of files with ``thinned`` ones; of a column only what it is made of is read."""
    plus = lambda name, least: F.transform(name, lambda x: x + F.col(least))
    wide = F.col("hi") < 0
    ords = F.when(F.col("n") == 1, F.array("lo")).otherwise(F.concat(F.array("lo"), F.when(wide, F.col("ords")).otherwise(plus("ords", "lo"))))
    made = {"ords": ords, "hi": F.when(wide, F.bitwise_not("hi")).otherwise(F.col("lo") + F.col("hi"))}
    for name, kind in (("tfs", "tf"), ("lens", "len")):
        least, most = f"least_{kind}", f"most_{kind}"
        same = F.array_repeat(F.col(least), F.col("n").cast("int"))
        made |= {name: F.when(F.col(most) == 0, same).otherwise(plus(name, least)), most: F.col(least) + F.col(most)}
    made["ids"] = F.when(F.size("ids") == 0, ords.cast("array<string>")).otherwise(F.col("ids"))
    return files.select(*[made[c].alias(c) if c in made else c for c in files.columns])


def _write(scenes: DataFrame, pack: Callable[[int, int], DataFrame], path: str, segment: str, folder_tokens: int, span_scenes: int) -> tuple[str, int, int]:
    """Write a segment from scenes (play_id, scene_id, doc_ord, len) and the packed postings that ``pack`` gives for numbers of buckets and spans.

    One shuffle brings postings to their folders, where blocks are made of them; what a task has at once is one folder's.
    """
    spark, folder = scenes.sparkSession, f"{path}/scenes/segment={segment}"
    scenes.write.options(**DELTA).parquet(folder)
    n, tokens = spark.read.schema(scenes.schema).parquet(folder).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = max(1, -(-n // span_scenes))
    buckets = max(1, -(-max(least, -(-tokens // folder_tokens)) // spans))
    rows = pack(buckets, spans).repartitionById(buckets * spans, F.col("bucket") * spans + F.col("span")).sortWithinPartitions("bucket", "span")
    blocks = rows.mapInArrow(lambda batches: thinned(unpacked(batches)), f"{MADE}, bucket int, span int").sortWithinPartitions("bucket", "span", "term", "slice")
    blocks.write.options(**DELTA).partitionBy("bucket", "span").parquet(f"{path}/blocks/segment={segment}")
    return segment, buckets, spans


def _segment(corpus: DataFrame, path: str, slice_bits: int, folder_tokens: int, span_scenes: int, terms: list[str] | None = None) -> tuple[str, int, int]:
    """Write a segment of a corpus. A slice is one task's, so its postings are packed before they are shuffled; a task's scenes are sorted by
    their places, so that they are in the same slices if it runs again. Texts are sorted and go to the Python workers, tokens do not."""
    segment = uuid.uuid4().hex[:12]
    shipped(corpus.sparkSession)
    rows = corpus.select("play_id", "scene_id", "doc_ord", "text")
    own = rows.sortWithinPartitions("doc_ord").toDF("play", "id", "ord", "text")
    made = lambda buckets, spans: own.mapInArrow(lambda batches: sliced(slice_bits, buckets, spans, terms=terms)(tokenized(batches)), PACKED)
    return _write(rows.mapInArrow(lengths, LENGTHS), made, path, segment, folder_tokens, span_scenes)


def build(
    corpus: DataFrame, path: str | None = None, slice_bits: int = SLICE_BITS, folder_tokens: int = FOLDER_TOKENS, span_scenes: int = SPAN_SCENES, terms: list[str] | None = None
) -> Index:
    """The index of a corpus (play_id, scene_id, scene_num, doc_ord, text), written at ``path`` (else in the checkpoint folder).

    Scene ids and places (doc_ord) are unique. Scenes without tokens stay, with length 0. With ``terms``, blocks are made of these words only,
    for searches whose words are known before; scenes, lengths and totals are those of the whole corpus, so these searches find the same.
    """
    path = path or new_path(corpus.sparkSession)
    return _made_live(corpus.sparkSession, path, [_segment(corpus, path, slice_bits, folder_tokens, span_scenes, terms)], 0)


def append(index: Index, corpus: DataFrame, slice_bits: int = SLICE_BITS, folder_tokens: int = FOLDER_TOKENS, span_scenes: int = SPAN_SCENES) -> Index:
    """The index with the scenes of a corpus in one more segment; nothing that is there is read or written again. The scenes are new ones."""
    spark = corpus.sparkSession
    made = _segment(corpus, index.path, slice_bits, folder_tokens, span_scenes)
    return _made_live(spark, index.path, [*index.segments, made], _last_version(spark, index.path) + 1)


def merge(index: Index, slice_bits: int = SLICE_BITS, folder_tokens: int = FOLDER_TOKENS, span_scenes: int = SPAN_SCENES) -> Index:
    """The index with all segments in one, scenes numbered anew by their places; files of the old ones go once the new version stands."""
    spark, segment = index.blocks.sparkSession, uuid.uuid4().hex[:12]
    shipped(spark)
    placed = index.scenes.drop("segment").repartitionByRange("doc_ord").sortWithinPartitions("doc_ord")
    slices = placed.select("doc_ord", F.shiftright(F.monotonically_increasing_id(), slice_bits).alias("slice")).groupBy("slice").agg(F.min("doc_ord").alias("low"))
    lows = sorted(r.low for r in slices.collect())  # a number per slice
    old = index.blocks.select("term", "ords", "lens", "plays", "ids", "positions")
    made = _write(index.scenes.drop("segment"), lambda buckets, spans: old.mapInArrow(recut(lows, buckets, spans), PACKED), index.path, segment, folder_tokens, span_scenes)
    merged = _made_live(spark, index.path, [made], _last_version(spark, index.path) + 1)
    deleted(spark, *[f"{index.path}/{kind}/segment={s}/x" for kind in ("blocks", "scenes") for s, *_ in index.segments])
    return merged
