"""Line dedup by a deletion-neighbourhood join (built-in functions only).

Lines are compared in lower case with white space runs as one space. A line goes if an earlier line (by document id, then line number)
is equal to it or, for lines of ``LEAST_CHARS`` (a parameter) code points and more, one edit away: one code point replaced, inserted or deleted.

Equal lines collapse first. Two lines that are one edit apart give an equal string once the edited code point is deleted, so all
deletions of a line are emitted as hashed keys and equal keys meet. To delete anywhere in every line would be too much, so the place is
narrowed down first, without loss:

1. One edit leaves the first or the last near-half of a line as it was: lines that share neither half with another line leave.
2. Of the rest, each stretch of ``PIECE`` code points is taken out in turn: only where what is left of the line equals what is left of
   another one can the edit lie in that stretch.
3. Of those stretches all deletions of one code point are emitted. A key holds the surroundings, the place and what is left, so lines
   that meet replaced the same code point; an insertion meets the stretch of the line without it. At most one line per letter of the
   alphabet and place can meet in a key, whatever the corpus.

Every match is verified by its edit distance before it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import fresh_names, stored, whole_ids

#: Least code points of a line that may differ by an edit, and code points of a stretch.
LEAST_CHARS, PIECE = 20, 32


def normal(line: Column) -> Column:
    # Most lines have single spaces only, which is quickly seen.
    even = F.when(line.contains("  ") | line.rlike(r"[\x09-\x0D]"), F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)
    return F.lower(F.trim(even))


def line_key(norm: Column) -> list[Column]:
    """128 bits by which equal lines meet."""
    return [F.xxhash64(norm).alias("h1"), F.xxhash64(F.lit(1), norm).alias("h2")]


def half(n: Column) -> Column:
    """A near-half of n, cut to three leading bits so that neighbouring lengths mostly share it."""
    grain = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(n, F.lit(2)) / 2)) - 2, F.lit(0)))
    return (F.floor(F.floor(n / 2) / grain) * grain).cast("int")


def half_keys(least_chars: int) -> list[Column]:
    """Keys of the first and the last near-half of ``norm``, whose sizes are ``p`` and, for the length less one, ``q``; null for short lines.

    They are columns of numbers, so that the aggregate over lines needs no sort of arrays.
    """
    part = lambda side, size: F.left(F.col("norm"), size) if side == 0 else F.right(F.col("norm"), size)
    return [F.when(F.col("n") >= least_chars, F.xxhash64(F.lit(side), F.col(c), part(side, F.col(c)))).alias(f"half{side}{c}") for c in "pq" for side in (0, 1)]


HALVES = ("half0p", "half1p", "half0q", "half1q")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, no, line, norm) of the lines that are not blank; mark is a hash of the text."""
    rows = whole_ids(docs, id_col).where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    # A filter on norm would be evaluated apart from it, below, and cost as much again.
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("norm", normal(F.col("line")))


def place() -> Column:
    """Order of lines: by id (null last), line number, then hash of the text."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "no", "mark")


def near_lines(docs: DataFrame, distinct: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2) of the different lines that are one edit away from a line which occurs earlier."""
    keys = distinct.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), F.col("no").alias("no2"), F.explode(F.array_distinct(F.array(*HALVES))).alias("key")).where("key IS NOT NULL")
    shared = keys.groupBy(F.col("key").alias("key_")).agg(F.count("*").alias("n")).where("n > 1").select("key_")
    some = keys.join(shared, F.col("key") == F.col("key_"), "left_semi").groupBy("id2", "mark2").agg(F.collect_set("no2").alias("nos"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    own = texts.join(some, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")))
    own = own.select("id", "mark", "nos", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.array_contains("nos", F.col("no")))
    own = own.withColumn("norm", normal(F.col("line"))).select(*line_key(F.col("norm")), place().alias("first"), "norm")
    lines = stored(own.dropDuplicates(["h1", "h2"]).withColumn("n", F.char_length("norm")))
    me = F.struct("first", "h1", "h2").alias("me")

    # Stretches, for lines of s code points and for those of one more (role 1), whose stretch then holds the code point too many.
    norm, n = F.col("norm"), F.col("n")
    stretch = lambda s, role: F.transform(
        F.sequence(F.lit(0), F.ceil(s / PIECE).cast("int") - 1),
        lambda j: F.struct(
            F.lit(role).alias("role"),
            F.xxhash64(s, j, F.left(norm, j * PIECE), F.substr(norm, F.least((j + 1) * PIECE, s) + 1 + role, n)).alias("around"),
            F.substr(norm, j * PIECE + 1, F.least((j + 1) * PIECE, s) - j * PIECE + role).alias("piece"),
        ),
    )
    pieces = lines.select(me, F.explode(F.concat(stretch(n, 0), stretch(n - 1, 1))).alias("p")).select("me", "p.*")
    shared = pieces.groupBy(F.col("around").alias("around_")).agg(F.count("*").alias("m"), F.max("role").alias("most"), F.min("role").alias("least")).where("m > 1 AND least = 0").select("around_")
    pieces = pieces.join(shared, F.col("around") == F.col("around_"), "left_semi")

    # All deletions: kind 0 keeps its place (replacements meet), kind 1 is the whole stretch, kind 2 a longer one less one code point.
    piece, around = F.col("piece"), F.col("around")
    without = lambda i: F.concat(F.left(piece, i), F.substr(piece, i + 2, F.length(piece)))
    key = lambda kind, at, rest: F.struct(F.lit(kind).alias("kind"), F.xxhash64(around, at, rest).alias("key"))
    spots = F.sequence(F.lit(0), F.char_length(piece) - 1)
    shorter = F.concat(F.array(key(1, F.lit(-1), piece)), F.transform(spots, lambda i: key(0, i, without(i))))
    longer = F.transform(spots, lambda i: key(2, F.lit(-1), without(i)))
    variants = pieces.select("me", F.explode(F.when(F.col("role") == 0, shorter).otherwise(longer)).alias("v")).select("me", "v.*")
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("me"))).over(Window.partitionBy("key"))
    met = variants.select("me", F.when(F.col("kind") == 0, of(0)).when(F.col("kind") == 1, of(2)).otherwise(of(1)).alias("other")).where("other < me").distinct()

    one = lines.select(F.col("h1").alias("m1"), F.col("h2").alias("m2"), F.col("norm").alias("mine"))
    two = lines.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("norm").alias("theirs"))
    both = met.join(one, (F.col("me.h1") == F.col("m1")) & (F.col("me.h2") == F.col("m2"))).join(two, (F.col("other.h1") == F.col("o1")) & (F.col("other.h2") == F.col("o2")))
    return both.where(F.levenshtein("mine", "theirs", 1).between(0, 1)).select(F.col("m1").alias("h1"), F.col("m2").alias("h2")).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, mark, gone): of each row that loses lines, the numbers (from 0) of those that go; mark is the text's hash."""
    lines = lines_of(docs, id_col, text_col)
    sized = lines.withColumn("n", F.char_length("norm")).withColumns({"p": half(F.col("n")), "q": half(F.col("n") - 1)})
    distinct = sized.select("id", "mark", "no", *line_key(F.col("norm")), *half_keys(least_chars))
    distinct = distinct.groupBy("h1", "h2").agg(F.min(place()).alias("first"), F.count("*").alias("times"), *[F.min(c).alias(c) for c in HALVES])
    distinct = stored(distinct.select("h1", "h2", "first.id", "first.no", "first.mark", "times", *HALVES))
    near = near_lines(docs, distinct, id_col, text_col).withColumn("near", F.lit(True))
    decided = distinct.select("h1", "h2", place().alias("first"), "times").join(near, ["h1", "h2"], "left").where("times > 1 OR near")
    decided = decided.select(F.col("h1").alias("d1"), F.col("h2").alias("d2"), "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("id", "mark", "no", *line_key(F.col("norm"))).join(decided, (F.col("h1") == F.col("d1")) & (F.col("h2") == F.col("d2"))).where(F.col("near") | (place() > F.col("first")))
    return gone.groupBy("id", "mark").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row per input row: (id_col, n_lines, n_removed, removed), removed being the numbers of the lines that go, comma-joined.

    A line goes if it is equal to an earlier one or, from ``least_chars`` code points on, one edit away from it. Blank lines stay. Null
    text: no lines. Null ids come after all others; rows that repeat id and text are the same place, so they keep
    and lose the same lines. Ties cannot occur otherwise: rows that repeat an id are told apart by their text. Other columns are
    ignored; an empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("bigint").alias("n_lines"))
    gone = repeated_lines(docs, id_col, text_col, least_chars).select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "gone")
    both = rows.join(gone, F.col("id").eqNullSafe(F.col("id2")) & (F.col("mark") == F.col("mark2")), "left")
    return both.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce(F.array_join(F.transform("gone", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows and columns of ``docs`` with the text of each row rid of its repeated lines; null stays null, an empty table empty.

    Which lines go is as in ``line_report``; a text all of whose lines go becomes empty.
    """
    id_, mark, numbers, own = fresh_names(docs, 4)
    gone = repeated_lines(docs, id_col, text_col, least_chars).select(F.col("id").alias(id_), F.col("mark").alias(mark), F.col("gone").alias(numbers))
    marked = docs.withColumn(own, F.xxhash64(text_col))
    both = marked.join(gone, F.col(id_col).cast("bigint").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(mark)), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda _, i: ~F.array_contains(numbers, i)), "\n")
    return both.withColumn(text_col, F.when(F.col(numbers).isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
