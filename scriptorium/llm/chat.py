"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, spelled out, and only its reply is trainable.
``expand`` formats each turn once and then makes the prefixes: the row of a reply holds the whole formatted text before it. Turns that are
nobody's reply stay as rows without a prefix. The prefixes of a conversation together grow with the square of its turns; they are made where
they are read, a row at a time, and a long conversation is dealt out to several tasks by the places of its replies.

The template opens a turn with a line ``### role:`` and ends it with a line ``</turn>``. Inside texts and roles a backslash goes before each
backslash and control string, so that no turn can be opened or ended from inside, and comes off again when they are read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import lookup, python_workers, stored

#: What opens a turn and what ends it; both hold a control string.
OPEN, END = "### ", "\n</turn>\n"
#: The role whose turns are replies.
REPLY = "assistant"
#: Code points of a conversation whose prefixes are one task's, and of examples that leave a task at once.
SHARE, BATCH_CHARS = 1 << 18, 1 << 22
_INSIDE, _BACK = re.compile(r"\\|###|</turn>"), re.compile(r"\\(\\|###|</turn>|n)")


def escaped(text: str) -> str:
    """With a backslash before each backslash and control string."""
    return _INSIDE.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    """What ``escaped`` was given; ``\\n``, which it never makes, stands for a line end in a role."""
    return _BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def head(role: str) -> str:
    """The line that opens a turn."""
    return OPEN + escaped(role).replace("\n", "\\n") + ":\n"


def formatted(role: str, text: str) -> str:
    """A turn in the template."""
    return head(role) + escaped(text) + END


def turns_of(text: str, since: int = 0) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text, from one on. Only the end of a turn is a line ``</turn>``, and a role is one line."""
    parts = [x.partition("\n") for x in text.split(END)[since:-1]]
    return [(unescaped(line[len(OPEN) : -1]), unescaped(body)) for line, _, body in parts]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in the template, with what comes before each in the same task and conversation: turns, replies, code points."""
    now, turns, replies, before = object(), 0, 0, 0
    for batch in batches:
        convs, rows = batch.column("conv_id").to_pylist(), []
        for conv, role, text in zip(convs, batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if conv != now:
                now, turns, replies, before = conv, 0, 0, 0
            piece, reply = formatted(role, text), role == REPLY
            start = len(head(role)) if reply else None
            rows.append((turns, replies, reply, before, len(piece), piece, start, len(piece) - len(END) if reply else None))
            turns, replies, before = turns + 1, replies + reply, before + len(piece)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        names = ("conv_id", "part", "turn_no", "example", "is_reply", "context_chars", "chars", "piece", "loss_start", "loss_end")
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), *[pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]], names)


def _prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each share from sorted ones, replies with all formatted text before them; rows of earlier shares only bring their text.

    A task has one conversation's text so far in memory, as each of its examples has.
    """
    now, context, since, names = object(), "", 0, ("prefix", "since")
    for batch in batches:
        kept = pa.schema([f for f in batch.schema if f.name not in ("share", "own")])
        schema = pa.schema([*kept, ("prefix", pa.string()), ("since", pa.int64())])
        rows, size = [], 0
        for row in batch.to_pylist():
            key, mine = (row["conv_id"], row.pop("share")), row.pop("own")
            if key != now:
                now, context, since = key, "", 0
            if mine:
                rows.append(row | dict(zip(names, (context, since) if row["is_reply"] else (None, None), strict=True)))
                size += len(context) if row["is_reply"] else 0
            context += row["piece"]
            since = row["turn_no"] + 1 if row["is_reply"] else since
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """A row per turn: (conv_id, turn_no, example, is_reply, context_chars, chars, piece, loss_start, loss_end, prefix, since).

    ``turn_no`` counts the turns of a conversation from 0. A row with ``is_reply`` is an example: ``prefix`` is the formatted text of all
    earlier turns, of ``context_chars`` code points, and ``piece`` the target, of ``chars``, in which the reply alone, from ``loss_start`` to
    ``loss_end`` (exclusive), is trainable; turns from number ``since`` on are in no earlier example. Other rows have null in ``prefix`` and
    ``since``. ``example`` is the number, from 0, of the first example that has the turn; turns after the last reply are in none and carry the
    number of replies.

    Turns are formatted once, dealt out by ranges; counts of earlier ranges are added afterwards. Prefixes are then made by conversation and
    ``share`` code points of it, so a very long conversation is many tasks' work, each of which gets the turns before its own as well. Rows
    with prefixes are not shuffled or written here, since together they grow with the square of a conversation's turns. Null texts and roles
    are empty ones. Null conversation ids are one conversation, null turns come first in theirs; turns that repeat a number are ordered by
    role, then text; repeated rows are turns of their own. Other columns are left out; an empty table gives an empty one.
    """
    python_workers(turns.sparkSession)
    string = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), string(role_col).alias("role"), string(text_col).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("part"), "role", "text")
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, part int, turn_no bigint, example bigint, is_reply boolean, context_chars bigint, chars bigint, piece string, loss_start bigint, loss_end bigint"
    rows = stored(rows.mapInArrow(_formatted, schema))
    # What earlier ranges have of a conversation. Only the first one of a range can have begun before it, so there is a row per range at most.
    sums = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum(F.col("is_reply").cast("bigint")).alias("replies"), F.sum("chars").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A conversation of one range and one share needs nothing from here.
    sums = sums.withColumn("total", F.sum("size").over(Window.partitionBy("conv_id")))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), *[F.sum(x).over(before).alias(x) for x in ("n", "replies", "size")], "total")
    sums = stored(sums.where((F.col("n").isNotNull()) | (F.col("total") > share)))
    rows = rows.join(lookup(sums), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    moved = {"turn_no": "n", "example": "replies", "context_chars": "size"}
    rows = rows.withColumns({c: F.col(c) + F.coalesce(F.col(x), F.lit(0)) for c, x in moved.items()})
    own, last = F.floor(F.col("context_chars") / share), F.floor((F.coalesce("total", F.lit(1)) - 1) / share)
    rows = rows.withColumn("first", own).withColumn("share", F.explode(F.sequence("first", F.greatest("first", last))))
    rows = rows.withColumn("own", F.col("share") == F.col("first")).drop("part", "c", "p", "total", "first", *moved.values())
    rows = rows.repartition("conv_id", "share").sortWithinPartitions("conv_id", "share", "turn_no")
    return rows.mapInArrow(_prefixed, schema.replace(" part int,", "") + ", prefix string, since bigint")


def examples(expanded: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) of the rows of ``expand``: each reply after all turns before it, and the code points
    that are trainable (end exclusive). Conversations without a reply have no rows, and an empty table gives an empty one."""
    moved = [(F.length("prefix") + F.col(c)).cast("bigint").alias(c) for c in ("loss_start", "loss_end")]
    return expanded.where("is_reply").select("conv_id", "example", F.concat("prefix", "piece").alias("text"), *moved)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each example's text says, read by itself: its turns that no earlier example has, its reply, its length. Other rows are read
    likewise, as they may be turns after the last reply."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text, since = (row["prefix"] or "") + row["piece"], row["since"] or 0
            turns = turns_of(text, since)
            if row["is_reply"] and since + len(turns) != row["turn_no"] + 1:
                raise ValueError(f"an example of conversation {row['conv_id']} does not read back as {row['turn_no'] + 1} turns")
            at = len(row["prefix"] or "")
            reply = unescaped(text[at + row["loss_start"] : at + row["loss_end"]]) if row["is_reply"] else None
            rows.append({"conv_id": row["conv_id"], "turn_no": row["turn_no"], "turns": [{"role": a, "text": b} for a, b in turns], "reply": reply, "chars": len(text)})
        turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        schema = pa.schema([batch.schema.field("conv_id"), ("turn_no", pa.int64()), ("turns", turn), ("reply", pa.string()), ("chars", pa.int64())])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation from its sorted examples and other rows; digests go on from one to the next. Rows that are no reply's only count
    if no example follows, as it has their turns."""
    now, turns, loss, sums, rest = object(), hashlib.sha256(), hashlib.sha256(), None, []
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def read(own: list[dict]) -> None:
        for turn in own:
            sums["turns"] += 1
            turns.update(f"{turn['role']}\n{turn['text']}\n".encode())

    def row() -> dict:
        for own, chars in rest:
            read(own)
            sums["chars"] += chars
        own = (sums["turns"], turns.hexdigest(), sums["loss"], loss.hexdigest(), sums["chars"])
        return {"conv_id": now} | dict(zip(names, own, strict=True))

    for batch in batches:
        done = []
        schema = pa.schema([batch.schema.field("conv_id"), *[(k, pa.string() if k.endswith("sha256") else pa.int64()) for k in names]])
        for conv, own, reply, chars in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turns", "reply", "chars")], strict=True):
            if sums is None or conv != now:
                done += [row()] if sums else []
                now, turns, loss, sums, rest = conv, hashlib.sha256(), hashlib.sha256(), dict.fromkeys(("turns", "loss", "chars"), 0), []
            if reply is None:
                rest.append((own, chars))
                continue
            read(own)
            loss.update(reply.encode())
            sums["loss"] += len(reply)
            sums["chars"] += chars
            rest = []
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if sums:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def read_back(expanded: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of the rows of ``expand``, from the formatted texts alone.

    Each example is read by itself, where it is made: its text, prefix and target, has to hold as many turns as its place says, those that no
    earlier example has are unescaped, and so is the text under the loss mask. Only these go on to their conversation's row, whose digests
    are worked out in the order of its turns. ``formatted_chars`` is that of the texts of all examples, and of the turns after the last
    reply, which are in none.
    """
    kind = dict(expanded.dtypes)["conv_id"]
    rows = expanded.select("conv_id", "turn_no", "is_reply", "since", "prefix", "piece", "loss_start", "loss_end")
    rows = rows.mapInArrow(_parsed, f"conv_id {kind}, turn_no bigint, turns array<struct<role string, text string>>, reply string, chars bigint")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return rows.mapInArrow(_read_back, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
