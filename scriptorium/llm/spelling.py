"""Spelling variants: words one edit apart, and the form that each is a variant of.

If two words are one edit apart, the first half of one stands unchanged in the other, or its second half does. So a word goes to the words
that begin with its first half, and to those that end in its second half (which are words that begin with it, when read backwards). There,
a minimal acyclic automaton of the words matches the half exactly and completes the rest with one error. Its states know how many
words end below them, so a match is the number of a word, and counts are looked up by it. No pairs of words are emitted: a task gives each
word's number of near words and the best of them, once for either direction, and what both directions could find counts as the first's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import discarded, python_workers, stored

#: Letters of a run; capitals that are lower-cased, and what they become.
RUN, UPPER, LOWER = r"[A-Za-zÀ-ÿ]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of so many occurrences, as their hash has it, one loses a letter.
SPOILT = 97
#: Least code points and occurrences of a word, and how many times more often its form has to occur.
LEAST_CHARS, LEAST_TIMES, TIMES = 5, 3, 2
#: Words of one automaton; a half that more words have is dealt out to several, each of which all that ask for the half go to.
WORDS = 100_000


def spoilt_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """(word): the occurrences of runs of letters, A-Z lower-cased; those whose crc32 with the id is divisible by SPOILT lack one letter.

    Shorter ones than ``least`` are left out. Null texts have none; a null id is an empty one in the hash.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select(F.translate("run", UPPER, LOWER).alias("run"), "id")
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % SPOILT == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.char_length("word") >= least)


class Automaton:
    """The minimal acyclic automaton of different words in ascending order; the number of a word is its place among them.

    A state is known by whether a word ends there and by its edges; equal ones are one state. ``edges[state]`` maps a letter to the state
    behind it and to the number of words that are accepted before those behind it.
    """

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        self._known: dict[tuple, int] = {}
        open_: list[list] = [[False, []]]  # of the word before, from the root on: does a word end here, edges so far
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(open_, last, same)
            open_ += [[False, []] for _ in range(len(word) - same)]
            open_[-1][0] = True
            last = word
        self._close(open_, last, 0)
        self.root = self._state(*open_[0])
        del self._known

    def _close(self, open_: list[list], word: str, depth: int) -> None:
        """Give the open states of a word below ``depth`` their final form."""
        while len(open_) > depth + 1:
            state = self._state(*open_.pop())
            open_[-1][1].append((word[len(open_) - 1], state))

    def _state(self, final: bool, edges: list[tuple[str, int]]) -> int:
        key = (final, tuple(edges))
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.edges)
            before, own = int(final), {}
            for letter, target in edges:
                own[letter] = (target, before)
                before += self.count[target]
            self.edges.append(own)
            self.final.append(final)
            self.count.append(before)
        return state

    def exact(self, state: int, number: int, word: str, at: int) -> tuple[int, int] | None:
        """The state and number after the letters of ``word`` from ``at`` on."""
        for letter in word[at:]:
            step = self.edges[state].get(letter)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with the first ``half`` letters of a word and are one edit, in the rest, from it."""
        found: set[int] = set()
        begin = self.exact(self.root, 0, word[:half], 0)
        if begin is None:
            return found
        state, number = begin
        final, edges, exact = self.final, self.edges, self.exact
        for at in range(half, len(word) + 1):
            here = word[at] if at < len(word) else None
            tries = [(state, number, at + 1)] if here else []  # a letter less
            for letter, (target, before) in edges[state].items():
                if letter != here:  # the same letter more is found behind it
                    tries.append((target, number + before, at))
                    if here:
                        tries.append((target, number + before, at + 1))
            for start, so_far, rest in tries:
                end = exact(start, so_far, word, rest)
                if end and final[end[0]]:
                    found.add(end[1])
            step = edges[state].get(here) if here else None
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def _half(length: int, backward: bool) -> int:
    return (length + 1) // 2 if backward else length // 2


def _answers(group: list[tuple[str, int, bool, bool]], backward: bool) -> Iterator[tuple[str, int, int, int | None, str | None]]:
    """(word, n, n_near, best_n, best) of what asks among (word, n, has, asks); words are reversed here if ``backward``."""
    counts = {word: n for word, n, has, _ in group if has}
    words = sorted(counts)
    numbers = [counts[w] for w in words]
    automaton = Automaton(words)
    plain = [w[::-1] for w in words] if backward else words
    for word, n in sorted({(word, n) for word, n, _, asks in group if asks}):
        own = word[::-1] if backward else word
        found = automaton.near(word, _half(len(word), backward))
        if backward:  # those that share the first half as well are found forwards
            first = own[: _half(len(word), False)]
            found = {k for k in found if not plain[k].startswith(first)}
        best = min(((-numbers[k], plain[k]) for k in found), default=(None, None))
        yield own, n, len(found), None if best[0] is None else -best[0], best[1]


def _searched(backward: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Answers from rows sorted by key and salt: groups meet in one automaton up to ``most`` words, but each salt of a large key is alone in
    one, since its words, which may be there under a longer half as well, are to be found once."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def told(group: list) -> Iterator[pa.RecordBatch]:
        rows = list(_answers(group, backward))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[str, int, bool, bool]] = []
        now, has_now, alone_now = None, 0, False
        for batch in batches:
            for key, salt, alone, word, n, has, asks in zip(*[batch.column(c).to_pylist() for c in ("key", "salt", "alone", "word", "n", "has", "asks")], strict=True):
                if (key, salt) != now:
                    if has_now >= most or alone or alone_now:
                        yield from told(group)
                        group, has_now = [], 0
                    now, alone_now = (key, salt), alone
                group.append((word, n, has, asks))
                has_now += has
        if group:
            yield from told(group)

    return search


def halves(words: DataFrame, backward: bool) -> DataFrame:
    """(key, word, n, asks): a word under the halves that words of its length, one more and one less have; it asks under its own."""
    word = F.reverse("word") if backward else F.col("word")
    rows = words.select(word.alias("word"), "n", F.char_length("word").alias("size"))
    half = lambda size: F.floor((size + 1) / 2).cast("int") if backward else F.floor(size / 2).cast("int")
    rows = rows.withColumn("half", F.explode(F.array_distinct(F.array(*[half(F.col("size") + d) for d in (-1, 0, 1)]))))
    return rows.select(F.substr("word", F.lit(1), F.col("half")).alias("key"), "word", "n", (F.col("half") == half(F.col("size"))).alias("asks"))


def one_way(words: DataFrame, backward: bool, most: int = WORDS) -> DataFrame:
    """(word, n, n_near, best_n, best) of every word, from the words that share its first half (``backward``: the second half only).

    The words under a half are counted first. Where they are more than ``most``, they are dealt out to as many salts as it takes and what asks
    goes to each of them; answers from different salts are about different words.
    """
    rows = halves(words, backward)
    large = stored(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > most).select(F.col("key").alias("k"), F.ceil(F.col("m") / most).cast("int").alias("salts")))
    rows = rows.join(large, F.col("key") == F.col("k"), "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("salts", F.lit(1))).cast("int")
    salts = F.when(F.col("salts").isNotNull() & F.col("asks"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(own))
    rows = rows.select("key", "word", "n", "asks", F.col("salts").isNotNull().alias("alone"), own.alias("own"), F.explode(salts).alias("salt"))
    rows = rows.select("key", "salt", "alone", "word", "n", (F.col("own") == F.col("salt")).alias("has"), "asks")
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return rows.mapInArrow(_searched(backward, most), "word string, n bigint, n_near bigint, best_n bigint, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each word's chain of forms.

    Chains double in length with each round, and a form occurs twice as often as its word at least, so rounds are the logarithm of a
    logarithm of the largest count. Each round's table is written, and the one before it deleted.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        after = stored(now.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        discarded(now)
        now = after
        if after.where("moved").isEmpty():
            return after.drop("moved")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES, times: int = TIMES, most: int = WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per word of at least ``least_chars`` code points and ``least_times`` occurrences.

    ``n_near`` counts the words that are one inserted, deleted or replaced code point away; ``form`` is the most frequent of these (the smallest
    in code-point order among equally frequent ones), if it occurs ``times`` times as often as the word, else null, like ``form_n``. ``root`` is
    reached by following forms to the last, and is the word itself without any. Null and empty texts have no words, null ids are
    empty in the hash that decides which occurrences lack a letter, repeated rows count as often as they are there; other columns are
    ignored, and an empty table gives an empty one. ``least_chars`` is 3 at least, so that no half is empty, and an
    automaton has about ``most`` words.
    """
    if least_chars < 3:
        raise ValueError(f"least_chars is {least_chars}: words need 3 code points, or a half of them may be empty")
    python_workers(docs.sparkSession)
    words = stored(spoilt_words(docs, id_col, text_col, least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times))
    both = one_way(words, False, most).unionByName(one_way(words, True, most))
    best: Column = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus"), F.col("best"))))
    near = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    form = F.when(-F.col("b.minus") >= times * F.col("n"), F.col("b.best"))
    near = stored(near.select("word", form.alias("form"), "n", "n_near", F.when(form.isNotNull(), -F.col("b.minus")).alias("form_n")))
    ends = roots(near.where("form IS NOT NULL")).select(F.col("word").alias("w"), "root")
    return near.join(ends, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
