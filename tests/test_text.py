import random
import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text

LINES = {
    "A.B.C.'s": "abcs", "Ph.D.": "ph d", "U.S.A.": "usa", "www.google.com": "www google com", "u.s.army": "us army", "a.bc": "a bc", "3.14": "3 14",
    "3.1": "31", "a..b": "ab", ".a.b": "a b", "a.b.cd": "ab cd", "Mr. Darcy met Mrs. Long": "mrdarcy met mrslong", "Mr.  Darcy": "darcy",
    "Mr.\nDarcy": "darcy", "see Mr.": "see mr", "Mr. Mrs. X": "mrmrs x", "Mr. Ms. Mrs. Y": "mrms mrsy", "Mr.  Mrs. Y": "mrsy",
    "Mr. U.S.A. ok": "mrusa ok", "Mr. a.bc": "mra bc", "Mr.Smith": "mr smith", "dr. who Mr.' Fox": "dr who mrfox", "Mr. ... z": "z", "été": "t", "": "",
}
STEMS = {
    "stresses": "stress", "gaps": "gap", "gas": "gas", "cries": "cri", "stress": "stress", "agreed": "agree", "feed": "feed", "fished": "fishe",
    "falling": "falle", "ties": "tie", "this": "this", "ied": "ie", "aed": "", "aing": "", "sing": "sing", "hopping": "hop", "troubled": "trouble",
    "falls": "fall", "agreedly": "agree", "playing": "playe", "gaseous": "gaseous", "rating": "rate", "buzzed": "buzze",
}


def test_lines(spark):
    rows = spark.createDataFrame([(k,) for k in LINES], "text string").select("text", F.array_join(text.tokenize(F.col("text")), " ").alias("t")).collect()
    assert {r.text: r.t for r in rows} == LINES


def test_curve_in_spans(spark):
    rng = random.Random(5)
    rows = [(d, p, rng.choice("abcdefghijklmnop") * (1 + p // 40)) for d in (3, 4, 9) for p in range(0, 120, 1 + d % 2)]
    table = spark.createDataFrame(rows, "doc_id bigint, pos int, stem string").repartition(3)
    seen, wanted = set(), []
    for n, (_, _, stem) in enumerate(sorted(rows), 1):
        seen.add(stem)
        wanted.append((n, len(seen)))
    for span in (7, 4096):
        assert sorted(map(tuple, text.vocab_curve(table, span=span).collect())) == wanted


def test_ties_go_by_the_place_in_files(spark):
    rows = [("a", 0, "b b c"), ("a", 10, "d e"), ("a", 2, "f"), ("b", 0, "e c d f")]
    tokens = text.token_rows(spark.createDataFrame(rows, "file string, line_no bigint, line string"), [], ("file", "line_no"), "line")
    assert [r.term for r in text.top_terms(tokens, term="token", order=("file", "line_no", "pos")).orderBy("ord").collect()] == ["b", "c", "f", "d", "e"]


def test_stems(spark):
    rows = spark.createDataFrame([(k,) for k in STEMS], "word string").select("word", text.stem(F.col("word")).alias("s")).collect()
    assert {r.word: r.s for r in rows} == STEMS


def by_word(text):
    """The tokenizer as a loop over words."""
    s = re.sub(r"\r\n|\r|\n", "  ", text)
    s = re.sub(r"[^a-zA-Z0-9.']", " ", s).lower().replace("'", "")
    s = re.sub(r"(^| )(mrs|mr|ms)\. ([^ ]*)", "\\1\\2\x01\\3", s)
    out = []

    def parts(word):
        start = re.match(r"(?:[^.]\.+)+(?:[^.]\Z)?", word)
        start = start.group() if start else ""
        return [x for x in [start.replace(".", ""), *word[len(start) :].split(".")] if x]

    for word in s.split(" "):
        if "\x01" in word:
            left, right = word.split("\x01")
            own = parts(right)
            out += [left + own[0], *own[1:]] if own else []
        else:
            out += parts(word)
    return out


def test_tokens_word_by_word(spark):
    rng = random.Random(7)
    bits = ["a", "b", "bc", ".", ".", "..", " ", " ", "  ", "\n", "'", "Mr. ", "Mrs. ", "ms.", "mr", "é", "-", "3", "Ms. .", "x.y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["a." * 50_000, "ab." * 50_000, "mr. " * 9000, "." * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "no long, text string").select("no", text.tokenize(F.col("text")).alias("t")).collect()
    assert [(texts[r.no], r.t) for r in rows if r.t != by_word(texts[r.no])] == []


def test_white_space(spark):
    row = spark.createDataFrame([("a b\u0085c\x1cd  E\n",)], "text string").select(text.ws_tokens(F.col("text")).alias("t")).first()
    assert row.t == ["a", "b", "c", "d", "E"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(1, "the cat and the hats"), (2, None), (5000, "a cat sat. Hats fished"), (5001, "")], "doc_id long, text string")


def test_analyze_and_top(docs):
    tokens = text.analyze(docs)
    assert [(r.doc_id, r.pos, r.stem) for r in tokens.orderBy("doc_id", "pos").collect()] == [(1, 1, "cat"), (1, 4, "hat"), (5000, 1, "cat"), (5000, 2, "sat"), (5000, 3, "hat"), (5000, 4, "fishe")]
    assert [tuple(r) for r in text.top_terms(tokens, 3).collect()] == [("cat", 2, 1), ("hat", 2, 2), ("sat", 1, 3)]
    again = text.top_terms(text.token_rows(docs), 3, term="token", to=text.stem)
    assert [tuple(r) for r in again.collect()] == [("cat", 2, 1), ("hat", 2, 2), ("sat", 1, 3)]


def test_growth(docs):
    tokens = text.analyze(docs)
    assert [tuple(r) for r in text.vocab_growth(tokens).orderBy("doc_id").collect()] == [(1, 2, 2), (5000, 6, 4)]
    assert [tuple(r) for r in text.vocab_curve(tokens).orderBy("word_count").collect()] == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 4)]


def test_stopwords_from_a_table(spark, docs):
    words = spark.createDataFrame([("cat",)], "word string")
    assert text.analyze(docs, words).where("token = 'cat'").count() == 0


def test_first_places_are_kept_in_a_hash_table(spark):
    ids = [None, -(2**63), 2**63 - 1, -1, 0, 7, 7]
    docs = spark.createDataFrame([(i, f"common w{n % 3} word{n}") for n, i in enumerate(ids)], "doc_id bigint, text string")
    tokens = text.token_rows(docs)
    found = text.firsts_of(tokens, "token", None, ("doc_id", "pos"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    # A position that may be null is not taken as part of a number.
    plain = tokens.select("doc_id", F.when(F.col("pos") >= 0, F.col("pos")).alias("pos"), "token")
    assert "SortAggregate" in text.firsts_of(plain, "token", None, ("doc_id", "pos"))._jdf.queryExecution().executedPlan().toString()
    for to in (None, text.stem):
        rows = [sorted(((r.term, r.cnt, tuple(r.first)) for r in text.firsts_of(t, "token", to, ("doc_id", "pos")).collect()), key=str) for t in (tokens, plain)]
        assert rows[0] == rows[1] != []


def test_short_places_and_others(spark):
    edge = [-(1 << 42) - 1, -(1 << 42), -1, 0, (1 << 42) - 1, 1 << 42]
    rows = [(i, "t" if n % 2 else f"w{i}") for n, i in enumerate([*edge, None, *reversed(edge)])]
    tokens = spark.createDataFrame(rows, "doc_id bigint, token string").select("doc_id", F.explode(F.array(*[F.lit(p) for p in (3, (1 << 20) - 1, 1 << 20)])).alias("pos"), "token")
    tokens = tokens.unionByName(tokens.where("pos = 3").withColumn("token", F.lit("late")).withColumn("pos", F.lit(1 << 20)))
    found = {r.term: tuple(r.first) for r in text.firsts_of(tokens, "token", None, ("doc_id", "pos")).collect()}
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = {}
    for r in tokens.collect():
        want[r.token] = min(want.get(r.token, (r.doc_id, r.pos)), (r.doc_id, r.pos), key=key)
    assert found == want
    # The number of a long place is null where the place is short, so no decimal is made of it.
    short, long = text.short_number(tokens, "doc_id", "pos")[0], text.one_number(tokens, "doc_id", "pos")[0]
    assert {tuple(r) for r in tokens.select(short.isNull(), long.isNull()).collect()} == {(True, False), (False, True)}


def test_honorifics_are_only_looked_for_where_there_are_any(spark):
    said = ["Mr. A mrs.  b Ms.\nC", "mr.x no", "a_b\r\nc\rd", "x\x01mr. y\x02.z", "Mrs. ... q", "the ms. U.S.A. é.f"]
    want = [["mra", "b", "c"], ["mr", "x", "no"], ["a", "b", "c", "d"], ["x", "mry", "z"], ["q"], ["the", "msusa", "f"]]
    rows = spark.createDataFrame(list(enumerate(said)), "n int, t string").select("n", text.tokenize(F.col("t")).alias("t")).orderBy("n").collect()
    assert [r.t for r in rows] == want
