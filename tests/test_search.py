import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.errors import PySparkException

from scriptorium.functions.scratch import stored
from scriptorium.operators import boolean, ranking
from scriptorium.operators.index import MADE, PACKED, append, build, counted, filled, merge, open_index, sliced, thinned, unpacked
from scriptorium.plans import formats, queries

SCENES = [
    ("p1", "p1:1", 0, 0, "to be or not to be"), ("p1", "p1:2", 1, 1, "lady macbeth sleeps"),
    ("p2", "p2:1", 2, 2, "not lady of macbeth to be"), ("p2", "p2:2", 3, 3, "macbeth lady"),
]
MORE = [("p3", "p3:1", 4, 4, "lady waits"), ("p3", "p3:2", 5, 5, "hail macbeth"), ("p3", "p3:3", 6, 6, "")]
SCHEMA = "play_id string, scene_id string, scene_num long, doc_ord long, text string"


@pytest.fixture(scope="module")
def index(spark):
    return build(spark.createDataFrame(SCENES, SCHEMA))


def boole(spark, level, op, *units):
    return spark.createDataFrame([("q", level, op, i, u.split()) for i, u in enumerate(units)], "qname string, level string, op string, unit_no int, unit array<string>")


ASKED = [
    ("scene", "and", ["to be", "not"], ["p1:1", "p2:1"]), ("scene", "AND", ["lady macbeth"], ["p1:2"]), ("scene", "and", ["lady", "macbeth"], ["p1:2", "p2:1", "p2:2"]),
    ("scene", "or", ["lady", "to"], ["p1:1", "p1:2", "p2:1", "p2:2"]), ("scene", "and", ["lady macbeth", "zzz"], []), ("scene", "or", ["sleeps", "zzz", "yyy"], ["p1:2"]),
    ("play", "and", ["lady macbeth"], ["p1"]), ("scene", "and", ["to be or not to be"], ["p1:1"]), ("scene", "and", ["to be to"], []),
]


def test_boolean(spark, index):
    rows = [(f"q{q}", level, op, i, u.split()) for q, (level, op, units, _) in enumerate(ASKED) for i, u in enumerate(units)]
    found = boolean.search(index, spark.createDataFrame(rows, "qname string, level string, op string, unit_no int, unit array<string>")).orderBy("ord").collect()
    for q, (*_, expected) in enumerate(ASKED):
        assert [r.unit_id for r in found if r.qname == f"q{q}"] == expected, ASKED[q]


def test_phrase_does_not_cross_scenes(spark):
    index = build(spark.createDataFrame(SCENES + MORE, SCHEMA))
    assert [r.unit_id for r in boolean.search(index, boole(spark, "play", "or", "lady macbeth")).collect()] == ["p1"]


def test_unknown_op_and_level_raise(spark, index):
    for level, op in (("scene", "xor"), ("act", "and")):
        with pytest.raises(PySparkException):
            boolean.search(index, boole(spark, level, op, "to")).collect()


RANKED = [
    ("bm25", "scene", ["sleeps", "be"], [("p1:2", 0.987304), ("p1:1", 0.0), ("p2:1", 0.0)]), ("bm25", "scene", ["to", "to", "or"], [("p1:1", 0.706948), ("p2:1", 0.0)]),
    ("bm25", "play", ["sleeps", "lady"], [("p1", -1.565051), ("p2", -2.422427)]), ("ql", "scene", ["sleeps", "be"], [("p1:2", -4.525884), ("p1:1", -4.570912), ("p2:1", -4.592834)]),
    ("ql", "scene", ["to", "to", "or"], [("p1:1", -6.219106), ("p2:1", -6.328738)]), ("ql", "play", ["sleeps", "lady", "zzz"], [("p1", -4.550347), ("p2", -4.586476)]),
]


def test_ranking(spark, index):
    rows = [(f"q{q}", level, model, i, t) for q, (model, level, terms, _) in enumerate(RANKED) for i, t in enumerate(terms)]
    table = spark.createDataFrame(rows, "qname string, level string, model string, qpos int, term string")
    found = ranking.bm25(index, table).union(ranking.ql(index, table)).orderBy("rank").collect()
    for q, (*_, expected) in enumerate(RANKED):
        own = [r for r in found if r.qname == f"q{q}"]
        assert [r.unit_id for r in own] == [u for u, _ in expected]
        assert [r.score for r in own] == pytest.approx([s for _, s in expected], abs=1e-6)


def test_stored_index_is_read_by_folders(spark, tmp_path):
    path = str(tmp_path / "index")
    build(spark.createDataFrame(SCENES + MORE, SCHEMA), path)
    index = open_index(spark, path)
    terms = spark.createDataFrame([("lady",), ("zzz",)], "term string")
    assert sorted((r.term, r.scene_id) for r in index.postings(terms).collect()) == [("lady", s) for s in ("p1:2", "p2:1", "p2:2", "p3:1")]
    plan = index.of_terms(terms).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert "positions" not in plan.split("ReadSchema")[-1]


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_search_go_to_the_blocks(spark, index):
    # The index is not shuffled for a few words, whatever Spark makes of the size of their table.
    words = boolean.words_of(spark.createDataFrame([("a", "scene", "or", 0, ["lady"]), ("a", "scene", "or", 1, ["of", "the"])], "qname string, level string, op string, unit_no int, unit array<string>"))
    found = boolean.meetings(index, words)
    terms = spark.createDataFrame([("lady",), ("the",)], "term string")
    for plan in map(executed, (found.drop("all"), index.of_terms(terms), index.unit_tf("play", terms))):
        assert "SortMergeJoin" not in plan.split("Window")[-1]
        assert "BroadcastHashJoin" in plan
    chosen = stored(found)
    few, many = index.of_blocks(chosen, "ords"), index.of_blocks(chosen, "ords", most=0)
    assert "SortMergeJoin" not in executed(few)
    assert sorted(few.collect()) == sorted(many.collect()) != []


def test_scored_blocks_are_not_shuffled(spark, index):
    terms = spark.createDataFrame([("q", "scene", "lady", 1, 0), ("q", "scene", "the", 1, 1)], "qname string, level string, term string, qf bigint, qpos int")
    blocks, scores = ranking.bounded(index, terms, 1.8, 5.0, 0.75, 1)
    plan = executed(ranking.scored_blocks(index, blocks.drop("role"), 1.8, 0.75))
    assert "SortMergeJoin" not in plan
    assert "BroadcastHashJoin" in plan


def random_scenes(rng, n, first=0, words="abcdefgh"):
    weights = [2.0**-i for i in range(len(words))]
    texts = (" ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 12, 40]))) for _ in range(n))
    return [(f"p{rng.randrange(5)}", f"s{i}", i, i * 7, t) for i, t in enumerate(texts, first)]


def as_rows(index):
    return sorted((r.term, r.play_id, r.scene_id, r.doc_ord, tuple(r.positions)) for r in index.postings().collect())


def test_appended_and_merged_segments_are_one_build(spark, tmp_path):
    rng = random.Random(1)
    rows = random_scenes(rng, 400)
    parts = [spark.createDataFrame(rows[a:b], SCHEMA) for a, b in ((150, 400), (0, 90), (90, 150))]
    whole = build(spark.createDataFrame(rows, SCHEMA).repartition(3), slice_bits=4, span_scenes=100)
    path = str(tmp_path / "index")
    index = append(append(build(parts[0], path, slice_bits=3), parts[1], slice_bits=5), parts[2])
    assert len(index.segments) == 3
    asked = [boole(spark, "scene", op, *units).replace("q", name, "qname") for name, op, units in (("x", "and", ("a b", "c")), ("y", "or", ("h g", "d e a")), ("z", "and", ("f", "a")))]
    asked = asked[0].union(asked[1]).union(asked[2])
    found = [sorted(map(tuple, boolean.search(i, asked).collect())) for i in (whole, index)]
    assert found[0] == found[1]
    assert found[0]
    assert as_rows(index) == as_rows(whole)
    merged = merge(index, slice_bits=4)
    assert len(merged.segments) == 1
    assert as_rows(merged) == as_rows(open_index(spark, path)) == as_rows(whole)
    assert sorted(map(tuple, boolean.search(merged, asked).collect())) == found[0]
    assert len(list(Path(path, "blocks").glob("segment=*"))) == 1
    for r in merged.blocks.collect():
        assert (r.n, r.lo, r.hi, r.least_tf, r.most_tf) == (len(r.ords), min(r.ords), max(r.ords), min(r.tfs), max(r.tfs))
        assert r.n <= 16
        assert r.ords == sorted(r.ords)


def test_postings_are_packed_and_need_no_join(spark, index):
    assert "Join" not in executed(index.postings())
    assert "Join" not in executed(index.unit_tf("scene"))
    rows = [("p", i, str(i), ["a", "b", "a"] if i else []) for i in range(9)]
    corpus = spark.createDataFrame(rows, "play string, ord bigint, id string, tokens array<string>").coalesce(1)
    for most, slices in ((1 << 20, 3), (7, 4)):
        packs = corpus.mapInArrow(sliced(2, 1, 1, most), PACKED)
        blocks = packs.mapInArrow(unpacked, f"{MADE}, bucket int, span int").collect()
        assert packs.count() == 1
        assert sorted((r.term, r.ords[i], r.positions[i]) for r in blocks for i in range(r.n)) == [("a", i, [0, 2]) for i in range(1, 9)] + [("b", i, [1]) for i in range(1, 9)]
        assert len({r.slice for r in blocks}) == slices


def test_files_have_no_entry_that_the_rest_of_a_block_tells(spark, tmp_path):
    far = (1 << 63) - 9
    rows = [("p", -far, "x", ["a", "b"]), (None, 5, "5", ["a", "c", "a"]), ("q", far, str(far), ["a"]), ("q", far + 1, None, ["d", "d"]), ("q", far + 2, str(far + 2), ["d", "d"])]
    corpus = spark.createDataFrame(rows, "play string, ord bigint, id string, tokens array<string>").coalesce(1)
    kind = f"{MADE}, bucket int, span int"
    own = corpus.mapInArrow(sliced(3, 4, 1), PACKED).repartition(4, "bucket").sortWithinPartitions("bucket")
    own.mapInArrow(unpacked, kind).write.parquet(f"{tmp_path}/whole")
    own.mapInArrow(lambda batches: thinned(unpacked(batches)), kind).write.parquet(f"{tmp_path}/thin")
    whole, thin = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("whole", "thin"))
    got = {r.term: r for r in filled(thin).collect()}
    assert got == {r.term: r for r in whole.collect()}
    assert [(r.ords, r.tfs, r.lens, r.plays, r.ids, r.positions) for r in (got["a"], got["d"])] == [
        ([-far, 5, far], [1, 2, 1], [2, 3, 1], ["p", None, "q"], ["x", "5", str(far)], [[0], [0, 2], [0]]),
        ([far + 1, far + 2], [2, 2], [2, 2], ["q", "q"], [None, str(far + 2)], [[0, 1], [0, 1]]),
    ]
    kept = {r.term: (len(r.ords), len(r.tfs), len(r.lens), len(r.ids)) for r in thin.collect()}
    assert kept == {"a": (2, 3, 3, 3), "b": (0, 0, 0, 1), "c": (0, 0, 0, 0), "d": (1, 0, 0, 2)}


def test_an_appended_and_merged_index_takes_little_disk(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(20000)]
    texts = [" ".join(rng.choices(words, [1 / i for i in range(1, 20001)], k=400)) for _ in range(600)]
    rows = [(f"source {i % 7}", str(10**6 + i), i, 10**6 + i, t) for i, t in enumerate(texts)]
    parts = [spark.createDataFrame(rows[a:b], SCHEMA).coalesce(2) for a, b in ((0, 300), (300, 600))]
    n = merge(append(build(parts[0], str(tmp_path)), parts[1])).postings().count()
    assert sum(f.stat().st_size for f in tmp_path.rglob("blocks/**/*.parquet")) < 7.5 * n
    tokens = parts[0].union(parts[1]).selectExpr("play_id AS play", "scene_id AS id", "doc_ord AS ord", "split(text, ' ') AS tokens")
    packs = tokens.mapInArrow(sliced(7, 16, 1), PACKED).collect()
    assert sum(len(v) for r in packs for v in r if not isinstance(v, int)) < 10 * n


def test_a_word_of_every_scene_goes_to_many_folders(spark):
    index = build(spark.createDataFrame([("p", f"s{i}", i, i, "the") for i in range(640)], SCHEMA).coalesce(1), slice_bits=4, span_scenes=40, folder_tokens=10)
    blocks = index.blocks.where("term = 'the'")
    assert blocks.count() == 40
    assert (index.segments[0][2], blocks.select("span").distinct().count() >= 12) == (16, True)


def test_blocks_without_a_meeting_are_not_read(spark):
    rows = [("p", f"s{i}", i, i, "the rare pair" if i in (70, 333) else "the") for i in range(640)]
    index = build(spark.createDataFrame(rows, SCHEMA).coalesce(1), slice_bits=4)
    asked = boole(spark, "scene", "and", "the", "rare").union(boole(spark, "scene", "or", "the", "rare").replace("q", "o", "qname")).union(boole(spark, "play", "and", "the rare", "the").replace("q", "p", "qname"))
    found = {r.qname: (r.blocks, r.read) for r in boolean.skipped(index, asked).collect()}
    assert found == {"q": (42, 4), "o": (42, 42), "p": (82, 44)}
    assert [r.unit_id for r in boolean.search(index, asked.where("qname = 'q'")).orderBy("ord").collect()] == ["s70", "s333"]


def by_loops(rows, units, op, level):
    """Units that have the words and phrases, scene by scene."""
    have = defaultdict(set)
    for play, scene, _, _, text in rows:
        ws = text.split()
        for i, u in enumerate(units):
            if any(ws[k : k + len(u.split())] == u.split() for k in range(len(ws))):
                have[play if level == "play" else scene].add(i)
    return {u for u, got in have.items() if op == "or" or len(got) == len(units)}


def test_boolean_against_loops(spark):
    rng = random.Random(5)
    rows = random_scenes(rng, 300, words="abcdefghij")
    index = build(spark.createDataFrame(rows, SCHEMA).repartition(4), slice_bits=3)
    asked = {}
    for i in range(48):
        units = [" ".join(rng.choices("abcdefghijz", k=rng.choice([1, 1, 2, 3]))) for _ in range(rng.randint(1, 3))]
        asked[f"q{i}"] = (["scene", "play"][i % 2], rng.choice(["and", "or"]), units)
    table = spark.createDataFrame([(q, level, op, i, u.split()) for q, (level, op, us) in asked.items() for i, u in enumerate(us)], "qname string, level string, op string, unit_no int, unit array<string>")
    found = defaultdict(list)
    for r in boolean.search(index, table).orderBy("qname", "ord").collect():
        found[r.qname].append(r.unit_id)
    for q, (level, op, units) in asked.items():
        assert set(found[q]) == by_loops(rows, units, op, level), (op, units)
        assert len(found[q]) == len(set(found[q]))
        if op == "or":
            assert found[q] == sorted(found[q])


def bm25_by_loops(rows, terms, k):
    docs = {s: Counter(t.split()) for _, s, _, _, t in rows}
    size, mean = {s: sum(c.values()) for s, c in docs.items()}, sum(sum(c.values()) for c in docs.values()) / len(docs)
    n, qf = {t: sum(t in c for c in docs.values()) for t in terms}, Counter(terms)
    scores = {}
    for s, c in docs.items():
        own = [t for t in qf if c[t]]
        if own:
            scores[s] = sum(math.log((len(docs) - n[t] + 0.5) / (n[t] + 0.5)) * 2.8 * c[t] / (1.8 * (0.25 + 0.75 * size[s] / mean) + c[t]) * 6 * qf[t] / (5 + qf[t]) for t in own)
    return sorted(scores.values(), reverse=True)[:k]


def test_only_blocks_that_can_be_among_the_best_are_scored(spark):
    rng = random.Random(9)
    rows = random_scenes(rng, 900, words="abcdefghijkl")
    index = build(spark.createDataFrame(rows, SCHEMA).coalesce(2), slice_bits=3)
    asked = {"one": ["h"], "both": ["a", "j", "k"], "common": ["a", "b"], "all": ["a", "a", "c", "f", "zzz"]}
    table = spark.createDataFrame([(q, "scene", "bm25", i, t) for q, ts in asked.items() for i, t in enumerate(ts)], "qname string, level string, model string, qpos int, term string")
    for k in (1, 20):
        found = defaultdict(list)
        for r in ranking.bm25(index, table, k=k).orderBy("qname", "rank").collect():
            found[r.qname].append(r.score)
        for q, ts in asked.items():
            assert found[q] == pytest.approx(bm25_by_loops(rows, ts, k), abs=1e-9), (q, k)
    blocks = {r.qname: (r.blocks, r.scored) for r in ranking.skipped(index, table, k=1).collect()}
    assert all(scored < n for n, scored in blocks.values()), blocks


def test_many_hits_are_numbered_in_order(spark):
    index = build(spark.createDataFrame([(f"p{i % 7}", f"s{i}", i, i, "a b" if i % 3 else "b") for i in range(300)], SCHEMA))
    found = boolean.search(index, boole(spark, "scene", "and", "a", "b").union(boole(spark, "scene", "or", "a", "b").replace("q", "r", "qname"))).collect()
    assert [r.unit_id for r in sorted((r for r in found if r.qname == "q"), key=lambda r: r.ord)] == [f"s{i}" for i in range(300) if i % 3]
    assert [r.unit_id for r in sorted((r for r in found if r.qname == "r"), key=lambda r: r.ord)] == sorted(f"s{i}" for i in range(300))


def test_tables(spark, index):
    assert {(r.scene_id, tuple(r.positions)) for r in index.postings().where("term = 'to'").collect()} == {("p1:1", (0, 4)), ("p2:1", (4,))}
    assert tuple(index.stats("scene").first()) == ("scene", 4, 17, 4.25)
    assert tuple(index.stats("play").first()) == ("play", 2, 17, 8.5)
    lengths = {r.unit_id: r.len for r in build(spark.createDataFrame(SCENES + MORE, SCHEMA)).unit_len("scene").collect()}
    assert lengths["p3:3"] == 0
    with pytest.raises(ValueError, match="level"):
        index.unit_len("act")


def test_words_are_counted_without_an_index(spark, tmp_path, monkeypatch):
    odd = "a b\x1fa  c\x85"
    rows = [("p", "s0", 0, 4, f" {odd}"), ("p", "s1", 1, 3, "a b\nab"), ("q", "s2", 2, 2, None), (None, "s3", 3, 1, "b b"), ("q", "s4", 4, 0, "")]
    corpus, want = spark.createDataFrame(rows, SCHEMA), {}
    for play, _, _, place, said in rows:
        for word in (said or "").split():
            tf, first = want.get((word, play), (0, place))
            want[word, play] = (tf + 1, min(first, place))
    assert {(r.term, r.unit_id): (r.tf, r.first_ord) for r in counted(corpus, "play").collect()} == want
    by_scene = lambda df: sorted(map(tuple, df.select("term", "unit_id", "tf", "first_ord").collect()))
    assert by_scene(counted(corpus, "scene")) == by_scene(build(corpus).unit_tf("scene"))
    corpus.selectExpr("scene_num AS doc_id", "text", "play_id AS source").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "build", None)
    assert queries.unit_tf(spark, str(tmp_path)).count() == len(want)


def test_an_index_of_the_words_asked_for_finds_the_same(spark, index):
    own = build(spark.createDataFrame(SCENES, SCHEMA), terms=["to", "lady", "zzz"])
    assert {r.term for r in own.blocks.select("term").collect()} == {"to", "lady"}
    assert [sorted(map(tuple, i.stats("scene").union(i.stats("play")).collect())) for i in (own, index)][0] == sorted(map(tuple, index.stats("scene").union(index.stats("play")).collect()))
    assert sorted(map(tuple, own.postings().collect())) == sorted(map(tuple, index.postings().where("term IN ('to', 'lady')").collect()))
    for model, search in (("bm25", ranking.bm25), ("ql", ranking.ql)):
        asked = spark.createDataFrame([("q", level, model, i, w) for level in ("scene", "play") for i, w in enumerate(["to", "lady", "zzz"])], "qname string, level string, model string, qpos int, term string")
        assert sorted(map(tuple, search(own, asked).collect())) == sorted(map(tuple, search(index, asked).collect())) != []


def test_defaults_need_no_index_of_all_words(spark, tmp_path, monkeypatch):
    built = []
    monkeypatch.setattr(formats, "build", lambda *a, **b: built.append(build(*a, **b)) or built[-1])
    monkeypatch.setattr(queries, "build", None)
    formats.src_defaults(spark, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/x")
    asked = {w for q in ("bm25_scene", "ql_scene") for _, _, own in queries.RANKED[q].values() for w in own}
    assert set() < {r.term for r in built[0].blocks.select("term").distinct().collect()} <= asked
