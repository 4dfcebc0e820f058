import gzip
import json
import random
from contextlib import contextmanager

import pytest

from pyspark.sql import functions as F

from scriptorium.operators import evaluation
from scriptorium.sources import readers, sinks


def test_readers(spark, tmp_path):
    scenes = {"corpus": [{"playId": "p", "sceneId": "p:1", "sceneNum": 0, "text": "to be"}, {"playId": "p", "sceneId": "p:2", "sceneNum": 1, "text": "or"}]}
    with gzip.open(tmp_path / "c.json.gz", "wt") as out:
        json.dump(scenes, out)
    assert [tuple(r) for r in readers.corpus(spark, str(tmp_path / "c.json.gz")).orderBy("doc_ord").collect()] == [("p", "p:1", 0, 0, "to be"), ("p", "p:2", 1, 1, "or")]
    (tmp_path / "b.tsv").write_text("q1\tscene\tAND\tto be\tnot\t\n\nq2\tplay\tor\tlady\n")
    assert [tuple(r) for r in readers.boolean_queries(spark, str(tmp_path / "b.tsv")).orderBy("qname", "unit_no").collect()] == [("q1", "scene", "AND", 0, ["to", "be"]), ("q1", "scene", "AND", 1, ["not"]), ("q2", "play", "or", 0, ["lady"])]
    (tmp_path / "r.tsv").write_text("q1\tscene\tbm25\tto\tto\n")
    assert [tuple(r) for r in readers.ranked_queries(spark, str(tmp_path / "r.tsv")).collect()] == [("q1", "scene", "bm25", 0, "to"), ("q1", "scene", "bm25", 1, "to")]
    with gzip.open(tmp_path / "e.tsv.gz", "wt") as out:
        out.write('a\tb\n"a\tc')
    assert {tuple(r) for r in readers.edges(spark, str(tmp_path / "e.tsv.gz")).collect()} == {("a", "b"), ('"a', "c")}
    (tmp_path / "x.txt").write_text("one\r\ntwo\rthree")
    assert [r.line for r in readers.lines(spark, str(tmp_path / "x.txt")).orderBy("line_no").collect()] == ["one", "two", "three"]
    (tmp_path / "s.txt").write_text("The\nof\n")
    assert [r.word for r in readers.stopwords(spark, str(tmp_path / "s.txt")).collect()] == ["The", "of"]
    (tmp_path / "run").write_text("q1 skip d1 1 2.5 tag\nq1 skip d2 x 1 tag\n")
    assert [tuple(r)[:4] for r in readers.run_file(spark, str(tmp_path / "run")).orderBy("ord").collect()] == [("q1", "d1", 1, 2.5), ("q1", "d2", None, 1.0)]
    (tmp_path / "qrels").write_text("q1 0 d1 2\n")
    assert [tuple(r)[:3] for r in readers.qrels_file(spark, str(tmp_path / "qrels")).collect()] == [("q1", "d1", 2.0)]


@contextmanager
def small_splits(spark, size):
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def test_lines_of_a_file_of_many_splits(spark, tmp_path):
    rng = random.Random(3)
    wanted = {}
    for name in ("a.txt", "b.txt"):
        own = ["é" * rng.randint(0, 9) + "x" * rng.choice([0, 0, 1, 30, 700]) for _ in range(900)]
        ends = [rng.choice(["\n", "\r\n", "\n"]) for _ in own]
        (tmp_path / name).write_bytes("".join(a + b for a, b in zip(own, ends, strict=True)).encode())
        wanted[name] = own
    with small_splits(spark, "2000"):
        rows = readers.lines(spark, str(tmp_path / "*.txt"))
        splits = spark.read.text(str(tmp_path / "*.txt")).rdd.getNumPartitions()
    assert splits > 20
    found = {name: {r.line_no: r.line for r in rows.collect() if r.doc_id.endswith(name)} for name in wanted}
    assert {name: [own[k] for k in range(len(own))] for name, own in found.items()} == wanted


@pytest.mark.parametrize("packed", [False, True])
def test_a_json_corpus_is_read_in_pieces(spark, tmp_path, packed, monkeypatch):
    monkeypatch.setattr(readers, "PIECES", 16)
    rng = random.Random(4)
    bits = ["{", "}", '"', "\\", '\\"', "{{", "a", " ", "\n", "é", "]}", '{"sceneId": 1}', "\\{"]
    scenes = [{"playId": f"p{i % 3}", "sceneId": f"s{i}", "sceneNum": i, "text": "".join(rng.choices(bits, k=rng.choice([0, 1, 5, 60])))} for i in range(300)]
    raw = json.dumps({"name": "{x}", "corpus": scenes}, ensure_ascii=packed, indent=rng.choice([None, 1])).encode()
    path = tmp_path / ("c.json.gz" if packed else "c.json")
    path.write_bytes(gzip.compress(raw) if packed else raw)
    with small_splits(spark, "1500"):
        rows = readers.corpus(spark, str(path)).orderBy("doc_ord").collect()
    assert [tuple(r) for r in rows] == [(s["playId"], s["sceneId"], s["sceneNum"], i, s["text"]) for i, s in enumerate(scenes)]


def test_files_have_the_given_names(spark, tmp_path):
    rows = spark.range(500).selectExpr("id ord", "concat('u', id) unit_id", "concat('q', id % 3) qname").repartition(4)
    sinks.boolean_results(rows, str(tmp_path / "bool"))
    assert sorted(p.name for p in (tmp_path / "bool").iterdir() if not p.name.startswith(".")) == ["q0.txt", "q1.txt", "q2.txt"]
    for q in range(3):
        assert (tmp_path / "bool" / f"q{q}.txt").read_text() == "".join(f"u{i}\n" for i in range(q, 500, 3))
    ranked = spark.range(500).selectExpr("'q' qname", "concat('d', id) unit_id", "id + 1 rank", "cast(1000 - id as double) score").repartition(4)
    for _ in range(2):
        sinks.run_file(ranked, str(tmp_path / "run.txt"), "me")
    assert (tmp_path / "run.txt").read_text() == "".join(f"q skip d{i} {i + 1} {1000 - i}.000000 me\n" for i in range(500))
    assert [p for p in tmp_path.iterdir() if ".parts-" in p.name] == []


def lines(path):
    if path.is_file():
        return path.read_text().splitlines()
    return [x for p in sorted(path.rglob("part-*")) for x in p.read_text().splitlines()]


def test_sinks(spark, tmp_path):
    ranked = spark.createDataFrame([("q", "d2", 2, -1e-9), ("q", "d1", 1, 1.25)], "qname string, unit_id string, rank long, score double")
    sinks.run_file(ranked, str(tmp_path / "run"), "me")
    assert lines(tmp_path / "run") == ["q skip d1 1 1.250000 me", "q skip d2 2 0.000000 me"]
    run = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 33)], "qid string, doc_id string, rank int")
    metrics = evaluation.per_query(run, spark.createDataFrame([("q", "d32", 1.0)], "qid string, doc_id string, rel double"))
    sinks.report(metrics, evaluation.summary(metrics), str(tmp_path / "report"))
    assert lines(tmp_path / "report")[0] == "NDCG@75 q 0.2000"
    assert lines(tmp_path / "report")[1] == "RR q 0.0312"
    assert lines(tmp_path / "report")[7] == "MRR  all 0.0312"
    sinks.boolean_results(spark.createDataFrame([("q", 1, "u1"), ("q", 2, "u0")], "qname string, ord long, unit_id string").coalesce(1), str(tmp_path / "bool"))
    assert lines(tmp_path / "bool" / "q.txt") == ["u1", "u0"]
    sinks.top_pages(spark.createDataFrame([("p", 1, 3)], "page string, rank long, cnt long"), str(tmp_path / "top"), "cnt")
    assert lines(tmp_path / "top") == ["p\t1\t3"]
    sinks.term_counts(spark.createDataFrame([("b", 1, 2), ("a", 4, 1), ("a2", 1, 3)], "term string, cnt long, ord long"), str(tmp_path / "terms"))
    assert lines(tmp_path / "terms") == ["a 4", "b 1", "a2 1"]
    sinks.tokens(spark.createDataFrame([(1, 1, "x"), (1, 0, "")], "doc_id long, pos int, stem string"), str(tmp_path / "tokens"))
    assert lines(tmp_path / "tokens") == ["", "x"]


def test_fixed_point_is_that_of_the_binary_value(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, -1.5, 0.03125, 0.00005, 0.00015, 0.99995, 0.12345, 2.5, 1e-12, -1e-9, 123.4567895, 0.5000005, 1 / 3, *(rng.random() for _ in range(3000)), *(rng.randrange(1 << 20) / (1 << 17) for _ in range(3000))]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", sinks.fixed(F.col("x"), 4).alias("four"), sinks.fixed(F.col("x"), 6).alias("six")).collect()
    assert [r for r in rows if r.four != f"{round(r.x, 4):.4f}" or r.six != f"{r.x:.6f}"] == []
