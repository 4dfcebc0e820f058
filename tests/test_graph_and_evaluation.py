import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlsplit

import pytest

from scriptorium.functions.scratch import scratch
from scriptorium.operators import evaluation, graph

EDGES = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("C", "A"), ("C", "D")]


def test_pagerank(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    once = {r.page: r.rank for r in graph.pagerank(edges, max_iter=1)[0].collect()}
    assert once == pytest.approx({"A": 0.233333, "B": 0.2, "C": 0.4, "D": 0.166667}, abs=1e-6)
    ranks, trace = graph.pagerank(edges)
    assert {r.page: r.rank for r in ranks.collect()} == pytest.approx({"C": 0.352062341, "A": 0.273629551, "B": 0.194585837, "D": 0.179722272}, abs=1e-9)
    assert trace[0][1] == pytest.approx(0.179505, abs=1e-6)
    assert trace[-1] == (7, pytest.approx(0.002903802, abs=1e-9))


def ranks_by_loops(edges, rounds, lam=0.2):
    pages = sorted({p for e in edges for p in e})
    out, rank = Counter(s for s, _ in edges), {p: 1 / len(pages) for p in pages}
    for _ in range(rounds):
        lost = sum(r for p, r in rank.items() if not out[p])
        after = {p: lam / len(pages) + (1 - lam) * lost / len(pages) for p in pages}
        for s, d in edges:
            after[d] += (1 - lam) * rank[s] / out[s]
        rank = after
    return rank


def test_edges_of_a_hot_source_are_parted(spark):
    rng = random.Random(2)
    edges = [("hub", f"n{i}") for i in range(300)] + [(f"n{rng.randrange(300)}", rng.choice(["hub", "n1", f"n{rng.randrange(300)}"])) for _ in range(300)]
    table = spark.createDataFrame(edges, "src string, dst string")
    ranks, trace = graph.pagerank(table, max_iter=5, tau=0.0, most=20)
    assert {r.page: r.rank for r in ranks.collect()} == pytest.approx(ranks_by_loops(edges, 5), abs=1e-12)
    assert len(trace) == 5
    degree = graph.out_degree(table).selectExpr("*", "cast(ceil(cnt / 20) as int) parts")
    assert graph.weighted(table, degree, 20).where("src = 'hub'").select("part").distinct().count() == 15


def test_edges_stay_in_their_buckets(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    degree = graph.out_degree(edges).selectExpr("*", "1 parts")
    state = graph.nodes(edges).selectExpr("page", "1 parts", "0.25D rank").repartition(3).checkpoint()
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        with graph.bucketed(graph.weighted(edges, degree), 4, "src", "part") as weights:
            plan = graph.contributions(weights, state)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    above = plan[: next(i for i, line in enumerate(plan) if "bucketed_" in line or "SelectedBucketsCount" in line) + 1]
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert [line for line in above[join:] if "Exchange" in line and "rank" not in line] == []
    assert any("SelectedBucketsCount: 4 out of 4" in line for line in plan)


def test_only_the_last_ranks_are_kept(spark):
    folder = Path(urlsplit(scratch(spark)).path)
    before = set(folder.iterdir())
    graph.pagerank(spark.createDataFrame(EDGES, "src string, dst string"))
    assert len(set(folder.iterdir()) - before) == 1


def test_edges_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)
    rdd = spark.sparkContext.parallelize(EDGES, 2).map(lambda e: (read.add(1), e)[1])
    ranks, _ = graph.pagerank(spark.createDataFrame(rdd, "src string, dst string"))
    assert ranks.count() == 4
    assert read.value == len(EDGES)


def test_links(spark):
    edges = spark.createDataFrame([(*e, i) for i, e in enumerate(EDGES)], "src string, dst string, ord int")
    assert [(r.page, r.rank, r.cnt) for r in graph.top_inlinks(edges).collect()] == [("C", 1, 2), ("A", 2, 2), ("B", 3, 1), ("D", 4, 1)]
    assert [r.page for r in graph.top_inlinks(edges.drop("ord"), 2).collect()] == ["A", "C"]
    assert [r.page for r in graph.dangling(edges).collect()] == ["D"]


def test_empty_graph(spark):
    ranks, trace = graph.pagerank(spark.createDataFrame([], "src string, dst string"))
    assert ranks.collect() == []
    assert trace == []


RUN = [("q1", "d1", 1), ("q1", "d2", 2), ("q1", "d3", 3), ("q1", "d4", 4), ("q2", "d7", 1), ("q2", "d8", 2), ("q3", "d1", 1)]
QRELS = [("q1", "d2", 2.0), ("q1", "d4", 1.0), ("q1", "d9", 1.0), ("q1", "d1", 0.0), ("q2", "d7", 0.0), ("q2", "d6", 1.0), ("q4", "d1", 1.0)]


def test_metrics(spark):
    run, qrels = spark.createDataFrame(RUN, "qid string, doc_id string, rank int"), spark.createDataFrame(QRELS, "qid string, doc_id string, rel double")
    rows = {r.qid: [getattr(r, m) for m in evaluation.METRICS] for r in evaluation.per_query(run, qrels).collect()}
    assert rows == {"q1": pytest.approx([0.6885, 0.5, 0.1333, 0.6667, 0.1429, 0.3333], abs=1e-4), "q2": [0.0] * 6}
    means = evaluation.summary(evaluation.per_query(run, qrels)).first()
    assert [means[m] for m in evaluation.METRICS] == pytest.approx([0.3443, 0.25, 0.0667, 0.3333, 0.0714, 0.1667], abs=1e-4)
    assert [r.qid for r in evaluation.unjudged(run, qrels).collect()] == ["q3"]
    assert evaluation.gaps(run).collect() == []
    assert evaluation.summary(evaluation.per_query(run.limit(0), qrels)).collect() == []


def test_long_run_duplicates_and_negatives(spark):
    run = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 101)], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d32", -1.0, 0), ("q", "d32", 3.0, 1), ("q", "d90", 5.0, 2), ("q", "d40", -2.0, 3)], "qid string, doc_id string, rel double, ord int")
    row = evaluation.per_query(run, qrels).first()
    assert row.rr == 1 / 32
    assert row.ap == pytest.approx((1 / 32 + 2 / 90) / 2)
    assert evaluation.qrels_totals(qrels).first().relevant == 2
