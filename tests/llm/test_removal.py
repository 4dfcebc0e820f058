"""Substring and suffix-array dedup against counting every window."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from scriptorium.llm import anchors, suffix_array, suffix_tree

LAST = (1 << 63) - 1


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_words(docs, window):
    rank = lambda i: LAST if i is None else i
    low, split = {}, [(i, words_of(t)) for i, t in docs]
    for i, w in split:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            low[k] = min(low.get(k, LAST), rank(i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if low[tuple(w[p : p + window])] < rank(i):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def by_bytes(docs, window):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[p : p + window] for _, b in raw for p in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, bytearray(kept), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(join):
    rng = random.Random(1)
    base, docs = [rng.choice("abcdefgh") for _ in range(100)], []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 6)):
            k = rng.random()
            if k < 0.4:
                a = rng.randint(0, 80)
                parts += base[a : a + rng.randint(5, 30)]
            elif k < 0.7:
                parts += [rng.choice("ab") for _ in range(rng.randint(0, 40))]
            elif k < 0.85:
                parts += [rng.choice(["ab", "é ", "a"])] * rng.randint(1, 40)
            else:
                parts.append("xyz")
        docs.append((i, join.join(parts)))
    return [*docs, (7, docs[7][1]), (None, docs[9][1]), (301, None), (302, ""), (303, f"a{join}" * 5000), (8, "other text " * 9)]


def frame(spark, docs):
    """With columns that clash with names used inside."""
    return spark.createDataFrame([(*d, 1, "x", 2.0) for d in docs], "doc_id long, text string, id int, mark string, start double").repartition(3)


@pytest.mark.parametrize("limits", [{}, {"group_suffixes": 4, "tree_suffixes": 3}, {"group_suffixes": 1, "tree_suffixes": 10}, {"group_suffixes": 30, "tree_suffixes": 10}])
def test_words(spark, limits):
    docs = corpus("  ")
    found = suffix_tree.remove_repeats(frame(spark, docs), window=11, gram=6, step=3, **limits)
    assert sorted(map(tuple, found.collect()), key=str) == by_words(docs, 11)


@pytest.mark.parametrize("block", [1 << 21, 60])
def test_bytes(spark, block):
    docs = corpus("")
    found = suffix_array.remove_repeats(frame(spark, docs), window=20, gram=12, block_bytes=block)
    assert sorted(map(tuple, found.collect()), key=str) == by_bytes(docs, 20)


def thue_morse(n, two):
    return [two[bin(i).count("1") % 2] for i in range(n)]


def test_strings_that_agree_modulo_two_to_the_64(spark):
    """In any base, polynomials of the two Thue-Morse strings of 2,048 symbols agree modulo 2**64."""
    one, two = "".join(thue_morse(2048, "ab")), "".join(thue_morse(2048, "ba"))
    both = [anchors.byte_values()[np.frombuffer(x.encode(), np.uint8)] for x in (one, two)]
    ends = (np.array([0]), np.array([2048]))
    assert anchors.hash_between(anchors.prefix_hashes(both[0]), *ends) == anchors.hash_between(anchors.prefix_hashes(both[1]), *ends)
    assert anchors.strong_between(anchors.strong_sums(both[0]), *ends) != anchors.strong_between(anchors.strong_sums(both[1]), *ends)
    docs = [(1, "x" * 40 + one + "y" * 30), (2, "z" * 40 + two + "u" * 30), (3, "v" * 50)]
    found = suffix_array.remove_repeats(frame(spark, docs), window=1500, gram=1400)
    assert sorted(map(tuple, found.collect()), key=str) == by_bytes(docs, 1500)
    texts = [np.frombuffer(t.encode(), np.uint8) for _, t in docs[:2]]
    assert not any(x.any() for x in suffix_array.repeated_windows(texts, 2000))


def test_a_passage_in_many_contexts_is_cut_by_longer_anchors(spark):
    rng = random.Random(7)
    passage = "".join(rng.choice("abcd") for _ in range(15))
    some = ["".join(rng.choice("abcd") for _ in range(12)) for _ in range(6)]
    docs = [(i, "".join(rng.choice("abcd") for _ in range(9)) + rng.choice(some) + passage + rng.choice(some)) for i in range(200)]
    for block in (4000, 1500, 200):
        found = suffix_array.remove_repeats(frame(spark, docs), window=20, gram=12, block_bytes=block)
        assert sorted(map(tuple, found.collect()), key=str) == by_bytes(docs, 20)
    pieces = spark.createDataFrame([(1, i, 0, 0, len(t) - 19, 1, bytearray(t.encode())) for i, t in docs], suffix_array.PIECES)
    done, rest = suffix_array.cut_finer(pieces, 20, 12, 600)
    assert rest is not None
    assert sum(x.selectExpr("sum(run) n").first().n or 0 for x in (done, rest)) == sum(len(t) - 19 for _, t in docs)
    assert all(r.b <= 600 for r in done.groupBy("anchor").agg(F.sum(F.length("piece")).alias("b")).collect())


def test_empty(spark):
    none = frame(spark, corpus(" ")).limit(0)
    assert suffix_tree.remove_repeats(none).collect() == []
    assert suffix_array.remove_repeats(none).collect() == []


def test_index():
    rng = random.Random(2)
    texts = [np.frombuffer("".join(rng.choice("ab") for _ in range(n)).encode(), np.uint8) for n in (0, 1, 30, 200, 200)]
    texts.append(texts[3])
    whole, where = [bytes(t) for t in texts], [(i, p) for i, t in enumerate(texts) for p in range(len(t))]
    index = suffix_array.RunLengthIndex(texts)
    stats = index.matching_statistics()

    def longest(i, p):
        n = 0
        while p + n < len(whole[i]) and any((j, q) != (i, p) and whole[j][q : q + n + 1] == whole[i][p : p + n + 1] for j, q in where if q + n < len(whole[j])):
            n += 1
        return n

    assert [int(stats[index.starts[i] + p]) for i, p in where] == [longest(i, p) for i, p in where]
    assert index.runs < index.size


def test_all_that_goes_comes_from_the_trees(spark, monkeypatch):
    docs = corpus(" ")
    found = suffix_tree.remove_repeats(frame(spark, docs), window=11, gram=6, step=3).collect()
    assert sum(r.n_removed for r in found) > 100
    tree_hits = suffix_tree.tree_hits
    monkeypatch.setattr(suffix_tree, "tree_hits", lambda *a: tree_hits(*a).limit(0))
    assert {r.n_removed for r in suffix_tree.remove_repeats(frame(spark, docs), window=11, gram=6, step=3).collect()} == {0}


def test_maximal_repeats(spark):
    leaves = [(1, 5, 3, 0), (1, 5, 1, 0), (1, 5, 2, 0), (1, 5, 4, 7), (1, 5, 9, 7), (2, 5, 0, 1)]
    found = suffix_tree.maximal(spark.createDataFrame(leaves, suffix_tree.LEAF)).collect()
    assert {(r.half, r.seg): [tuple(x) for x in r.repeats] for r in found} == {(1, 5): [(1, 3, 0), (4, 1, 7), (9, 1, 7)], (2, 5): [(0, 1, 1)]}
