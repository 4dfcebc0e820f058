"""Whitening, chat formatting and spelling variants against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import chat, spelling, whitening


def whitened_by_numpy(rows, k=4):
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([np.floor(256 * np.array(v, float)) for _, v in fine])
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = ((len(fit) * x - fit.sum(0)) ** 2).sum(1).astype(np.int64)
    return [i for i, _ in fine], len(fit), deviation, ((x - fit.mean(0)) @ vectors) / np.sqrt(values), values / np.trace(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.02, 0.01] @ rng.normal(size=(6, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(150)]
    rows += [(2000, None), (2001, [*base[0].tolist()[:5], None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (None, base[5].tolist()), (7, base[9].tolist())]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id int, embedding array<double>, component string").repartition(5)
    out = whitening.whiten(table).collect()
    ids, n, deviation, expected, explained = whitened_by_numpy(rows)
    assert len(out) == 4 * len(ids)
    found = defaultdict(list)
    for r in out:
        found[r.vec_id, r.component].append(r)
        assert (r.n, r.explained) == (n, pytest.approx(explained[r.component - 1], rel=1e-9))
        assert r.identity_error < 1e-9
    signs = {}
    for c in range(4):
        own = [(r.deviation, r.whitened) for i in ids for r in found[i, c + 1][:1]]
        signs[c] = np.sign(own[0][1] * expected[0, c])
        for i, d, w in zip(ids, deviation, expected[:, c] * signs[c], strict=True):
            assert any(r.deviation == d and r.whitened == pytest.approx(w, abs=1e-8) for r in found[i, c + 1]), i
    copies = {r.whitened for i, c in found for r in found[i, c] if c == 1 and (i is not None and i >= 1000)}
    assert len(copies) == 1


def test_whitening_of_little(spark):
    schema = "vec_id bigint, embedding array<float>"
    rows = [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]]
    for own in rows:
        out = whitening.whiten(spark.createDataFrame(own, schema))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.collect() == []
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.5, 1.0]), (3, [9.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in line) == [(1, 1, 2, 16384, 1.0, 1.0), (2, 1, 2, 16384, 1.0, 1.0)]
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.5])], schema)).collect()
    assert {(r.vec_id, r.deviation) for r in huge} == {(1, None), (2, None), (3, (3 * 0 + 1) ** 2 + (3 * 128 - 128) ** 2)}


def test_jacobi_keeps_small_eigenvalues():
    n = 9
    scale = 10.0 ** -np.arange(n)
    good = np.eye(n) + 0.1 / (1 + np.arange(n)[:, None] + np.arange(n))
    values, vectors = whitening.jacobi(good * scale[:, None] * scale)
    # The inverse has the same eigenvalues upside down, and its largest one is easy.
    inverse = np.linalg.inv(good) / scale[:, None] / scale
    assert values[-1] == pytest.approx(1 / np.linalg.eigvalsh(inverse)[-1], rel=1e-10)
    assert values == pytest.approx(sorted(values, reverse=True))
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-14


pieces = st.text(st.sampled_from("\\#</>turn \n:é") | st.characters(exclude_categories=("Cs",)), max_size=30) | st.sampled_from([chat.END, "</turn>", "\\</turn>", "### assistant:\n", "\\n", "\\\\n"])


@given(st.lists(st.tuples(pieces, pieces), max_size=4))
def test_template_is_reversible(turns):
    text = "".join(chat.formatted(role, body) for role, body in turns)
    assert chat.turns_of(text) == turns
    assert text.count(chat.END) == len(turns)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def talk(rng, convs):
    words = ["a", "\\", "###", "</turn>", "\n", "é", " ", "\n</turn>\n", "b" * 50, "\\n"]
    rows = []
    for conv in range(convs):
        for turn in range(200 if conv == 3 else rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(words, k=rng.randint(0, 8)))))
    return rows


def test_chat_examples(spark):
    rng = random.Random(4)
    rows = talk(rng, 20)
    shuffled = rng.sample(rows, len(rows))
    table = spark.createDataFrame([(*r, 1) for r in shuffled], "conv_id bigint, turn int, role string, text string, piece int").repartition(6)
    expanded = chat.expand(table).cache()
    assert expanded.count() == len(rows)
    by = defaultdict(list)
    for conv, _, role, text in rows:
        by[conv].append((role, text))
    found = sorted(chat.examples(expanded).collect(), key=lambda r: (r.conv_id, r.example))
    expected = [(c, turns[: i + 1]) for c, turns in by.items() for i, (role, _) in enumerate(turns) if role == "assistant"]
    assert len(found) == len(expected)
    chars, number = Counter(), Counter()
    for r, (conv, turns) in zip(found, expected, strict=True):
        assert (r.conv_id, r.example, chat.turns_of(r.text)) == (conv, number[conv], turns)
        assert chat.unescaped(r.text[r.loss_start : r.loss_end]) == turns[-1][1]
        assert r.text[r.loss_end :] == chat.END
        chars[conv] += len(r.text)
        number[conv] += 1
    for r in expanded.collect():
        assert r.context_chars == sum(len(chat.formatted(*x)) for x in by[r.conv_id][: r.turn_no])
    for r in chat.read_back(expanded).collect():
        turns = by[r.conv_id]
        last = max((i + 1 for i, (role, _) in enumerate(turns) if role == "assistant"), default=0)
        replies = "".join(text for role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(replies), digest(replies))
        assert r.formatted_chars == chars[r.conv_id] + sum(len(chat.formatted(*x)) for x in turns[last:])


def test_chat_prefixes_are_spelled_out(spark):
    rows = talk(random.Random(5), 6)
    table = spark.createDataFrame(random.Random(6).sample(rows, len(rows)), "conv_id bigint, turn int, role string, text string").repartition(3)
    by = defaultdict(list)
    for conv, _, role, text in rows:
        by[conv].append((role, text))
    # A share of 300 code points: the long conversation's prefixes are many tasks' work.
    results = []
    for share in (300, chat.SHARE):
        expanded = chat.expand(table, share=share)
        found = {(r.conv_id, r.turn_no): r for r in expanded.collect()}
        assert len(found) == len(rows)
        for (conv, no), r in found.items():
            before, here = by[conv][:no], by[conv][no]
            assert r.piece == chat.formatted(*here)
            assert r.prefix == ("".join(chat.formatted(*x) for x in before) if here[0] == "assistant" else None)
            assert r.since == (max((i + 1 for i, x in enumerate(before) if x[0] == "assistant"), default=0) if r.is_reply else None)
        results.append(sorted(chat.read_back(expanded).collect()))
    assert results[0] == results[1]
    # What is read back comes from the prefixes: another one gives other turns.
    other = expanded.withColumn("prefix", F.regexp_replace("prefix", "é", "e"))
    assert sorted(chat.read_back(other).collect()) != results[1]


def test_chat_of_odd_rows(spark):
    schema = "conv_id int, turn int, role string, text string"
    rows = [(None, 1, "assistant", "x"), (None, None, None, None), (None, 1, "assistant", "x"), (2, 0, "user", "only"), (3, 5, "assistant", ""), (3, 5, "a\n:", "b")]
    out = {r.conv_id: r for r in chat.read_back(chat.expand(spark.createDataFrame(rows, schema))).collect()}
    assert (out[None].n_turns, out[None].turns_sha256, out[None].loss_sha256) == (3, digest("\n\nassistant\nx\nassistant\nx\n"), digest("xx"))
    assert (out[2].loss_chars, out[2].loss_sha256, out[2].formatted_chars) == (0, digest(""), len("### user:\nonly\n</turn>\n"))
    assert out[3].turns_sha256 == digest("a\n:\nb\nassistant\n\n")
    empty = chat.expand(spark.createDataFrame([], schema))
    assert (empty.collect(), chat.examples(empty).collect(), chat.read_back(empty).collect()) == ([], [], [])


def variants(docs, least_times=3):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least_times}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    all_near = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(own, key=lambda v: (-words[v], v), default=None) for w, own in all_near.items()}
    form = {w: v if v and words[v] >= 2 * words[w] else None for w, v in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(all_near[w]), words.get(form[w])) for w, n in words.items()}


def sayings(rng):
    stems = ["".join(rng.choices("abcé", k=rng.randint(5, 9))) for _ in range(12)] + ["aaaaa", "aaaaaa", "abababab"]
    docs = []
    for i in range(120):
        words = []
        for _ in range(30):
            w = stems[min(int(rng.expovariate(0.4)), len(stems) - 1)]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k, c = rng.randrange(len(w) + 1), rng.choice("abcéÿ×")
                w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w, w.capitalize() if w[0].isascii() else w]))
        docs.append((i if i % 10 else None, rng.choice([" ", "-", "1"]).join(words)))
    return [*docs, (500, None), (501, ""), (502, "x" * 50_000), docs[0], docs[0]]


@pytest.mark.parametrize("most", [100_000, 3])
def test_spelling_variants(spark, most):
    docs = sayings(random.Random(6))
    table = spark.createDataFrame([(*d, "y") for d in docs], "doc_id bigint, text string, word string").repartition(5)
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(table, most=most).collect()}
    assert found == variants(docs)
    assert any(form and root != form for form, root, *_ in found.values())


def test_automata_number_words_in_order():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(400)})
    automaton = spelling.Automaton(words)
    ends = [automaton.exact(automaton.root, 0, w, 0) for w in words]
    assert [n for _, n in ends] == list(range(len(words)))
    assert all(automaton.final[s] for s, _ in ends)
    # Minimal: no two states accept the same endings.
    def endings(s):
        return frozenset(([""] if automaton.final[s] else []) + [c + e for c, (t, _) in automaton.edges[s].items() for e in endings(t)])
    assert len({endings(s) for s in range(len(automaton.edges))}) == len(automaton.edges)
    for w in rng.sample(words, 60):
        half = len(w) // 2
        one = {w[:k] + c + w[k + d :] for k, d, c in itertools.product(range(half, len(w) + 1), (0, 1), ("", *"abc"))} - {w}
        assert {words[k] for k in automaton.near(w, half)} == {v for v in one if v in set(words)}


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "abc abcd abc")]):
        out = spelling.group_variants(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert (out.columns, out.collect()) == (["word", "form", "root", "n", "n_near", "form_n"], [])
    with pytest.raises(ValueError, match="least_chars"):
        spelling.group_variants(spark.createDataFrame([], "doc_id bigint, text string"), least_chars=2)
