"""Toxicity, byte-level BPE, the n-gram join, fingerprints and the pipeline."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import zstandard

from scriptorium.llm import bpe, fingerprints, line_dedup, ngram_join, queries, suffix_array, suffix_tree, toxicity

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, id int, mark string").repartition(3)


def test_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = [(1, "it's  é\n\n x y \U0001f600<|endoftext|>"), (2, None), (3, ""), (None, " \t "), (4, "ab c\n  d e " * 9000), (4, "z" * 30_000 + " q"), (5, "x's" * 9000)]
    found = bpe.bpe_encode(frame(spark, docs), RANKS, public_tokenizers.PATTERN)
    expected = sorted((str(i), own.encode_ordinary(t or "")) for i, t in docs)
    assert sorted((str(r.doc_id), r.ids) for r in found.collect()) == expected
    assert {r.decoded_sha256 for r in found.collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in docs}
    assert Counter(bytes(r.bytes) for r in bpe.bpe_decode(found, RANKS, public_tokenizers.PATTERN).collect()) == Counter((t or "").encode() for _, t in docs)
    assert bpe.bpe_encode(frame(spark, docs).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


@pytest.mark.parametrize("white", [" ", "\t", "\n", "\xa0", "\u3000\n", " \x85"])
def test_bpe_long_white_space(spark, white):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    matches = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    n = 3_000_000 // len(white)
    # The library itself can do 200,000 characters; more are encoded match by match.
    for text in ("a" + white * 100_000 + "b", white * 100_000, "x\x1c" + white * 30_000 + "'s", white * 20_000 + "1 2" + white * 20_000 + "\x1f"):
        assert bpe.encode_text(own, text) == own.encode_ordinary(text)
        assert [t for m in matches.findall(text) for t in own._encode_single_piece(m.encode())] == own.encode_ordinary(text)
    text = "a" + white * n + "b"
    expected = [t for m in matches.findall(text) for t in own._encode_single_piece(m.encode())]
    rows = bpe.bpe_encode(frame(spark, [(1, text), (2, text[:-1])]), RANKS, public_tokenizers.PATTERN).collect()
    assert next(r.ids for r in rows if r.doc_id == 1) == expected
    assert {r.decoded_sha256 for r in rows} == {hashlib.sha256(t.encode()).hexdigest() for t in (text, text[:-1])}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = [r for r in rows if labels[r.doc_id]], [r for r in rows if not labels[r.doc_id]]
    assert np.mean([r.predicted for r in toxic]) > 0.7
    assert np.mean([r.predicted for r in clean]) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, [(1, None), (2, ""), (None, "a" * 5000), (3, "x y")])
    assert {r.score for r in toxicity.score(docs, toxicity.fit_on(docs, none)).collect()} == {0.0}
    one = spark.createDataFrame([(3, 1), (None, 0), (1, None)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score(docs, toxicity.fit_on(docs, one)).collect()} == {(1.0, 1)}
    model = toxicity.fit([(i, ("vile words " if i % 2 else "fine things ") + f"and some{i % 7} more text", i % 2) for i in range(300)])
    assert toxicity.score_text(model, "such vile words here") > 0.5 > toxicity.score_text(model, "such fine things here")
    assert toxicity.score_text(model, None) == toxicity.score_text(model, "")
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert toxicity.keep_clean(docs.limit(0), model).collect() == []


def test_every_mark_is_in_the_dictionary():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    vile, plain = [word() for _ in range(80)], [word() for _ in range(400)]
    rows = [(i, " ".join(rng.sample(plain, 40) + (rng.sample(vile, 20) if i % 2 else [])), i % 2) for i in range(1200)]
    model = toxicity.fit(rows)
    assert sum(w.encode() in model.toxic for w in vile) == 80
    assert not any(w.encode() in model.ordinary for w in vile)


def test_scores_are_those_of_a_plain_loop(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    vile, plain = [word() + "ous" for _ in range(20)], [word() for _ in range(200)]
    rows = [(i, " ".join(rng.choice(vile if i % 2 and rng.random() < 0.2 else plain) for _ in range(40)), i % 2) for i in range(400)]
    model = toxicity.fit(rows)
    assert len(model.toxic) > toxicity.ROOM

    def size(content, window):
        words = zstandard.ZstdCompressionDict(content + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters(
            window_log=16, hash_log=15, chain_log=14, search_log=4, min_match=6, target_length=8, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        return len(zstandard.ZstdCompressor(dict_data=words, compression_params=params).compress(window + toxicity.TAIL))

    def plain_score(text):
        left, gains = f" {' '.join((text or '').lower().split())} ".encode(), []
        while True:
            end = len(left) if len(left) <= toxicity.WINDOW else max([k + 1 for k in range(1, toxicity.WINDOW) if left[k] == 0x20 and k > 0], default=toxicity.WINDOW)
            end = toxicity.WINDOW if end <= 1 else end
            window = left[:end]
            gains.append(size(model.ordinary, window) - size(model.toxic, window))
            if end >= len(left):
                break
            left = left[end - (window[-1] == 0x20 and end > 1) :]
        up = [max(0, g) for g in gains]
        reached = sum(g >= model.threshold for g in gains)
        figures = [max(gains), math.log1p(reached), reached / len(gains), sum(up) / len(gains), sum(up) / math.sqrt(len(gains))]
        z = model.bias + sum(w * (f - c) / s for w, f, c, s in zip(model.weights, figures, model.centre, model.scale, strict=True))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    docs = [(i, t) for i, t, _ in rows[:60]] + [(900, None), (901, ""), (902, "z" * 500), (903, "  x  "), (904, vile[0])]
    found = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(frame(spark, docs), model).collect()}
    for i, t in docs:
        assert found[i][0] == pytest.approx(plain_score(t), abs=1e-9)
        assert found[i][1] == int(found[i][0] >= 0.3)


def test_repeated_ids_do_not_enlarge_the_sample(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda rows: taken.extend(rows) or 0.0)
    docs = spark.createDataFrame([(i % 5, f"t{i}") for i in range(100)], "doc_id long, text string")
    toxicity.fit_on(docs, spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int"), fit_rows=7)
    assert len(taken) == 7


@pytest.mark.parametrize("use", [ngram_join.join_similar, ngram_join.keep_first, fingerprints.compare_edited, suffix_array.remove_repeats, suffix_tree.remove_repeats, line_dedup.line_report])
def test_ids_are_integers(spark, use):
    with pytest.raises(TypeError, match="integers"):
        use(spark.createDataFrame([("a", "t")], "doc_id string, text string"))


def test_windows_cover_the_text():
    rng = random.Random(6)
    for _ in range(200):
        text = toxicity.plain("".join(rng.choice("ab  ") for _ in range(rng.randint(0, 300))) + "c" * rng.choice([0, 0, 150]))
        at = 0
        for w in toxicity.windows(text):
            assert 0 < len(w) <= toxicity.WINDOW
            at = text.index(w, max(0, at - 1)) + len(w)
        assert at == len(text)


def classes(docs, threshold=0.8):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))})
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) / len(a | b) >= threshold:
                up[top(i)] = top(j)
    members = {}
    for k, (i, _) in enumerate(docs):
        members.setdefault(top(k), []).append(i)
    return sorted(((i, min(members[top(k)], key=lambda v: (v is None, v or 0)), len(members[top(k)])) for k, (i, _) in enumerate(docs)), key=str)


def test_join(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.choice([6, 40, 200]))] for _ in range(6)]
    docs = []
    for i in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice("qrstuv")
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, " "), (503, "a b"), (504, "a  b"), (505, "b a"), (None, docs[3][1])]
    expected = classes(docs)
    found = ngram_join.join_similar(frame(spark, docs)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in found), key=str) == expected
    kept = ngram_join.keep_first(frame(spark, docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for i, c, _ in expected if i is not None} - {None})
    assert ngram_join.join_similar(frame(spark, docs).limit(0)).collect() == []


@pytest.mark.parametrize(("nodes", "signatures"), [(7, 4), (512, 1024)])
def test_link_counts(spark, monkeypatch, nodes, signatures):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)
    monkeypatch.setattr(ngram_join, "SIGNATURES", signatures)
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnop") * 2 + str(k) for k in range(n)] for n in (60, 130, 400)]
    docs = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice("qrstuv")
        docs.append((i, " ".join(w[: len(w) - rng.choice([0, 0, 3, 9])])))
    docs += [(200, docs[0][1]), (201, None), (202, "all alone"), (203, docs[0][1] + " "), (204, "all  alone")]
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1))))
    near = lambda x, y: bool(x and y) and len(x & y) / len(x | y) >= 0.8
    expected = {i: (sum(near(x, y) for j, y in sets.items() if i != j), sum(near(x, y) for y in set(sets.values()) - {x})) for i, x in sets.items()}
    assert max(n for _, n in expected.values()) > 20
    found = ngram_join.join_similar(frame(spark, docs)).collect()
    assert {r.doc_id: (r.n_links, r.n_sets) for r in found} == expected
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in found), key=str) == classes(docs)
    assert sorted(r.doc_id for r in ngram_join.keep_first(frame(spark, docs)).collect()) == sorted({c for _, c, _ in classes(docs)})


def test_classes_of_near_copies_take_linear_work(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 20)
    rng = random.Random(12)
    base = [rng.choice("abcdefghijklmnop") * 2 + str(k) for k in range(300)]
    docs = [(0, " ".join(base)), (1, " ".join(base) + " ")]
    for i in range(2, 400):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(w)))
    sent, in_tiles = [], ngram_join.in_tiles

    def counted(docs_, dealt, *how):
        sent.append(dealt.selectExpr("sum(size(tiles)) n").first().n)
        return in_tiles(docs_, dealt, *how)

    monkeypatch.setattr(ngram_join, "in_tiles", counted)
    assert [r.doc_id for r in ngram_join.keep_first(frame(spark, docs)).collect()] == [0]
    assert sum(sent) < 2 * len(docs)
    ngram_join.join_similar(frame(spark, docs)).count()
    assert sent[-1] > 10 * len(docs)


@pytest.mark.parametrize("signatures", [2, 1024])
def test_mixed_buckets(spark, monkeypatch, signatures):
    """Buckets whose leader is unlike most of the others: a low bar for buckets, so that unlike texts meet."""
    monkeypatch.setattr(ngram_join, "SIGNATURES", signatures)
    rng = random.Random(5)
    common = [f"c{k}" for k in range(150)]
    docs = []
    for i in range(150):
        own = [f"g{i % 6}w{k}" for k in range(rng.choice([40, 60, 80]))]
        w = common + own
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        docs.append((i, " ".join(w)))
    found = ngram_join.join_similar(frame(spark, docs), rows=2).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in found), key=str) == classes(docs)
    assert len({r.class_id for r in found}) > 1
    assert sorted(r.doc_id for r in ngram_join.keep_first(frame(spark, docs), rows=2).collect()) == sorted({c for _, c, _ in classes(docs)})


def test_signatures_lose_nothing():
    least = ngram_join.least_agreeing(120)
    assert 60 < least < 96
    rng = np.random.default_rng(1)
    for n in (5, 9, 50, 400):
        for _ in range(50):
            every = rng.integers(0, 1 << 63, n + n // 4, np.uint64)
            one, two = np.sort(every[: n + n // 8]), np.sort(every[n // 8 :])
            common = len(np.intersect1d(one, two))
            if common / (len(one) + len(two) - common) >= 0.8:
                assert (ngram_join.minhashes(one, 120) == ngram_join.minhashes(two, 120)).sum() >= least


def test_bands():
    bands = ngram_join.bands_for()
    assert 1 - (1 - 0.8**ngram_join.ROWS) ** bands >= ngram_join.RECALL


def weighted(text):
    return {w: n * len(w.encode()) for w, n in Counter(re.findall(r"[^\x20\x09-\x0D]+", text)).items()}


def test_fingerprints(spark):
    docs = sorted((r.doc_id, r.text) for r in queries.documents(spark, "/root/testdata/sf0.001").collect())
    rows = {r.doc_id: r for r in queries.op10_fingerprints(spark, "/root/testdata/sf0.001").collect()}
    errors = []
    for k, (i, t) in enumerate(docs):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + docs[(k + 1) % len(docs)][1][:cut]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        x, y = weighted(t), weighted(edited)
        every = set(x) | set(y)
        errors.append(rows[i].near_edited - sum(min(x.get(w, 0), y.get(w, 0)) for w in every) / max(1, sum(max(x.get(w, 0), y.get(w, 0)) for w in every)))
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < 0.06
    same = {}
    for i, t in docs:
        assert same.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_samples_estimate_the_jaccard_similarity_of_large_sets():
    """Against a plain loop of weighted sampling with draws of its own for every term; the sets have more terms than a table has rows."""
    rng = np.random.default_rng(4)
    every = rng.integers(0, 1 << 63, 24_000, np.uint64)
    for share in (0.2, 0.5, 0.8):
        cut = int(len(every) * (1 - share) / 2)
        one, two = every[: len(every) - cut], every[cut:]
        w = rng.integers(1, 60, len(every)).astype(float)
        v = np.where(rng.random(len(every)) < 0.7, w, rng.integers(1, 60, len(every)))
        exact = np.minimum(w, v)[cut : len(every) - cut].sum() / (w[:cut].sum() + np.maximum(w, v)[cut : len(every) - cut].sum() + v[len(every) - cut :].sum())
        found = [fingerprints.likeness(fingerprints.sample(one ^ salt, w[: len(one)]), fingerprints.sample(two ^ salt, v[cut:])) for salt in rng.integers(0, 1 << 63, 6, np.uint64)]
        assert abs(np.mean(found) - exact) < 0.06

    def plain(terms, weights, samples, seed):
        marks = []
        for k in range(samples):
            best = None
            for t, x in zip(terms, weights, strict=True):
                own = np.random.default_rng([seed, k, int(t)])
                r, c, b = own.standard_gamma(2.0), own.standard_gamma(2.0), own.random()
                level = math.floor(math.log(x) / r + b)
                score = math.log(c) - r * (level - b + 1)
                if best is None or score < best[0]:
                    best = score, t, level
            marks.append(best[1:])
        return marks

    one, two = {1: 3.0, 2: 9.0, 3: 1.0, 4: 7.0, 5: 2.0}, {2: 9.0, 3: 4.0, 4: 5.0, 6: 6.0}
    exact = sum(min(one.get(t, 0), two.get(t, 0)) for t in range(7)) / sum(max(one.get(t, 0), two.get(t, 0)) for t in range(7))
    a, b = plain(one, one.values(), 400, 1), plain(two, two.values(), 400, 1)
    assert abs(np.mean([x == y for x, y in zip(a, b, strict=True)]) - exact) < 0.09
    ours = []
    for salt in rng.integers(0, 1 << 63, 40, np.uint64):
        x, y = (fingerprints.sample(np.array([mixed_term(t, salt) for t in d], np.uint64), np.array(list(d.values()))) for d in (one, two))
        ours.append(fingerprints.likeness(x, y))
    assert abs(np.mean(ours) - exact) < 0.03


def mixed_term(t, salt):
    return fingerprints.mixed(np.array([t], np.uint64) ^ salt)[0]


def test_fingerprint_edges(spark):
    docs = [(3, "b c d e"), (3, "a"), (None, "x y z w"), (1, None), (9, ""), (5, "é" * 9)]
    order = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    expected = []
    for k, (i, t) in enumerate(order):
        cut = len(t) // 4
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]).encode()).hexdigest()))
    found = fingerprints.compare_edited(frame(spark, docs)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=str) == sorted(expected, key=str)
    assert fingerprints.compare_edited(frame(spark, docs).limit(0)).collect() == []
    assert [r.near_next for r in fingerprints.compare_edited(frame(spark, [(1, "a b c")])).collect()] == [1.0]
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(frame(spark, docs)).collect()}[9] == "0" * 4 * fingerprints.SAMPLES


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A small corpus that has every case, with nulls in every column."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = [(9000, None, None, None, None), (9001, "", "en", "src0", 0), (None, "only here\nonly here", None, "src1", 19), (9002, "x y z " * 3000, "en", None, 5), (9002, "x y z " * 3000, "en", None, 5)]
    docs.union(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit_on(docs, spark.read.parquet(f"{small}/labels.parquet"))
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    clean = corpus_pipeline.drop_toxic(spark, docs, small)
    assert ids(clean) == sorted((r.doc_id for r in docs.collect() if toxicity.score_text(model, r.text) < toxicity.REJECT), key=str)
    lines = corpus_pipeline.drop_lines(spark, clean, small)
    assert lines.columns == docs.columns
    assert ids(lines) == ids(clean)
    single = corpus_pipeline.drop_near_copies(spark, lines, small)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    kept = {c for _, c, _ in classes(rows)}
    assert set(ids(single)) == kept
    mixed = corpus_pipeline.mix_sources(spark, single, small)
    assert mixed.columns == docs.columns
    assert max(Counter(ids(mixed)).values()) <= 6
    done = corpus_pipeline.run(spark, small)
    assert done.count() == mixed.count()
    assert set(ids(done)) <= kept


def test_pipeline_of_an_empty_table(spark, small, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.collect() == []
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
