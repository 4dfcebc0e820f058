"""Exact dedup, personal data, line dedup and mixing."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from scriptorium.llm import exact_dedup, line_dedup, mixing, pii

SPACE = re.compile(r"[\x20\x09-\x0D]")


def frame(spark, docs, extra=""):
    return spark.createDataFrame(docs, "doc_id long, text string" + extra).repartition(3)


def test_exact(spark):
    docs = [(5, "a b"), (2, "ab"), (3, "a  b "), (1, "a b "), (4, "é"), (9, "é\n"), (7, None), (8, ""), (6, " "), (None, "a   b"), (10, "x y"), (11, "xy")]
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, [(*d, "x") for d in docs], ", digest string")).collect()}
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    for i, t in docs:
        norm = SPACE.sub("", t or "")
        keep = min(groups[norm])[-1]
        assert tuple(found[i]) == (i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.exact_dedup(frame(spark, docs).limit(0)).collect() == []


def test_repeated_rows_share_a_decision(spark):
    rows = exact_dedup.exact_dedup(frame(spark, [(1, "a"), (1, "a"), (2, "a")])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == [(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False)]


def test_repeated_ids_with_other_texts(spark):
    docs = [(1, "a b c"), (1, "abc"), (2, "ab c"), (None, "x"), (None, "x "), (3, "y z"), (3, " yz"), (3, "yz ")]
    rows = exact_dedup.exact_dedup(frame(spark, docs)).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id in (1, 2)) == [("1", 1, 3, False), ("1", 1, 3, True), ("2", 1, 3, False)]
    assert sum(r.kept for r in rows) == 3
    assert exact_dedup.exact_dedup(spark.createDataFrame([("b", "t"), ("a", "t")], "doc_id string, text string")).where("kept").first().doc_id == "a"


@pytest.mark.parametrize("runs", [1, 2, 5, 32])
def test_runs_merge_to_one(spark, runs):
    rng = random.Random(3)
    docs = [(i, " " * rng.randint(0, 3) + "t" + str(rng.randint(0, 40)) * (i % 3 > 0)) for i in range(400)]
    best = {}
    for i, t in docs:
        best[t.strip()] = min(best.get(t.strip(), (1, 0)), (-len(t), i))
    rows = exact_dedup.merge_runs(exact_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)), runs).collect()
    assert sorted((r.digest, r.best.id) for r in rows) == sorted((hashlib.sha256(t.encode()).hexdigest(), i) for t, (_, i) in best.items())
    assert sum(r.n for r in rows) == len(docs)


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def test_personal_data(spark):
    rng = random.Random(5)
    parts = ["a", "b.", "@", ".", "0", "1", "9", "255", "-", " ", "+", "(", ")", "_", "é", "\U0001f600", "4111 1111 1111 1111", "4111111111111111", " card ", "\n", "1.2.3.4", "+1 (555) 123", "%", "x@y.zz"]
    docs = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(800)]
    docs += [(5000, None), (5001, "1 2 3 " * 2000), (5002, "a" * 50_000), (5003, "+1" * 3000 + "(" * 3000)]
    texts = dict(docs)
    for row in pii.find_pii(frame(spark, [(*d, 1) for d in docs], ", found int")).collect():
        got = [(s.kind, s.start, s.end) for s in row.found if s.kind in ("email", "ip", "card", "phone")]
        assert got == [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, texts[row.doc_id] or "") if ok(m.group())]
    assert pii.find_pii(frame(spark, docs).limit(0)).collect() == []


def test_added_kinds(spark):
    docs = [(1, "IBAN GB82 WEST 1234 5698 7654 32."), (2, "GB83 WEST 1234 5698 7654 32"), (3, "her ssn is 078-05-1120"), (4, "078-05-1120"), (5, "call (212) 555-0100 now"), (6, "card 378282246310005")]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.find_pii(frame(spark, docs)).collect()}
    assert found == {1: [("iban", 5, 32)], 2: [], 3: [("ssn", 11, 22)], 4: [], 5: [("local_phone", 5, 19)], 6: [("short_card", 5, 20)]}


def test_ibans_in_running_text(spark):
    gb, de, no = "GB29NWBK60161331926819", "DE89370400440532013000", "NO93 8601 1117 947"
    texts = [f"account {gb} Please pay", f"iban {de} 12 items", f"{de} BIC COBADEFF", f"{gb} I", f"{gb} {de} {no}", f"AB12 {gb} X", f"{no} 1A", f"{gb}x", f"{gb}7", f"x{gb}", f"{de[:-1]}1 Ok", "ZZ68 1234 5678 901 A", "AB12 " * 4000]
    found = {r.doc_id: r.found for r in pii.find_pii(frame(spark, list(enumerate(texts)))).collect()}
    got = [[texts[i][s.start : s.end] for s in found[i] if s.kind == "iban"] for i in range(len(texts))]
    assert got[:11] == [[gb], [de], [de], [gb], [gb, de, no], [gb], [no], [], [], [], []]


def test_time_is_linear_in_the_matches_of_a_text(spark):
    text = "".join(f"é{'call ' * (i % 7 == 0)}a{i}@b.de" + " " * (i % 90 == 0) for i in range(100_000))
    numbers = " ".join(f"+49 {i:08d}" + ", phone" * (i % 5 == 0) for i in range(40_000))
    ibans = "AB12 " * 60_000 + "GB29NWBK60161331926819 x"
    rows = {r.doc_id: r.found for r in pii.find_pii(frame(spark, [(1, text), (2, numbers), (3, ibans)])).collect()}
    pattern = re.compile(BASE[0][1])
    assert [(x.start, x.end) for x in rows[1] if x.kind == "email"] == [m.span() for m in pattern.finditer(text)]
    phones = [x for x in rows[2] if x.kind == "phone"]
    good = [m for m in re.finditer(BASE[3][1], numbers) if BASE[3][2](m.group())]
    assert [(x.start, x.end) for x in phones] == [m.span() for m in good]
    heard = [bool(re.search(r"phone|\btel\b|call|mobile|fax", numbers[max(m.start() - 48, 0) : m.start()].lower())) for m in good]
    assert [x.score > 0.7 for x in phones] == heard
    assert [ibans[x.start : x.end] for x in rows[3] if x.kind == "iban"] == ["GB29NWBK60161331926819"]


def test_mask(spark):
    docs = [(1, "to a.b@c.de, é 1.2.3.4!"), (2, None), (3, "300.1.1.1 plain")]
    assert {r.doc_id: r.text for r in pii.mask_pii(frame(spark, docs)).collect()} == {1: "to [email], é [ip]!", 2: None, 3: "300.1.1.1 plain"}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def gone_lines(docs):
    places = []
    for i, t in docs:
        for no, line in enumerate([] if t is None else t.split("\n")):
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower()
            if norm:
                places.append(((i is None, i or 0, no), norm, i, t))
    first = {}
    for place, norm, _, _ in places:
        first[norm] = min(first.get(norm, place), place)
    near = {a for a in first for b in first if len(a) >= 20 and len(b) >= 20 and first[b] < first[a] and one_edit(a, b)}
    gone = defaultdict(set)
    for place, norm, i, t in places:
        if norm in near or place > first[norm]:
            gone[i, t].add(place[2])
    return gone


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(3)
    base = ["".join(rng.choice("abc é") for _ in range(n)) for n in (3, 19, 20, 21, 32, 33, 63, 64, 65, 66, 200)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k, r = rng.randrange(len(line) + 1), rng.random()
                if r < 0.3:
                    line.insert(k, rng.choice("abcX"))
                elif k < len(line):
                    line[k : k + 1] = [rng.choice("abcX")] if r > 0.6 or len(line) == 1 else []
            lines.append("".join(line))
        docs.append((i, "\n".join(lines)))
    return [*docs, (500, None), (501, ""), (502, "\n\n"), (None, docs[3][1]), (7, docs[9][1])]


def test_lines(spark, lined):
    gone = gone_lines(lined)
    found = line_dedup.line_report(frame(spark, [(*d, 1) for d in lined], ", no int")).collect()
    expected = [(i, 0 if t is None else len(t.split("\n")), len(gone[i, t]), ",".join(map(str, sorted(gone[i, t])))) for i, t in lined]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    texts = [(r.doc_id, r.text, r.no) for r in line_dedup.dedup_lines(frame(spark, [(*d, 1) for d in lined], ", no int")).collect()]
    kept = [(i, t if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if no not in gone[i, t]), 1) for i, t in lined]
    assert sorted(texts, key=str) == sorted(kept, key=str)
    assert line_dedup.line_report(frame(spark, lined).limit(0)).collect() == []


def test_short_lines_too(spark):
    docs = [(1, "abcd\nxy"), (2, "abxd\nxyz\nq")]
    rows = line_dedup.line_report(frame(spark, docs), least_chars=2).collect()
    assert {r.doc_id: r.removed for r in rows} == {1: "", 2: "0,1"}
    assert {r.removed for r in line_dedup.line_report(frame(spark, docs)).collect()} == {""}


def shares(sizes):
    """Sharing by weight, with resharing round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, full = dict.fromkeys(names, 0.0), set()
    while True:
        rest = sum(sizes.values()) - sum(target[s] for s in full)
        open_ = [s for s in names if s not in full]
        for s in open_:
            target[s] = rest * weight[s] / sum(weight[x] for x in open_)
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over
        target |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [7, 1024])
def test_mixing(spark, block):
    rng = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 90))), rng.choice(["a", "é", "b", "zz", "tiny" if i < 2 else "a", None])) for i in range(300)]
    docs += [(5, "x y", "a"), (None, "q r s", "b"), (900, None, "none"), (901, "", "a")]
    rows = mixing.mix(spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, source string, size int, key string").repartition(3), block_words=block).collect()
    sizes, source, taken = defaultdict(int), {}, defaultdict(int)
    for i, t, s in docs:
        sizes[s] += len((t or "").split())
        source.setdefault((i, len((t or "").split())), s)
    target = shares(sizes)
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id, r.size]
        assert (r.source_size, r.target) == (sizes[s], pytest.approx(target[s]))
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert dict(taken) == {s: round(t) for s, t in target.items()}


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(i, "a b c d", s) for i, s in enumerate(["x"] * 9 + ["y"])] + [(99, None, "x")], "doc_id long, text string, source string")
    rows = mixing.mixed(docs, block_words=4).collect()
    assert sum(r.source == "y" for r in rows) == 3
    assert 7 <= len(rows) - 3 <= 8
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_rows_come_in_slot_order(spark):
    docs = [(i, f"a b c {s}{i}", s) for s, n in (("x", 40), ("y", 30), ("z", 2)) for i in range(n)]
    rows = mixing.mixed(spark.createDataFrame([(*d, "k", 5) for d in docs], "doc_id long, text string, source string, _own0 string, _times int"), block_words=4).collect()
    assert {(r["_own0"], r["_times"]) for r in rows} == {("k", 5)}
    target = shares({"x": 160, "y": 120, "z": 8})
    edges, total = [], sum(target.values())
    for s in "xyz":
        edges.append((s, sum(target[k] for k in "xyz" if k <= s) / total))
    dealt = [next(s for s, z in edges if (i * mixing.PHI) % 1 < z) for i in range(72)]
    got = [r.source for r in rows]
    assert abs(len(got) - 72) <= 2
    assert got[:60] == dealt[:60]
    mixed = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_words=4).collect()
    assert all(dealt[k] == next(s for _, t, s in docs if hash_of(spark, t) == r.mark) for r in mixed for k in r.slots if k < 60)
    assert all((r.first_slot is None) == (r.taken == 0) for r in mixed)


def hash_of(spark, text, known={}):  # noqa: B006
    if text not in known:
        known[text] = spark.sql("SELECT xxhash64(:t) AS h", {"t": text}).first().h
    return known[text]


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "line one here\nother", 7, 8, "p"), (2, "line one here", 7, 8, "p")], "doc_id long, text string, _mark int, _own2 int, _gone string")
    rows = line_dedup.dedup_lines(docs).collect()
    assert sorted(map(tuple, rows)) == [(1, "line one here\nother", 7, 8, "p"), (2, "", 7, 8, "p")]


def test_repeated_rows_are_all_taken(spark):
    docs = spark.createDataFrame([(7, "a b c d", "x")] * 9 + [(None, "a b c d", "x")] * 3 + [(i, "a b c d", "y") for i in range(1, 6)], "doc_id long, text string, source string")
    wanted = defaultdict(int)
    for r in mixing.mix(docs, block_words=4).collect():
        wanted[r.doc_id] += round(r.taken / r.size)
    got = defaultdict(int)
    for r in mixing.mixed(docs, block_words=4).collect():
        got[r.doc_id] += 1
    assert 0 < wanted[7] < 9
    assert {i: n for i, n in wanted.items() if n} == dict(got)


def test_golden_points_are_even(spark):
    from pyspark.sql import functions as F

    points = sorted(r.u for r in spark.range(1 << 21, (1 << 21) + 1000).select(mixing.golden(F.col("id")).alias("u")).collect())
    assert max(b - a for a, b in zip(points, points[1:], strict=False)) < 0.004
