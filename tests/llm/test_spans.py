"""Shared spans against brute force over all windows."""

import random
from collections import defaultdict

import numpy as np
from causeway.llm import queries, spans
from compare import assert_same
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(texts, span):
    where = defaultdict(set)
    for d, t in texts:
        for i in range(len(t or "") - span + 1):
            where[t[i : i + span]].add(d)
    out = defaultdict(set)
    for d, t in texts:
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                out[d] |= set(range(i, i + span))
    return {d: len(s) for d, s in out.items()}


def found(spark, texts, **kw):
    df = spark.createDataFrame([(d, t, "clash") for d, t in texts], "doc_id long, text string, doc string")
    return {r["doc"]: r["shared_chars"] for r in spans.shared_chars(spans.passages(df, **kw)).collect()}


def noise(rng, n, alphabet="abcdefgh "):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_against_sql(spark, duck):
    assert_same(queries.p10_found(spark, DATA), duck.execute(queries.P10_FOUND).df())


def test_edges_of_passages(spark):
    rng = random.Random(7)
    base = noise(rng, 600)
    texts = [(0, base)]
    for i in range(1, 40):
        a = rng.randrange(0, 400)
        n = rng.choice([158, 159, 160, 161, 175, 200])
        texts.append((i, noise(rng, rng.randrange(60)) + base[a : a + n] + noise(rng, rng.randrange(60))))
    assert found(spark, texts) == brute(texts, 160)


def test_small_spans_many_shapes(spark):
    rng = random.Random(11)
    pool = [noise(rng, rng.randrange(5, 40), "abc") for _ in range(12)]
    texts = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    assert found(spark, texts, span=20, seed=8) == brute(texts, 20)


def test_odd_texts(spark):
    t = noise(random.Random(1), 300)
    texts = [(1, None), (2, ""), (3, "a" * 500), (4, "a" * 700), (5, "b" * 900), (6, t + t), (7, t[:159]), (8, t[20:200]), (9, t[20:200]), (10, "🙂校" * 120), (11, "x🙂校" + "🙂校" * 100)]
    assert found(spark, texts) == brute(texts, 160)


def test_blocks_of_windows_elect_alike(monkeypatch):
    """Texts longer than a block have the segments of one block."""
    rng = random.Random(5)
    texts = [noise(rng, n) for n in (1000, 30, 161, 160, 159, 700)] + ["a" * 400, "ab" * 300]
    points, ends = spans.code_points("".join(texts)), np.cumsum([len(t) for t in texts])
    whole = spans.elected(points, ends)
    for size in (1, 7, 100, 333):
        monkeypatch.setattr(spans, "_BLOCK_WINDOWS", size)
        assert all((x == y).all() for x, y in zip(whole, spans.elected(points, ends), strict=True))
    monkeypatch.undo()
    n = (1 << spans._POSITION_BITS) + 500  # positions beyond the low bits
    far = np.r_[np.arange(n, dtype=np.uint32) % 1009, spans.code_points(texts[0])]
    h, key, text, start, size = spans.elected(far, np.array([len(far)]))
    h1, *_ = spans.elected(spans.code_points(texts[0]), np.array([1000]))
    assert set(h1.tolist()) <= set(h[start >= n - 160].tolist()) and start.max() > n


def test_members_are_all_partners(spark):
    """Two documents are in a passage together exactly if they share a span, and the passages cover what is shared."""
    rng = random.Random(8)
    pool = [noise(rng, rng.randrange(5, 40), "abc") for _ in range(8)]
    texts = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 6)))) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = spans.shared_members(df, span=20, seed=8).collect()
    by, cover = defaultdict(set), defaultdict(set)
    for r in rows:
        by[r["passage"]].add(r["doc"])
        cover[r["doc"]] |= set(range(r["start"], r["start"] + r["length"]))
    got = {(a, b) for docs in by.values() for a in docs for b in docs if a < b}
    grams = {d: {t[i : i + 20] for i in range(len(t) - 19)} for d, t in texts}
    assert got == {(a, b) for a in grams for b in grams if a < b and grams[a] & grams[b]}
    assert {d: len(c) for d, c in cover.items()} == brute(texts, 20)


def test_repeats_within_a_document_and_empty(spark):
    t = noise(random.Random(2), 400)
    assert found(spark, [(1, t + "--" + t)]) == {}
    assert found(spark, [(1, t), (1, t)]) == {}
    assert found(spark, []) == {}


def test_long_text(spark):
    rng = random.Random(3)
    big, part = noise(rng, 300_000), noise(rng, 500)
    texts = [(1, big[:150_000] + part + big[150_000:]), (2, "q" + part), (3, big[1000:1400])]
    assert found(spark, texts) == {1: 900, 2: 500, 3: 400}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 20)), max_size=25))
def test_chains_hold_every_match_once_in_order(ms):
    out = spans.chains(sorted(set(ms)))
    assert sorted(m for c in out for m in c) == sorted(set(ms))
    for c in out:
        assert all(p[0] < n[0] and p[1] < n[1] for p, n in zip(c, c[1:]))


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=15), st.text("abc", max_size=15))
def test_edits(x, y):
    d = [[max(i, j) if not i * j else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
    assert spans.edits(x, y) == d[-1][-1]


def test_fuzzy_passage(spark):
    rng = random.Random(9)
    a, b = noise(rng, 300), noise(rng, 300)
    df = spark.createDataFrame([(1, a + "ONE" + b), (2, a + "two!" + b)], "doc_id long, text string")
    rows = [r for r in spans.passages(df).collect() if r["doc"] == 1]
    assert len(rows) == 1 and len(rows[0]["blocks"]) == 2 and rows[0]["edits"] == 4 and rows[0]["identity"] > 0.99
