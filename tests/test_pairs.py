"""Counts and pairs that are found without meeting all pairs, against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from causeway.operators import facts as fx
from causeway.operators import reasoning


def test_containing_counts_without_pairs(spark):
    """Keys with few members by their subsets, with many by the rarest member; needs that none holds have no row."""
    rng = random.Random(3)
    sets = {f"k{i:03d}": set(rng.sample("abcdefghijklmnop", rng.choice([1, 2, 3, 5, 12, 14]))) for i in range(150)}
    needs = sorted({tuple(sorted(rng.sample("abcdefghijklmnopz", rng.randrange(1, 5)))) for _ in range(80)})
    members = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "key string, sig string")
    got = fx.containing(spark.createDataFrame([(list(n),) for n in [*needs, (), needs[0]]], "need array<string>"), members, low=F.col("key") < "k050").collect()
    want = {(n, sum(set(n) <= v for v in sets.values()), sum(set(n) <= v for k, v in sets.items() if k < "k050")) for n in needs}
    assert {(tuple(r["need"]), r["n"], r["low"]) for r in got} == {w for w in want if w[1]} and len(got) == len({tuple(r["need"]) for r in got})


@pytest.mark.parametrize("least", [0.3, 0.5, 0.6, 0.8, 1.0])
def test_similar_pairs_of_all_sizes(spark, least):
    """Pairs that differ by one member are found by equality, others by rare members; together all, each once."""
    rng = random.Random(5)
    sets = sorted({tuple(sorted(rng.sample("abcdefghijkl", rng.randrange(1, 13)))) for _ in range(220)})
    rows = [(f"s{i:03d}", list(s)) for i, s in enumerate(sets)]
    got = sorted(tuple(r) for r in reasoning.similar_pairs(spark.createDataFrame(rows, "k string, m array<string>"), "k", "m", least).collect())
    share = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    assert got == [(a, b, round(share(x, y), 9)) for (a, x), (b, y) in combinations(rows, 2) if share(x, y) >= least - 1e-12]


def test_first_compositions_are_those_of_all(spark):
    """The first compositions come from the first rules, as many as are needed, and are the first of all."""
    rng = random.Random(6)
    rules = [(f"r{i}", sorted(rng.sample("abcdef", rng.randrange(3))), sorted(rng.sample("cdefgh", rng.randrange(3))), i) for i in range(60)]
    t = spark.createDataFrame(rules, "regulation_id string, pre array<string>, eff array<string>, s long")
    have, best = {(";".join(p), ";".join(e)) for _, p, e, _ in rules}, {}
    for r in reasoning.chain_compositions(t).collect():
        if (r["pre"], r["eff"]) not in have:
            best.setdefault((r["pre"], r["eff"]), []).append(f"{r['first']}>{r['second']}")
    want = sorted((min(c), *k) for k, c in best.items())
    for n in (5, 10_000):
        assert [(r["chain"], r["pre"], r["eff"]) for r in reasoning.first_compositions(t, n, block=2).collect()] == want[:n]


@pytest.mark.parametrize("often", [2, 64])
def test_leaders_of_vectors_in_blocks(spark, monkeypatch, often):
    """Greedy leaders by cosine, in one block or several, are those of comparing with every leader; only pairs within a block are listed."""
    rng = random.Random(7)
    vectors = {f"d{i:03d}": {m: rng.choice([0.1, 0.5, 1.0, 3.0]) for m in rng.sample("abcdefghijklmnopqrstuvw", rng.randrange(1, 6))} | {f"own{i}": rng.choice([0.2, 2.0])} for i in range(120)}
    vectors |= {f"e{i:03d}": {"z": 1.0 + i / 100, f"own{i}": 0.1} for i in range(40)} | {"zero": {"a": 0.0}}
    size = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in vectors.items()}
    want = {}
    for k in sorted(vectors):
        alike = (l for l in sorted(want) if want[l] == l and size[k] * size[l] and sum(x * vectors[l].get(m, 0) for m, x in vectors[k].items()) / size[k] / size[l] >= 0.3 - 1e-9)
        want[k] = next(alike, k)
    rows = spark.createDataFrame([(k, m, x) for k, v in vectors.items() for m, x in v.items()], "k string, m string, x double")
    listed, plain = [], reasoning.leader_clusters
    monkeypatch.setattr(reasoning, "_OFTEN", often)
    monkeypatch.setattr(reasoning, "leader_clusters", lambda p, *a: listed.append(p.distinct().count()) or plain(p, *a))
    for block in (1000, 20):
        assert {tuple(r) for r in reasoning.cosine_leaders(rows, "k", "m", "x", 0.3, block=block).collect()} == set(want.items())
    assert len(listed) > 2 and sum(listed[1:]) < listed[0]
