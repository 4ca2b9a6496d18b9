"""The best rules of each observation, found without meeting all rules."""

import random

from causeway.operators import reasoning


def test_best_candidates_are_those_of_all(spark):
    """Bounds leave out nothing: ties, rules of effects only and observations with fewer than n candidates included."""
    rng = random.Random(8)
    preds = "abcdefgh"
    sets = spark.createDataFrame([(f"o{i:03d}", sorted(rng.sample(preds + "z", rng.randrange(1, 7)))) for i in range(80)] + [("none", ["z"]), ("empty", [])], "observation_id string, preds array<string>")
    rules = [(f"r{i:03d}", rng.choice([0, 0, 3, 9, 30]), rng.randrange(3)) for i in range(120)]
    items = {(r, side, p, f"{p}|{rng.randrange(3)}") for r, _, _ in rules for side in ("pre", "eff") for p in rng.choices(preds[: rng.choice([2, 8])], k=rng.randrange(4))}
    items, rules = spark.createDataFrame(list(items), "regulation_id string, side string, pred string, sig string"), spark.createDataFrame(rules, "regulation_id string, s long, c long")
    every = {}
    for r in reasoning.candidates(sets, items, rules).collect():
        every.setdefault(r["observation_id"], []).append((-r["confidence"], r["regulation_id"], r["missing"]))
    for n, few in ((1, items), (5, items), (5, items.where("regulation_id < 'r006'"))):
        keep = {r[0] for r in few.select("regulation_id").distinct().collect()}
        want = {(o, i + 1, *c) for o, cs in every.items() for i, c in enumerate(sorted(c for c in cs if c[1] in keep)[:n])}
        got = {(r["observation_id"], r["rank"], -r["confidence"], r["regulation_id"], r["missing"]) for r in reasoning.best_candidates(sets, few, rules, n).collect()}
        assert want and got == want, (n, sorted(got - want)[:4], sorted(want - got)[:4])
