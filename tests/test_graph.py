"""Upkeep of the graph, templates, classes, passes of clusters and ranks on small frames."""

import random

from causeway.functions import text_features as tx
from causeway.operators import graph, learning, templates
from causeway.plans import base
from causeway.skew import ranked
from conftest import DATA
from pyspark.sql import functions as F

EDGE = "src string, dst string, kind string, weight double, evidence long, mode string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_compile(spark):
    e = spark.createDataFrame([("a", "b", "causes", 0.95, 1, "tentative"), ("a", "b", "indicates", 0.2, 0, "tentative"), ("b", "c", "causes", 0.5, 3, "compiled"), ("b", "d", "cooccurs", 0.9, 0, "tentative"), ("d", "c", "causes", 0.12, 0, "tentative"), ("x", "y", "causes", 0.05, 0, "tentative")], EDGE)
    paths = lambda *ps: spark.createDataFrame([(list(p),) for p in ps], "path array<string>")
    up = {("a", "b", "causes", 1.0, 2, "compiled"), ("a", "b", "indicates", 0.2, 0, "tentative"), ("b", "c", "causes", 0.6, 4, "compiled"), ("b", "d", "cooccurs", 0.9, 0, "tentative"), ("d", "c", "causes", 0.12, 0, "tentative"), ("x", "y", "causes", 0.05, 0, "tentative")}
    assert rows(graph.compile_paths(e, paths("abc"))) == up
    # a missing hop or kinds that do not compose change nothing; failed paths weaken, and weak tentative edges go
    assert rows(graph.compile_paths(e, paths("axc", "bdc"))) == rows(e)
    down = rows(graph.compile_paths(e, paths("abc"), paths("bdc", "dc")))
    assert down == {r for r in up if r[0] in "ab" and r[1] != "d"} | {("b", "d", "cooccurs", 0.85, 0, "tentative")}


def test_put_patch_remove(spark):
    e = spark.createDataFrame([("a", "b", "causes", 0.9, 5, "compiled"), ("b", "c", "causes", 0.9, 5, "compiled"), ("c", "d", "causes", 0.9, 5, "compiled"), ("d", "a", "causes", 0.9, 5, "compiled")], EDGE)
    new = spark.createDataFrame([("a", "b", "causes", 0.3, 1), ("a", "b", "causes", 0.4, 2), ("n", "m", "is_a", 0.7, 1), ("n", "m", "is_a", 0.8, 0)], "src string, dst string, kind string, weight double, seq int")
    put = rows(graph.put_edges(e, new))
    assert ("a", "b", "causes", 0.4, 7, "compiled") in put and ("n", "m", "is_a", 0.7, 1, "tentative") in put and len(put) == 5
    short = graph.shortcuts(e)
    assert {(s, d): h for s, d, _, h, _ in rows(short)} == {("a", "c"): 2, ("b", "d"): 2, ("c", "a"): 2, ("d", "b"): 2, ("a", "d"): 3, ("b", "a"): 3, ("c", "b"): 3, ("d", "c"): 3}
    change = spark.createDataFrame([("a", "b", "causes", None, 0.1, None), ("b", "c", "causes", None, None, "tentative")], "src string, dst string, kind string, kind2 string, weight2 double, mode2 string")
    patched, left = graph.patch_edges(e, change, short)
    assert ("a", "b", "causes", 0.1, 5, "compiled") in rows(patched) and ("b", "c", "causes", 0.9, 5, "tentative") in rows(patched)
    assert {(r["src"], r["dst"]) for r in left.collect()} == {("b", "d"), ("c", "a"), ("b", "a")}
    edges, kept, degree = graph.remove_edges(e, e.where("src = 'a'").select("src", "dst", "kind"), short)
    assert edges.count() == 3 and kept.count() == 3 and {(r["node"], r["n_out"] + r["n_in"]) for r in degree.collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 2)}


def test_paths_between(spark):
    rng = random.Random(6)
    nodes = "abcdefg"
    e = {(x, y): round(rng.uniform(0.1, 1), 3) for x in nodes for y in nodes if x != y and rng.random() < 0.4}
    df = spark.createDataFrame([(x, y, "causes", w, 1, "compiled") for (x, y), w in e.items()], EDGE)

    def walk(path, w):
        if path[-1] == "g":
            yield " > ".join(path), round(w, 9)
        elif len(path) <= 5:
            for y in nodes:
                if (path[-1], y) in e and y not in path:
                    yield from walk([*path, y], w * e[path[-1], y])

    got = graph.paths_between(df, spark.createDataFrame([("a", "g"), ("a", "a")], "start string, end string"), most=1000)
    assert rows(got.select("path", "weight")) == set(walk(["a"], 1.0))


def test_templates(spark):
    e = spark.createDataFrame([("a", "b", "causes"), ("b", "c", "causes"), ("c", "p", "is_a")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(x, "fact") for x in "abc"] + [("p", "predicate")], "node string, node_kind string")
    slots = spark.createDataFrame([("t", r, ["fact"], True, None, None) for r in ("x", "y")] + [("t", "z", ["predicate"], False, None, None), ("u", "x", ["fact"], True, None, 1), ("u", "w", ["fact"], True, None, None), ("v", "x", ["device"], True, None, None)], "template string, role string, node_kinds array<string>, required boolean, min_out int, min_in int")
    arrows = spark.createDataFrame([("t", 1, "x", "y", "causes"), ("t", 2, "y", "z", "fixes"), ("v", 1, "x", "x", "causes")], "template string, seq int, from_role string, to_role string, kind string")
    got = {(r["template"], r["bindings"]): (r["filled"], r["arrows_met"], r["score"]) for r in templates.matches(nodes, graph.degrees(e), e, slots, arrows).collect()}
    # an arrow that nothing meets costs its share, a slot of no arrow takes the first free candidate
    assert got == {("t", "x=a, y=b"): (2, 1, 0.8), ("t", "x=b, y=c"): (2, 1, 0.8), ("u", "w=a, x=b"): (2, 0, 1.0)}
    inst = spark.createDataFrame([("i", "t", {"x": "a", "y": "b"}), ("j", "t", {"x": "c", "y": "c"}), ("k", "t", {"x": "a"})], "instance string, template string, slots map<string,string>")
    inv = spark.createDataFrame([("t", "slot:x != slot:y", True), ("t", "slot:y exists", True), ("t", "ref:x->y:causes", False), ("t", "be good", True)], "template string, rule string, hard boolean")
    assert {(r["instance"], r["rule"]) for r in templates.broken(inst, inv, e).collect()} == {("j", "slot:x != slot:y"), ("j", "ref:x->y:causes"), ("k", "slot:y exists"), ("k", "ref:x->y:causes")}


def test_ranks_and_passes(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), f"k{i:04d}") for i in range(500)]
    got = {(r["g"], r["k"]): r["rank"] for r in ranked(spark.createDataFrame(data, "g string, k string").repartition(7), ["g"], ["k"]).collect()}
    assert got == {(g, k): sum(1 for h, x in data if h == g and x <= k) for g, k in data}

    sets = learning.unexplained_goals(base.observation_patterns(spark, DATA), base.rule_patterns(spark, DATA)).groupBy("observation_id").agg(F.array_sort(F.collect_set("sig")).alias("x"), F.array_sort(F.collect_set("pred")).alias("l"))
    own = {r["observation_id"]: (set(r["x"]), set(r["l"])) for r in sets.collect()}
    jac = lambda a, b: len(a & b) / len(a | b)
    want, left = {}, sorted(own)
    for n, t, like in ((1, 0.5, lambda a, b: jac(a[0], b[0])), (2, 0.6, lambda a, b: 0.7 * jac(a[0], b[0]) + 0.3 * jac(a[1], b[1]))):
        done = set()
        for k in left:
            if k in done:
                continue
            group = [o for o in left if o not in done and o != k and like(own[k], own[o]) >= t - 1e-12]
            if group:
                for o in (k, *group):
                    want[o] = (k, n)
                    done.add(o)
        left = [k for k in left if k not in done]
    want |= {k: (k, None) for k in left}
    assert {r["observation_id"]: (r["leader"], r["pass"]) for r in learning.two_passes(sets, "observation_id", "x", "l", 0.5).collect()} == want


def test_packed_chunks():
    text = "Short one. " * 30 + "\n\n" + "tiny\n\n\n" + "长句子。" * 100 + "no end"
    got = tx.packed(text)
    assert all(text[a : a + len(c)] == c and len(c) > 10 for a, c in got) and [len(c) >= 200 for _, c in got] == [True, False, True, True]
    assert tx.packed("") == [] and tx.packed("\n\n\n") == []
