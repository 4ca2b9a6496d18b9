"""Walks of a worker that holds the graph, against the joins that larger graphs take."""

import random

from causeway.operators import graph, walks
from pyspark.sql import functions as F

EDGE = "src string, dst string, kind string, weight double, evidence long, mode string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "causes", w, 5, "compiled") for (a, b), w in sorted(pairs.items())], EDGE)


def random_edges(seed, names, share, weights):
    rng = random.Random(seed)
    return {(x, y): rng.choice(weights) for x in names for y in names if x != y and rng.random() < share}


def test_heaviest_paths_make_no_others(spark):
    """A hundred million paths of equal weight lead from a to z; the fifty first by name are found without the others."""
    layers = [["a"], *[[f"{c}{i:03d}" for i in range(100)] for c in "mnop"], ["z"]]
    e = {(x, y): 1.0 for xs, ys in zip(layers, layers[1:]) for x in xs for y in ys}
    got = graph.paths_between(edges(spark, e), spark.createDataFrame([("a", "z")], "start string, end string"))
    assert rows(got) == [("a", "z", f"a > m000 > n000 > o000 > p{i:03d} > z", 1.0) for i in range(50)]


def test_heaviest_paths_as_by_joins(spark, monkeypatch):
    names = ["a", "a b", "a > b", "b", "é", "z|1", "z|10", "ß"]
    df = edges(spark, random_edges(3, names, 0.6, [1.0, 0.75, 0.3, 0.5]))
    pairs = spark.createDataFrame([("a", "b"), ("z|1", "b"), ("a > b", "é"), ("b", "b"), ("a", "missing")], "start string, end string")
    held = rows(graph.paths_between(df, pairs, most=7))
    monkeypatch.setattr(walks, "MAX_EDGES", 0)
    assert held and held == rows(graph.paths_between(df, pairs, most=7))


def test_shortcuts_as_by_joins(spark, monkeypatch):
    """Every column, with and without touched hops, on a graph with cycles, loops and names that are parts of others."""
    names = ["a", "a b", "b", "é", "z|1", "z|10", "ß", "x>", "q", "r", "s", "t"]
    e = random_edges(8, names, 0.2, [1.0, 0.75, 0.6, 0.3]) | {("q", "q"): 1.0}
    df = edges(spark, e)
    touched = spark.createDataFrame([k for k, w in sorted(e.items()) if w == 0.75], "src string, dst string")
    every = lambda: [rows(graph.shortcuts(df)), rows(graph.shortcuts(df, named=False)), rows(graph.shortcuts(df, touched=touched)), rows(graph.valid_shortcuts(graph.shortcuts(df), touched))]
    held = every()
    assert held[2] == held[3] and 0 < len(held[2]) < len(held[0])
    monkeypatch.setattr(walks, "MAX_EDGES", 0)
    assert held == every()


def test_shortcuts_of_names_that_hold_the_separator(spark, monkeypatch):
    """A name that begins another with the separator behind it orders chains otherwise than their nodes: these are joined."""
    names = ["a", "a > b", "b", "a > b > c", "c"]
    df = edges(spark, random_edges(2, names, 0.6, [1.0, 0.75]))
    got = rows(graph.shortcuts(df))
    monkeypatch.setattr(walks, "MAX_EDGES", 0)
    assert got and got == rows(graph.shortcuts(df))


def test_shortcuts_write_no_levels(spark):
    """The levels of a long chain are not written and read again, one job each: one table, of the edges, is."""
    from causeway import session

    e = {(f"n{i:02d}", f"n{i + 1:02d}"): 1.0 for i in range(30)}
    app = spark.sparkContext.applicationId
    before = len(session._scratch.get(app, []))
    got = graph.shortcuts(edges(spark, e), named=False)
    assert len(session._scratch[app]) - before == 1
    assert {(r["src"], r["dst"]): r["hops"] for r in got.collect()} == {(f"n{i:02d}", f"n{j:02d}"): j - i for i in range(31) for j in range(i + 2, 31)}


def test_legal_paths_are_validated_once_for_each_sequence_of_kinds(spark):
    """Paths carry what their kinds amount to; the plan of the result folds kinds over the distinct sequences only."""
    rng = random.Random(4)
    names, kinds = "abcdef", [k for k, *_ in graph.KINDS] + ["unknown"]
    df = spark.createDataFrame([(x, y, rng.choice(kinds[:4] + kinds), 0.5, 1, "compiled") for x in names for y in names if x != y], EDGE)
    starts = spark.createDataFrame([("a",), ("b",)], "start string")
    legal = graph.simple_paths(df, starts, 3, legal=True)
    every = graph.simple_paths(df, starts, 3).where(graph.fold_kinds(F.col("kinds"))["valid"])
    assert rows(legal) == rows(every) and legal.count()
    assert rows(graph.validated(legal).select("path", "v")) == rows(legal.select("path", graph.validate_rich(F.col("kinds")).alias("v")))
