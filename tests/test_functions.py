"""Column functions on small frames."""

import pytest
from causeway.functions import text_features as tx
from causeway.operators import audit, reasoning, stores
from causeway.operators import facts as fx
from causeway.operators import graph
from pyspark.sql import functions as F


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def mp(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,string>") if d else F.create_map().cast("map<string,string>")


@pytest.mark.parametrize(
    "pattern,args,fits",
    [({}, {}, True), ({"a": "*"}, {"a": "1"}, True), ({"a": "*"}, {}, False), ({"a": "1"}, {"a": "2"}, False), ({"a": "?x", "b": "?x"}, {"a": "1", "b": "1"}, True), ({"a": "?x", "b": "?x"}, {"a": "1", "b": "2"}, False), ({"a": "1"}, {"a": "1", "c": "3"}, True)],
)
def test_args_unify(spark, pattern, args, fits):
    assert one(spark, fx.args_unify(mp(pattern), mp(args))) is fits


def test_substitute_and_signature(spark):
    assert one(spark, fx.substitute(mp({"a": "?x", "b": "c"}), mp({"?x": "7"}))) == {"a": "7", "b": "c"}
    assert one(spark, fx.signature(F.lit("p"), F.lit("1"), mp({"b": "2", "a": "1"}))) == "p|a:1,b:2|1"
    assert one(spark, fx.signature(F.lit("p"), F.lit("1"), mp({}))) == "p|1"


def scope(env=None, stack=None, begin=None, end=None):
    s = F.array(*[F.lit(x) for x in stack]) if stack else F.lit(None).cast("array<string>")
    return F.struct(F.lit(env).cast("string").alias("env"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("project"), s.cast("array<string>").alias("stack"), F.lit(begin).cast("date").alias("time_from"), F.lit(end).cast("date").alias("time_to"))


def test_scopes(spark):
    wide, narrow, other = scope("prod", ["a", "b"], "2025-01-01", None), scope("prod", ["a"], "2025-02-01", "2025-03-01"), scope("test", ["c"], "2026-01-01", None)
    assert one(spark, fx.scope_contains(wide, narrow)) and not one(spark, fx.scope_contains(narrow, wide))
    assert one(spark, fx.scopes_overlap(wide, narrow)) and not one(spark, fx.scopes_overlap(narrow, other))
    m = one(spark, fx.merge_scopes(wide, narrow))
    assert m["env"] == "prod" and m["stack"] == ["a", "b"] and str(m["time_from"]) == "2025-01-01" and m["time_to"] is None
    assert one(spark, fx.common_entries(F.array(mp({"a": "1", "b": "2"}), mp({"a": "1", "b": "3"})))) == {"a": "1"}


@pytest.mark.parametrize("kinds,want", [(["causes"], ("causes", "direct")), (["is_a", "is_a", "causes"], ("causes", "inherit")), (["indicates", "causes"], None), ([], None), (["fixes", "fixes"], None), (["similar_to", "similar_to", "fixes"], ("fixes", "weak"))])
def test_fold_kinds(spark, kinds, want):
    arr = F.array(*[F.lit(k) for k in kinds]).cast("array<string>")
    r = one(spark, graph.fold_kinds(arr))
    assert (r["valid"], (r["result"], r["mode"])) == (want is not None, want or (None, None))


def test_text_likeness(spark):
    lit = F.lit
    assert one(spark, tx.edit_ratio(lit(""), lit(""))) == 100 and one(spark, tx.edit_ratio(lit("abcd"), lit("abcf"))) == 75
    assert one(spark, tx.token_set_ratio(lit("kiln slow step"), lit("step slow kiln"))) == 100
    assert one(spark, tx.partial_ratio(lit("slow"), lit("kiln slow step"))) == 100 and one(spark, tx.partial_ratio(lit(""), lit("abc"))) == 0
    assert one(spark, tx.tokens(F.lit(None).cast("string"))) == [] and one(spark, tx.canonical(lit("B, a! 校验 a"))) == "a a b 校验"


def test_similar_pairs_brute(spark):
    import random

    rng = random.Random(1)
    sets = {f"k{i:02d}": sorted(rng.sample("abcdefghij", rng.randrange(0, 9))) for i in range(80)}
    df = spark.createDataFrame(list(sets.items()), "k string, m array<string>")
    reps = {}
    for k, v in sorted(sets.items()):
        if v:
            reps.setdefault(tuple(v), k)
    want = {(a, b) for x, a in reps.items() for y, b in reps.items() if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.7}
    got = {(r["a"], r["b"]) for r in reasoning.similar_pairs(df, "k", "m", 0.7).collect()}
    assert got == want
    pairs = spark.createDataFrame([(a, b, 1.0) for a, b in want] or [("", "", 0.0)], "a string, b string, similarity double").where("a <> ''")
    leaders, lead = {r["k"]: r["leader"] for r in reasoning.leader_clusters(pairs, spark.createDataFrame([(v,) for v in reps.values()], "k string"), "k").collect()}, {}
    for k in sorted(reps.values()):
        first = min((l for l in lead if lead[l] == l and ((l, k) in want)), default=None)
        lead[k] = first or k
    assert leaders == lead


def test_store_and_audit(spark, tmp_path):
    s = stores.ObjectStore(spark, str(tmp_path / "s"), "id", "seq")
    s.save(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), (None, 1, "x")], "id string, seq int, v string"))
    s.save(spark.createDataFrame([("a", 2, "y")], "id string, seq int, v string"))
    assert s.get("a").first()["v"] == "y" and [r["id"] for r in s.list_by("v", "x").collect()] == ["b"] and s.stats("v").count() == 2
    t = spark.createDataFrame([("a", ["p", " Q.json "], "ok"), ("b", None, ""), (None, ["zz"], None)], "id string, refs array<string>, status string")
    p = spark.createDataFrame([("p",), ("Q",)], "id string")
    checks = (audit.Refers("ref", "t", "refs", "p"), audit.Filled("empty", "t", "refs"), audit.OneOf("status", "t", "status", ("ok",)), audit.Referred("lone", "p", "id", "t", "status"))
    got = {tuple(r) for r in audit.findings({"t": t, "p": p}, checks).collect()}
    assert got == {("t", "b", "empty", "refs"), ("t", "b", "status", "status"), ("p", "p", "lone", "id"), ("p", "Q", "lone", "id")}
