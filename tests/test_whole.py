"""Queries on classes: every row has one, and pairs of classes give back the pairs of rows."""

from compare import assert_same
from conftest import DATA
from test_queries import QUERIES


def test_every_row_has_a_leader_or_class(spark, duck):
    """Copies of a set get the leader of their class, and pairs of classes give back the pairs of rules."""
    from causeway.operators import reasoning
    from causeway.plans.base import SQL as PRELUDE

    sets = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y"]), ("c", ["z"]), ("d", ["z"]), ("e", []), ("f", ["x", "y", "w"])], "k string, m array<string>")
    assert {tuple(r) for r in reasoning.led(sets, "k", "m", 0.6).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("f", "a")}
    led = {r["observation_id"]: r["leader"] for r in QUERIES["exp_leader_clusters"](spark, DATA).collect()}
    own = {r["observation_id"]: r["class_id"] for r in QUERIES["exp_observation_classes"](spark, DATA).collect()}
    have = {r[0] for r in duck.execute(PRELUDE + "select observation_id from observation_sets where len(preds) > 0").fetchall()}
    assert set(led) == set(own) == have and all(led[k] == led[c] for k, c in own.items())
    docs = QUERIES["txt_keyword_clusters"](spark, DATA)
    assert docs.count() == QUERIES["txt_tfidf"](spark, DATA).where("tfidf > 0").select("doc_id").distinct().count()
    vectors = {}
    for r in QUERIES["txt_tfidf"](spark, DATA).where("tfidf > 0").collect():
        vectors.setdefault(r["doc_id"], {})[r["word"]] = r["tfidf"]
    size = {k: sum(x * x for x in v.values()) ** 0.5 for k, v in vectors.items()}
    lead = {}
    for k in sorted(vectors):
        alike = (l for l in sorted(lead) if lead[l] == l and sum(x * vectors[l].get(w, 0) for w, x in vectors[k].items()) / size[k] / size[l] >= 0.3 - 1e-9)
        lead[k] = next(alike, k)
    assert {r["doc_id"]: r["leader"] for r in docs.collect()} == lead

    m, p = QUERIES["agg_conflict_classes"](spark, DATA).collect(), QUERIES["agg_conflicting_rules"](spark, DATA).collect()
    by = {}
    for r in m:
        by.setdefault((r["class_id"], r["pred"]), []).append((r["regulation_id"], r["val"]))
    got = {(*sorted((x, y)), q["pred"]) for q in p for x, v in by[q["left_id"], q["pred"]] for y, w in by[q["right_id"], q["pred"]] if x != y and v != w}
    want = duck.execute(PRELUDE + """, e as (select distinct regulation_id id, pred, val, pre_preds from rule_facts join rule_sets using (regulation_id) where side = 'eff' and val is not null and len(pre_preds) > 0)
    select distinct a.id, b.id, a.pred from e a join e b on a.id < b.id and a.pred = b.pred and a.val <> b.val where len(list_intersect(a.pre_preds, b.pre_preds)) / len(list_distinct(list_concat(a.pre_preds, b.pre_preds))) >= 0.3""").fetchall()
    assert got == {tuple(r) for r in want}
