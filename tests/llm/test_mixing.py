"""Mixtures reach their shares, keep their caps and repeat themselves."""

import random

import numpy as np
import pandas as pd
from causeway.llm import mixing, queries
from conftest import DATA

TARGETS = [("a", 0.5, 2), (" B", 0.3, 4), ("none", 0.2, 1)]


def corpus(spark, n=600):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(5, 60), rng.choice(["A ", "a", "b", "other", None]), rng.choice(["en", "EN", "de", None, "zh-CN"]), rng.choice(["p", "q"])) for i in range(n)] + [(n, None, "a", "en", "p"), (n + 1, "", "b", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, project string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs, targets = corpus(spark)
    mix = mixing.mixture(docs, targets)
    out = {r["source"]: r for r in mixing.shares(mix, targets).collect()}
    assert abs(out["a"]["actual_share"] - 0.625) < 0.01 and abs(out["b"]["actual_share"] - 0.375) < 0.01 and out["none"]["tokens"] == 0
    assert out["a"]["max_copies"] <= 2 and out["b"]["max_copies"] <= 4
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, mixing.mixture(docs, targets).collect()))


def test_given_total(spark):
    docs, targets = corpus(spark)
    mix = mixing.mixture(docs, targets, total=4000)
    tokens = {r["source"]: r["tokens"] for r in mixing.shares(mix, targets).collect()}
    assert abs(tokens["a"] - 2000) < 60 and abs(tokens["b"] - 1200) < 60


def test_empty(spark):
    docs, targets = corpus(spark)
    assert mixing.mixture(docs.limit(0), targets).count() == 0
    assert mixing.mixture(docs, targets.limit(0)).count() == 0


def test_raking_meets_marginals():
    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(s, lang, t, int(rng.integers(50, 5000))) for s in "abc" for lang in ("en", "de") for t in ("x", "y", "z")], columns=["source", "lang", "topic", "tokens"])
    targets = pd.DataFrame([("a", 0.2, 100), ("b", 0.3, 100), ("c", 0.5, 100)], columns=["source", "target_share", "max_repeats"])
    fit = mixing.rake(cells, targets, 10_000)
    out = fit.weights
    assert fit.converged
    size = out.weight * out.tokens
    assert np.allclose(size.groupby(out.source).sum(), [2000, 3000, 5000])
    own = cells.groupby("lang").tokens.sum() / cells.tokens.sum()
    assert np.allclose(size.groupby(out.lang).sum() / 10_000, own, atol=1e-6)


def test_many_cells_are_fitted_on_the_cluster(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cells = pd.DataFrame([(s, lang, t, int(rng.integers(50, 5000))) for s in "ab" for lang in ("en", "de") for t in ("x", "y")], columns=["source", "lang", "topic", "tokens"])
    targets = pd.DataFrame([("a", 0.4, 3), ("b", 0.6, 2), ("none", 0.1, 2)], columns=["source", "target_share", "max_repeats"])
    total = 1.5 * cells.tokens.sum()
    here = mixing.rake(cells, targets, total, 1e-4).weights.set_index(["source", "lang", "topic"]).weight
    fit = mixing.rake_on_cluster(mixing._frame(spark, cells, "source string, lang string, topic string, tokens long"), mixing._frame(spark, targets, "source string, target_share double, max_repeats int"), total)
    there = fit.weights.toPandas().set_index(["source", "lang", "topic"]).weight
    assert fit.converged and np.allclose(here.sort_index(), there.sort_index(), rtol=1e-3)
    docs, targets = corpus(spark, 60)
    monkeypatch.setattr(mixing.rake_on_cluster, "__defaults__", (1e-2, 2, 2))
    mix = mixing.mixture(docs, targets, most_cells=0)
    assert mix.where("copies > 4").count() == 0 and mix.select("source").distinct().count() == 2


def test_marginals(spark):
    docs, targets = corpus(spark)
    rows = {(r["marginal"], r["value"]): r for r in mixing.marginals(docs, targets).collect()}
    assert {k for k, _ in rows} == {"source", "lang", "topic"} and all(r["converged"] for r in rows.values())
    assert all(abs(r["expected_share"] - r["goal_share"]) < 1e-3 and abs(r["actual_share"] - r["goal_share"]) < 0.05 for r in rows.values())


def test_reference_shares(spark):
    rows = {r["source"]: r for r in queries.p9_shares(spark, DATA).collect()}
    assert len(rows) == 9 and abs(sum(r["actual_share"] for r in rows.values()) - 1) < 1e-9
    assert all(r["max_copies"] <= r["max_repeats"] for r in rows.values())


def test_the_place_of_the_fit_does_not_matter(spark):
    """A source at its cap, another that still fills up, and one whose cap is 0 with a large goal: the same weights and rounds on the driver and on the cluster."""
    cells = pd.DataFrame([("a", "en", "x", 900), ("a", "de", "x", 10), ("b", "en", "x", 40), ("b", "de", "y", 700), ("c", "en", "y", 50)], columns=["source", "lang", "topic", "tokens"])
    targets = pd.DataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("c", 0.1, 0)], columns=["source", "target_share", "max_repeats"])
    for total in (2500.0, 1e10):
        here = mixing.rake(cells, targets, total)
        there = mixing.rake_on_cluster(mixing._frame(spark, cells, "source string, lang string, topic string, tokens long"), mixing._frame(spark, targets, "source string, target_share double, max_repeats int"), total)
        a, b = (x.set_index(["source", "lang", "topic"]).weight.sort_index() for x in (here.weights, there.weights.toPandas()))
        assert here.rounds == there.rounds and here.converged == there.converged and np.isfinite(a).all() and np.allclose(a, b, rtol=1e-11, atol=0)
