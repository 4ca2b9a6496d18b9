"""Queries that meet only what can be in their result: same results, fewer pairs."""

from compare import assert_same
from conftest import DATA
from test_queries import QUERIES, SQL

from causeway.operators import reasoning


def test_causes_are_searched_by_bounds(spark, duck, monkeypatch):
    """Only rules that can be among an observation's ten are scored."""
    asked, plain = [], reasoning.best_by_preds
    monkeypatch.setattr(reasoning, "best_by_preds", lambda o, p, n: asked.append((n, set(p.columns))) or plain(o, p, n))
    assert_same(QUERIES["exp_suggest_causes"](spark, DATA), duck.execute(SQL["exp_suggest_causes"]).df())
    assert [n for n, _ in asked] == [10] and {"sure", "late"} <= asked[0][1]
