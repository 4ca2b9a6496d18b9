"""Order-free comparison of a Spark result with a DuckDB result."""

from collections import Counter

import pandas as pd


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return str(x)


def rows(pdf):
    cols = sorted(pdf.columns)
    return Counter(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r) for r in pdf[cols].itertuples(index=False))


def assert_same(spark_df, duck_df):
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(duck_df.columns)
    a, b = rows(got), rows(duck_df)
    assert a == b, f"only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
