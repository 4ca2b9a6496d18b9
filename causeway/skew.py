"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.session import materialize

#: The most keys that are treated as hot; every other key holds less than 1 / HOT_KEYS of the rows.
HOT_KEYS = 512
#: Below this many rows a key is never worth splitting.
HOT_ROWS = 50_000
SALTS = 32


def hot_keys(df: DataFrame, keys: list[str], most: int = HOT_KEYS, least: int = HOT_ROWS) -> DataFrame:
    """The keys with the most rows, if `least` or more: at most `most` of them.

    Counts are combined before the shuffle, and the result has at most `most`
    rows whatever the size of df, which is what makes broadcasting it safe.
    """
    counts = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("__n"))
    return counts.where(F.col("__n") >= least).orderBy(F.desc("__n"), *keys).limit(most).select(*keys)


def hot_of_counts(counts: DataFrame, keys: list[str], n: str, most: int = HOT_KEYS, least: int = HOT_ROWS) -> DataFrame:
    """hot_keys() from counts that are known already: rows of keys with their number in column n."""
    return counts.where(F.col(n) >= least).orderBy(F.desc(n), *keys).limit(most).select(*keys)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS, hot: DataFrame | None = None) -> DataFrame:
    """left join right on keys, where keys are unique or nearly so on the right.

    Rows of left with a hot key are spread over `salts` partitions and the few
    matching rows of right are repeated for each; all other rows join as usual.
    how: inner, left or leftsemi. Result: the columns of left, then those of
    right that are no keys (none for leftsemi). Null keys never match. hot: the
    hot keys, at most HOT_KEYS, where counts made before give them.
    """
    hot = F.broadcast((hot_keys(left, keys) if hot is None else hot).withColumn("__hot", F.lit(True)))
    mark = lambda df: df.join(hot, keys, "left")
    salted_left = mark(left).withColumn(
        "__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in _plain(left)]), F.lit(salts)).cast("int")).otherwise(0)
    )
    salted_right = mark(right).withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    out = salted_left.drop("__hot").join(salted_right.drop("__hot"), [*keys, "__salt"], how)
    rest = [] if how == "leftsemi" else [c for c in right.columns if c not in keys]
    return out.select(*[f"`{c}`" for c in left.columns], *[f"`{c}`" for c in rest])


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the rank of each row, from 1, among those with equal keys, in order of the columns `order`.

    The rows are range partitioned, so the ranks come from the place inside a
    range and the sizes of the ranges before it: no task sorts a whole group,
    however large.
    """
    spread = materialize(df.repartitionByRange(*keys, *order).withColumn("__b", F.spark_partition_id()), "ranges")
    per = spread.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    starts = per.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__at"), before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__b") == F.col("__at")]
    return spread.withColumn("__p", place).join(starts, same).select(*df.columns, (F.col("__p") + F.col("__before")).alias(name))


def _plain(df: DataFrame) -> list[str]:
    """Columns fit for hashing into a salt."""
    return [n for n, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary", "variant"))]
