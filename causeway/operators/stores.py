"""Record stores: keyed upserts, patches, counters, deletes and searches, as whole-table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key over both frames: the one with the greatest seq, rows of new winning ties. Null keys are dropped.

    Combined before the shuffle, so a key with many versions is no hot group.
    """
    cols = [c for c in base.columns if c != key]
    rows = base.select(key, *cols, F.lit(0).alias("__new")).unionByName(new.select(key, *cols, F.lit(1).alias("__new"))).where(F.col(key).isNotNull())
    rest = [c for c in cols if c != seq]
    best = F.max_by(F.struct(seq, *rest), F.struct(F.col(seq), F.col("__new"))).alias("v")
    return rows.groupBy(key).agg(best).select(key, *[F.col("v")[c].alias(c) for c in cols])


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the non-null values that changes (one row per key) gives for columns."""
    p = changes.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    out = base.join(p, key, "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def add_counts(base: DataFrame, increments: DataFrame, key: str, counter: str) -> DataFrame:
    """base with counter raised by the number of rows that increments has for its key."""
    n = increments.groupBy(key).agg(F.count("*").alias("__n"))
    return base.join(n, key, "left").select(*[(F.col(c) + F.coalesce("__n", F.lit(0))).alias(c) if c == counter else F.col(c) for c in base.columns])


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key).distinct(), key, "left_anti")


def newest(df: DataFrame, seq: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """The newest rows, ties by key: a top-k without a full sort."""
    return df.orderBy(F.desc_nulls_last(seq), key).offset(offset).limit(limit)


def contains(col: Column, text: str) -> Column:
    """Whether col holds text, without regard to letter case."""
    return F.lower(col).contains(text.lower())


def counts_by(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(column, n) over a fixed domain, zero where there is no row."""
    spark = df.sparkSession
    return spark.createDataFrame([(x,) for x in domain], f"{column} string").join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


class ObjectStore:
    """A store of typed records in a Parquet folder: append-only versions, the greatest seq of a key being its state."""

    def __init__(self, spark, path: str, key: str, seq: str) -> None:
        self.spark, self.path, self.key, self.seq = spark, path, key, seq

    def save(self, rows: DataFrame) -> None:
        rows.where(F.col(self.key).isNotNull()).write.mode("append").parquet(self.path)

    def versions(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def current(self) -> DataFrame:
        t = self.versions()
        rest = [c for c in t.columns if c != self.key]
        return t.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.seq).alias("v")).select(self.key, *[F.col("v")[c].alias(c) for c in rest])

    def get(self, key) -> DataFrame:
        """The state of one key; the filter reaches the scan."""
        t = self.versions().where(F.col(self.key) == key)
        return t.orderBy(F.desc(self.seq)).limit(1)

    def list_by(self, column: str, value) -> DataFrame:
        """The records whose state has value in column, newest first."""
        return self.current().where(F.col(column) == value).orderBy(F.desc(self.seq), self.key)

    def stats(self, column: str) -> DataFrame:
        return self.current().groupBy(column).agg(F.count("*").alias("n"))
