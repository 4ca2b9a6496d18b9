"""The operators over streams: watermarked counts, upserts per micro-batch, maintained profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from causeway.operators.pivot import attribute_key
from causeway.operators.profile import ValueCounts


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream, under an explicit schema."""
    return spark.readStream.schema(schema).parquet(path)


def fact_counts(observations: DataFrame, late: str = "2 days", window: str = "1 day") -> DataFrame:
    """(window, pred, n) over arrived_at; state older than `late` is dropped, so it does not grow with the stream.

    Copies of an observation that arrive within `late` count once.
    """
    rows = observations.where("observation_id is not null").withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["observation_id"])
    f = rows.select("arrived_at", F.explode("facts").alias("f")).where("f.pred is not null")
    return f.groupBy(F.window("arrived_at", window), attribute_key(F.col("f.pred")).alias("pred")).agg(F.count("*").alias("n"))


def maintain_profile(metrics: DataFrame, store: ValueCounts, columns: list[str], checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of metrics to a value-count table.

    A micro-batch is known by its number, so one that runs again after a
    failure takes the place of its first run. Copies of a row count once, also
    in different batches.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.load(batch, "feed", "load_no", columns, batch=f"stream-{number}")

    return metrics.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_latest(spark: SparkSession, stream: DataFrame, key: str, seq: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest state of each key: every micro-batch is reduced and written as one generation, folded by latest()."""

    def fold(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        best = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("v"))
        best.select(key, *[F.col("v")[c].alias(c) for c in rest]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str, seq: str) -> DataFrame:
    """The latest state of each key over all generations of running_latest()."""
    t = spark.read.parquet(path).drop("batch")
    rest = [c for c in t.columns if c != key]
    return t.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("v")).select(key, *[F.col("v")[c].alias(c) for c in rest])
