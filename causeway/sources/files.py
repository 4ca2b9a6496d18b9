"""File sources and sinks: JSON exports, Parquet, and keyed imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators.stores import upsert

FACT = T.StructType([T.StructField("pred", T.StringType()), T.StructField("value", T.StringType()), T.StructField("args", T.MapType(T.StringType(), T.StringType()))])
OBSERVATION = T.StructType([
    T.StructField("observation_id", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("facts", T.ArrayType(FACT)), T.StructField("focus_facts", T.ArrayType(FACT)),
    T.StructField("context", T.MapType(T.StringType(), T.StringType())), T.StructField("raw_refs", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def read_json(spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE", multi_line: bool = False) -> DataFrame:
    """JSON lines, or one JSON document per file, under an explicit schema: no pass to infer one. mode FAILFAST refuses damaged rows."""
    return spark.read.schema(schema).option("mode", mode).option("multiLine", multi_line).json(path)


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name, written where its partitions are."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def import_table(base: DataFrame, path: str, key: str, seq: str) -> DataFrame:
    """base with the exported rows at path put in by key, the greater seq winning."""
    return upsert(base, read_json(base.sparkSession, path, base.schema), key, seq)


def append_once(new: DataFrame, path: str, key: str) -> DataFrame:
    """Append to a Parquet log the rows of new whose key it does not hold yet; returns those rows' frame."""
    spark = new.sparkSession
    try:
        have = spark.read.parquet(path).select(key)
        fresh = new.dropDuplicates([key]).join(have, key, "left_anti")
    except Exception as e:  # the log does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = new.dropDuplicates([key])
    fresh.write.mode("append").parquet(path)
    return fresh


def valid_observations(df: DataFrame) -> DataFrame:
    """df with `errors`, the rules each row breaks: no id, no facts, a fact without pred."""
    errors = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("observation_id"), F.lit("")) == "", "no id"),
        F.when(F.coalesce(F.size("facts"), F.lit(0)) <= 0, "no facts"),
        F.when(F.exists("facts", lambda f: F.coalesce(F.trim(f["pred"]), F.lit("")) == ""), "fact without pred"),
    ))
    return df.withColumn("errors", errors)
