"""The queries p1 to p7 over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import drift, flatten, hierarchy, orphans, pivot, profile, timestamps
from causeway.session import materialize
from causeway.tables import load

PROFILED = ["solve_rate", "atom_count", "regulations_confirmed"]


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "mechanism_instances")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_found(_instances(spark, d), "id", "superseded_by", "generated_at", "arrived_at")


def _instance_edges(spark: SparkSession, d: str) -> DataFrame:
    df = _instances(spark, d).select("id", "superseded_by", "generated_at", "arrived_at")
    return materialize(hierarchy.edges(hierarchy.latest_state(df, "id", "generated_at", ["arrived_at"]), "id", "superseded_by"), "edges")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.roots_and_depths(_instance_edges(spark, d), with_path=True)
    return out.select("id", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_instance_edges(spark, d))


def _counts(spark: SparkSession, d: str) -> profile.ValueCounts:
    store = profile.ValueCounts(spark)
    store.load(load(spark, d, "metrics"), "feed", "load_no", PROFILED)
    return store


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_issues(_counts(spark, d).deltas(), profile.METRICS_DOMAINS)


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    out = profile.profile(_counts(spark, d).counts(), profile.METRICS_DOMAINS)
    return out.select("feed", "load_no", "column_name", "row_count", "nulls", "valid", "distinct_valid", "pattern_violations", "range_violations", "low", "high", F.round(F.col("mean") * F.col("valid"), 6).alias("total"), F.round("entropy", 6).alias("entropy"))


def _wide(spark: SparkSession, d: str, empty: bool = True) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The wide table of all observations, those without any value only if asked for, and its attributes."""
    types = pivot.type_list(load(spark, d, "predicates"), "pred", "value_type")
    long = pivot.long_facts(load(spark, d, "observations"), "observation_id", "facts")
    attributes = pivot.discover(long, types)
    entities = load(spark, d, "observations").select(F.col("observation_id").alias("entity"))
    return pivot.wide(pivot.cells(long, types), attributes, entities if empty else None), attributes


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    table, _ = _wide(spark, d, empty=False)
    return pivot.issues(table).select(F.col("entity").alias("observation_id"), F.col("attr").alias("pred"), "issue")


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    table, _ = _wide(spark, d)
    return table.withColumnRenamed("entity", "observation_id")


def p3_cells(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells of the wide table, read back from its columns."""
    table, attributes = _wide(spark, d)
    return pivot.long_again(table, attributes).select(F.col("entity").alias("observation_id"), F.col("attr").alias("pred"), "value")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    clients = load(spark, d, "ingest_clients")
    obs = timestamps.uncanonical_instants(load(spark, d, "observations"), "observations", "observation_id", ["timestamp", "created_at"], clients)
    stories = timestamps.uncanonical_instants(load(spark, d, "stories"), "stories", "id", ["created_at"], clients)
    return obs.unionByName(stories)


def p4_story_instants(spark: SparkSession, d: str) -> DataFrame:
    out = timestamps.normalised(load(spark, d, "stories").select("id", "client", "created_at"), ["created_at"], load(spark, d, "ingest_clients"))
    return out.select("id", "created_at", F.timestamp_micros("created_at_utc_micros").alias("created_utc"), "zone_data").distinct()


def _referring(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    names = {r.record_table for r in orphans.REFERENCES} | {r.target for r in orphans.REFERENCES}
    return {n: load(spark, d, n) for n in sorted(names)}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_referring(spark, d))


def p5_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_referring(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(load(spark, d, "raw_artifacts"), load(spark, d, "contract_fields"))


def _conformed(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return drift.conform(load(spark, d, "raw_artifacts"), load(spark, d, "contract_fields"), kind)

    return query


_KINDS = ("metrics", "mechanism_class", "mechanism_program")


def p6_cells(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells of the three consistent tables in long form: a text (of a boolean too), a number or the length of a list."""
    out = None
    for kind in _KINDS:
        t = _conformed(kind)(spark, d)
        fixed = {"file_name", "export_line", "batch_no", "captured_at", "schema_version", "extra", "steps"}
        cell = lambda c, k: F.struct(
            F.lit(c).alias("field"), (F.col(c) if k == "string" else F.lit(None)).cast("string").alias("text"), (F.col(c) if k == "double" else F.lit(None)).cast("double").alias("number"), (F.when(F.col(c).isNotNull(), F.size(c)) if k.startswith("array") else F.lit(None)).cast("long").alias("items")
        )
        cells = F.array(*[cell(c, k) for c, k in t.dtypes if c not in fixed])
        part = t.select(F.lit(kind).alias("artifact_kind"), "file_name", F.col("batch_no").cast("long").alias("batch_no"), F.unix_micros("captured_at").alias("captured"), F.explode(cells).alias("c")).select("artifact_kind", "file_name", "batch_no", "captured", "c.*")
        out = part if out is None else out.unionByName(part)
    return out.where("text is not null or number is not null or items is not null")


def p6_steps(spark: SparkSession, d: str) -> DataFrame:
    """The migration steps between the schema versions of neighbouring batches."""
    names, _ = drift.contract_map(load(spark, d, "contract_fields"))
    store = drift.SchemaStore(spark).register(load(spark, d, "raw_artifacts"), names)
    return drift.migration_steps(store.versions())


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.flat_leaves(load(spark, d, "observations"), load(spark, d, "regulations"))


def p7_observation_tables(spark: SparkSession, d: str) -> DataFrame:
    return flatten.tagged_rows(load(spark, d, "observations"), "observation_id").distinct()


def p7_regulation_tables(spark: SparkSession, d: str) -> DataFrame:
    now = hierarchy.latest_state(load(spark, d, "regulations").select("regulation_id", "updated_at", "arrived_at", "data"), "regulation_id", "updated_at", ["arrived_at"])
    return flatten.tagged_json(now, "regulation_id", "data", ("pattern", "pre"))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants,
        "p2_found": p2_found, "p2_profile": p2_profile,
        "p3_found": p3_found, "p3_wide": p3_wide, "p3_cells": p3_cells,
        "p4_found": p4_found, "p4_story_instants": p4_story_instants,
        "p5_found": p5_found, "p5_by_period": p5_by_period,
        "p6_found": p6_found, "p6_steps": p6_steps, "p6_cells": p6_cells, **{f"p6_{k}_table": _conformed(k) for k in _KINDS},
        "p7_found": p7_found, "p7_observation_tables": p7_observation_tables, "p7_regulation_tables": p7_regulation_tables,
    }


def oracle_sql() -> dict[str, str]:
    from causeway.plans import problems_sql

    return problems_sql.oracle_sql()
