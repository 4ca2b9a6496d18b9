"""Declarative integrity audits across tables: every check gives rows of findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.text import reference_key, strip
from causeway.skew import salted_join

FINDING = ("record_table", "record_id", "code", "field")


@dataclass(frozen=True)
class Refers:
    """A reference (or each element of an array of references) must name a row of target."""

    code: str
    table: str
    field: str
    target: str


@dataclass(frozen=True)
class OneOf:
    code: str
    table: str
    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Filled:
    """A text or array must not be null or empty."""

    code: str
    table: str
    field: str


@dataclass(frozen=True)
class Between:
    code: str
    table: str
    field: str
    low: float
    high: float


@dataclass(frozen=True)
class Matches:
    code: str
    table: str
    field: str
    pattern: str


@dataclass(frozen=True)
class Needs:
    """Rows that meet `when` must meet `then` (SQL conditions)."""

    code: str
    table: str
    field: str
    when: str
    then: str


@dataclass(frozen=True)
class Referred:
    """Rows of table that meet `when` must be referred to by source.source_field."""

    code: str
    table: str
    field: str
    source: str
    source_field: str
    when: str = field(default="true")


#: The checks over the domain tables.
CHECKS = (
    Refers("bad-action-execution-design-ref", "action_executions", "based_on_experiment_design_id", "experiment_designs"),
    Refers("bad-action-execution-source-episode-ref", "action_executions", "source_episode_id", "stories"),
    Refers("bad-action-execution-target-episode-ref", "action_executions", "target_episode_id", "stories"),
    Refers("bad-outcome-record-episode-ref", "outcome_records", "episode_id", "stories"),
    Refers("bad-outcome-record-action-ref", "outcome_records", "caused_by_action_execution_id", "action_executions"),
    Refers("bad-prediction-error-action-ref", "prediction_errors", "caused_by_action_execution_id", "action_executions"),
    Refers("bad-prediction-error-outcome-ref", "prediction_errors", "outcome_record_id", "outcome_records"),
    Refers("bad-mechanism-instance-ref", "mechanism_instances", "superseded_by", "mechanism_instances"),
    OneOf("bad-outcome-record-status", "outcome_records", "status", ("success", "failure", "partial")),
    Filled("empty-outcome-record-summary", "outcome_records", "summary"),
    Between("bad-prediction-error-score", "prediction_errors", "score", 0.0, 1.0),
    Matches("bad-mechanism-class-id", "mechanism_instances", "mechanism_class_ref", "^MC_[0-9]+$"),
    Needs("accepted-instance-without-support", "mechanism_instances", "claim_ids", "status = 'accepted'", "size(claim_ids) > 0"),
    Needs("superseded-without-successor", "mechanism_instances", "superseded_by", "status = 'superseded'", "superseded_by is not null"),
    Referred("orphan-experiment-design", "experiment_designs", "id", "action_executions", "based_on_experiment_design_id", "deleted_at is null"),
)


def _rows(df: DataFrame, check, bad: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select(F.lit(check.table).alias("record_table"), F.col("id").cast("string").alias("record_id"), F.lit(check.code).alias("code"), F.lit(check.field).alias("field"))


def _is_array(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name].startswith("array")


def findings(tables: dict[str, DataFrame], checks=CHECKS) -> DataFrame:
    """(record_table, record_id, code, field): the distinct findings of all checks.

    References are compared as in reference_key; null, blank and `null` ones
    are none. All references to one target go through one join with its keys,
    hot keys salted. Rows without an id are not reported.
    """
    out = []
    refs: dict[str, list[Refers]] = {}
    for c in checks:
        df = tables[c.table]
        col = F.col(c.field)
        if isinstance(c, Refers):
            refs.setdefault(c.target, []).append(c)
        elif isinstance(c, OneOf):
            out.append(_rows(df, c, ~F.coalesce(col, F.lit("")).isin(*c.values)))
        elif isinstance(c, Filled):
            out.append(_rows(df, c, (F.coalesce(F.size(col), F.lit(0)) <= 0) if _is_array(df, c.field) else (F.coalesce(strip(col), F.lit("")) == "")))
        elif isinstance(c, Between):
            out.append(_rows(df, c, ~col.between(c.low, c.high)))
        elif isinstance(c, Matches):
            out.append(_rows(df, c, ~col.rlike(c.pattern)))
        elif isinstance(c, Needs):
            out.append(_rows(df, c, F.expr(c.when) & ~F.coalesce(F.expr(c.then), F.lit(False))))
        elif isinstance(c, Referred):
            used = tables[c.source].select(reference_key(F.col(c.source_field)).alias("__k")).where("__k is not null").distinct()
            lone = df.where(c.when).withColumn("__k", reference_key(F.col("id"))).join(used, "__k", "left_anti")
            out.append(_rows(lone, c, F.lit(True)))
    for target, group in refs.items():
        parts = []
        for c in group:
            df = tables[c.table]
            ref = F.explode(c.field) if _is_array(df, c.field) else F.col(c.field)
            parts.append(df.select(F.lit(c.table).alias("record_table"), F.col("id").cast("string").alias("record_id"), F.lit(c.code).alias("code"), F.lit(c.field).alias("field"), ref.alias("r")).select(*FINDING, reference_key(F.col("r")).alias("k")).where("k is not null"))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        keys = tables[target].select(reference_key(F.col("id")).alias("k")).where("k is not null").distinct().withColumn("known", F.lit(True))
        out.append(salted_join(rows, keys, ["k"], "left").where("known is null").select(*FINDING))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result.where("record_id is not null").distinct()
