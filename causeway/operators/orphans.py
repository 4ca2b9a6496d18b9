"""References to records that are missing, deleted or arrive later, per table and period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.text import reference_key
from causeway.session import materialize
from causeway.skew import hot_of_counts, salted_join


@dataclass(frozen=True)
class Reference:
    """field of record_table names a record of target."""

    record_table: str
    field: str
    target: str
    key: str = "id"


#: The references of the domain tables.
REFERENCES = (
    Reference("prediction_errors", "outcome_record_id", "outcome_records"),
    Reference("prediction_errors", "caused_by_action_execution_id", "action_executions"),
    Reference("action_executions", "based_on_experiment_design_id", "experiment_designs"),
    Reference("mechanism_instances", "episode_id", "stories"),
)


def references_of(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """(record_table, record_id, field, target, ref, arrived): the distinct references, each with its record's arrival.

    Rows that differ only in arrived_at are one record, which arrived with the
    first of them. Null, blank and `null` references make no row. The copies of
    all tables are combined in one shuffle; a record that still has many rows
    is joined with its arrival under salt.
    """
    parts = []
    for table in dict.fromkeys(r.record_table for r in references):
        fields = [r for r in references if r.record_table == table]
        # a record without references still has an arrival, hence the last element
        pairs = [F.struct(F.lit(r.field).alias("field"), F.lit(r.target).alias("target"), reference_key(F.col(r.field)).alias("ref")) for r in fields]
        pairs.append(F.struct(*[F.lit(None).cast("string").alias(c) for c in ("field", "target", "ref")]))
        t = tables[table].where(F.col(fields[0].key).isNotNull())
        parts.append(t.select(F.lit(table).alias("record_table"), F.col(fields[0].key).alias("record_id"), "arrived_at", F.explode(F.array(*pairs)).alias("p")).where("p.field is null or p.ref is not null"))
    own = _union(parts).groupBy("record_table", "record_id", "p.field", "p.target", "p.ref").agg(F.min("arrived_at").alias("first"))
    own = materialize(own, "references")
    record = ["record_table", "record_id"]
    arrivals = own.groupBy(*record).agg(F.min("first").alias("arrived"), F.count("*").alias("n"))
    joined = salted_join(own.where("field is not null").drop("first"), arrivals.drop("n"), record, hot=hot_of_counts(arrivals, record, "n"))
    return materialize(joined.select(*record, "field", "target", "ref", "arrived"), "children")


def parents_of(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """(target, ref, arrived, deleted_at): the rows of the tables referred to."""
    parts = []
    for target, key in dict.fromkeys((r.target, r.key) for r in references):
        t = tables[target]
        deleted = F.col("deleted_at") if "deleted_at" in t.columns else F.lit(None).cast("timestamp")
        parts.append(t.select(F.lit(target).alias("target"), reference_key(F.col(key)).alias("ref"), F.col("arrived_at").alias("arrived"), deleted.alias("deleted_at")).where("ref is not null"))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphans(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """(record_table, record_id, field, reason, period): the references that point to nothing usable.

    Parents and children are tagged and stacked in one long form, which is
    grouped by target and key, combined before the shuffle: a group without a
    parent's row is missing, and of the others the parent's arrival and
    deletion decide. The verdict of a key goes back to its references by a join
    in which hot keys, known from the groups' counts, are salted, so no group
    is ever gathered in one task. Null deleted_at: not deleted. A reference
    whose own arrival is null has a null period and is never late or deleted.
    """
    children = references_of(tables, references)
    tagged = parents_of(tables, references).withColumn("is_parent", F.lit(True)).unionByName(
        children.select("target", "ref", F.lit(None).cast("timestamp").alias("arrived"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(False).alias("is_parent"))
    )
    key = ["target", "ref"]
    groups = materialize(tagged.groupBy(*key).agg(F.max("is_parent").alias("known"), F.min("arrived").alias("parent_arrived"), F.min("deleted_at").alias("parent_deleted"), F.count_if(~F.col("is_parent")).alias("n")).where("n > 0"), "keys")
    judged = salted_join(children, groups.drop("n"), key, hot=hot_of_counts(groups, key, "n"))
    reason = F.when(~F.col("known"), "missing").when(F.col("parent_deleted") <= F.col("arrived"), "deleted").when(F.col("parent_arrived") > F.col("arrived"), "late")
    return judged.select("record_table", "record_id", "field", reason.alias("reason"), F.date_format("arrived", "yyyy-MM").alias("period")).where("reason is not null").distinct()


def orphan_counts(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """(record_table, field, period, reason, orphans): how many orphans each table and period has."""
    return orphans(tables, references).groupBy("record_table", "field", "period", "reason").agg(F.count("*").alias("orphans"))
