"""Files whose schemas drift: a store of versioned fingerprints, explicit migration steps, routed files and a record of every change."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import materialize, scratch_path

#: The most names a contract may hold: its fields become columns, so it is a bounded table by nature.
MAX_CONTRACT = 20_000

_STRIP = re.compile(r"[^a-z0-9]")

Contract = dict[str, dict[str, str]]


def stripped(name: str) -> str:
    """The compared form of a key: lower case, only a-z and 0-9."""
    return _STRIP.sub("", name.lower())


def contract_map(contract: DataFrame) -> tuple[Contract, dict[str, dict[str, str]]]:
    """({kind: {stripped name: canonical field}}, {kind: {canonical field: JSON type}}).

    A name claimed by two fields goes to the first in order. Raises ValueError
    beyond MAX_CONTRACT names.
    """
    rows = contract.select("artifact_kind", "canonical_field", "accepted_name", "json_type").distinct().limit(MAX_CONTRACT + 1).collect()
    if len(rows) > MAX_CONTRACT:
        raise ValueError(f"a contract has at most {MAX_CONTRACT} names")
    names: Contract = {}
    types: dict[str, dict[str, str]] = {}
    for r in sorted(rows, key=lambda r: tuple(x or "" for x in r)):
        if r["artifact_kind"] is None or r["canonical_field"] is None:
            continue
        own = names.setdefault(r["artifact_kind"], {})
        own.setdefault(stripped(r["canonical_field"]), r["canonical_field"])
        if r["accepted_name"] is not None:
            own.setdefault(stripped(r["accepted_name"]), r["canonical_field"])
        types.setdefault(r["artifact_kind"], {}).setdefault(r["canonical_field"], r["json_type"])
    return names, types


def _type(x) -> str | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(x)]


class _Pairs(list):
    """The members of a JSON object in order, repeated keys included."""


class _Fraction(float):
    """A number with a fraction or exponent, which keeps its text."""

    text = ""


def _fraction(text: str) -> _Fraction:
    out = _Fraction(text)
    out.text = text
    return out


def parse(body: str | None):
    """The JSON value of body with objects as _Pairs, or None if it is damaged."""
    if body is None:
        return None
    try:
        return json.loads(body, object_pairs_hook=_Pairs, parse_constant=_refuse, parse_float=_fraction)
    except (ValueError, RecursionError):
        return None


def _refuse(name: str):
    raise ValueError(name)


def members(value, names: dict[str, str]) -> Iterator[tuple[str, str, str | None]]:
    """(canonical path, last key as written, JSON type or None for null) of every key in value, without recursion."""
    stack = [("", value)]
    while stack:
        prefix, x = stack.pop()
        if isinstance(x, _Pairs):
            for key, v in x:
                plain = stripped(key)
                path = f"{prefix}{names.get(plain, plain)}"
                yield path, key, "object" if isinstance(v, _Pairs) else _type(v)
                if isinstance(v, list):
                    stack.append((path + ".", v))
        elif isinstance(x, list):
            stack.extend((prefix, v) for v in x if isinstance(v, list))


def fingerprint(shape: set[tuple[str, str, str | None]]) -> str:
    """A digest of a file's schema: its paths, spellings and types in order."""
    return hashlib.md5(json.dumps(sorted([a, b, c or ""] for a, b, c in shape)).encode()).hexdigest()


_SHAPE = "export_line string, artifact_kind string, batch_no long, fingerprint string, members array<struct<field:string,written:string,json_type:string>>"


def shapes(files: DataFrame, names: Contract) -> DataFrame:
    """(export_line, artifact_kind, batch_no, fingerprint, members, files): the schema versions of each batch.

    Every body is parsed once; files of one version differ in values only, so
    versions are combined per task and then by fingerprint before anything is
    shuffled by path. A damaged or null body has no members but still makes its
    batch exist.
    """

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: dict[tuple, tuple] = {}
            for line, kind, batch, body in zip(pdf.export_line, pdf.artifact_kind, pdf.batch_no, pdf.body, strict=True):
                shape = set(members(parse(body), names.get(kind, {})))
                mark = fingerprint(shape)
                if (line, kind, batch, mark) not in out:
                    out[line, kind, batch, mark] = sorted(shape, key=lambda m: (m[0], m[1], m[2] or ""))
            yield pd.DataFrame([(*k, [dict(zip(("field", "written", "json_type"), m, strict=True)) for m in v]) for k, v in out.items()], columns=["export_line", "artifact_kind", "batch_no", "fingerprint", "members"])

    rows = files.where("export_line is not null and artifact_kind is not null and batch_no is not null").select("export_line", "artifact_kind", F.col("batch_no").cast("long").alias("batch_no"), "body")
    found = rows.mapInPandas(visit, _SHAPE)
    return found.groupBy("export_line", "artifact_kind", "batch_no", "fingerprint").agg(F.first("members").alias("members"))


class SchemaStore:
    """The schema versions of all batches, kept in a Parquet folder: (export_line, artifact_kind, batch_no, fingerprint, members).

    register() parses new files once and appends the versions it finds; files
    of a version that is known add nothing but a repeated row, which versions()
    folds. So a later batch is compared and migrated without reading the files
    before it again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch_path(spark, "schemas")

    def register(self, files: DataFrame, names: Contract) -> SchemaStore:
        shapes(files, names).write.mode("append").parquet(self.path)
        return self

    def versions(self) -> DataFrame:
        kept = self.spark.read.schema(_SHAPE).parquet(self.path)
        return kept.groupBy("export_line", "artifact_kind", "batch_no", "fingerprint").agg(F.first("members").alias("members"))


#: The order in which the steps of a batch are taken.
_STEPS = ("renamed", "retyped", "added", "removed")


def migration_steps(versions: DataFrame) -> DataFrame:
    """(export_line, artifact_kind, batch_no, field, change, old_key, new_key, old_type, new_type): the steps from each batch's schema to the next batch's.

    renamed: from old_key to new_key (of several spellings the first by name);
    retyped: from old_type to new_type, which is null where the batch has
    several; added: the field starts, files before it take the default null;
    removed: it ends. Batches without a predecessor have no steps. A batch and
    the batch after it each see a member with the side it is on, so members are
    compared in grouped counts and a batch of any size is spread over the
    cluster.
    """
    key = ["export_line", "artifact_kind"]
    sides = F.array(F.struct(F.col("batch_no").alias("at"), F.lit(True).alias("now")), F.struct((F.col("batch_no") + 1).alias("at"), F.lit(False).alias("now")))
    both = versions.select(*key, "members", F.explode(sides).alias("s"))
    on = lambda c, side: F.max(F.when(F.col("s.now") == side, c).otherwise(False))
    exists = both.groupBy(*key, F.col("s.at").alias("batch_no")).agg(on(F.lit(True), True).alias("a"), on(F.lit(True), False).alias("b")).where("a and b").select(*key, "batch_no")
    seen = both.select(*key, F.col("s.at").alias("batch_no"), F.col("s.now").alias("now"), F.explode("members").alias("m"))
    trait = F.explode(F.array(F.struct(F.lit("key").alias("what"), F.col("m.written").alias("v")), F.struct(F.lit("type").alias("what"), F.col("m.json_type").alias("v"))))
    traits = (
        seen.select(*key, "batch_no", "now", F.col("m.field").alias("field"), trait.alias("t"))
        .groupBy(*key, "batch_no", "field", "t.what", "t.v")
        .agg(F.max("now").alias("now"), F.max(~F.col("now")).alias("before"))
    )
    is_key, is_type, now, before = F.col("what") == "key", (F.col("what") == "type") & F.col("v").isNotNull(), F.col("now"), F.col("before")
    any_ = lambda c: F.max(F.when(c, True).otherwise(False))
    least = lambda c: F.min(F.when(c, F.col("v")))
    fields = traits.groupBy(*key, "batch_no", "field").agg(
        any_(now).alias("now"), any_(before).alias("before"),
        any_(is_key & (now != before)).alias("renamed"), any_(is_type & (now != before)).alias("retyped"),
        least(is_key & before).alias("old_key"), least(is_key & now).alias("new_key"), least(is_type & before).alias("old_type"), least(is_type & now).alias("first_type"), F.count_if(is_type & now).alias("types"),
    )
    both_in = now & before
    change = F.array_compact(F.array(
        F.when(both_in & F.col("renamed"), F.lit("renamed")), F.when(both_in & F.col("retyped") & F.col("first_type").isNotNull() & F.col("old_type").isNotNull(), F.lit("retyped")),
        F.when(now & ~before, F.lit("added")), F.when(~now & before, F.lit("removed")),
    ))
    new_type = F.when(F.col("types") == 1, F.col("first_type"))
    return fields.join(exists, [*key, "batch_no"], "leftsemi").select(*key, "batch_no", "field", F.explode(change).alias("change"), "old_key", "new_key", "old_type", new_type.alias("new_type"))


def schema_changes(files: DataFrame, contract: DataFrame, store: SchemaStore | None = None) -> DataFrame:
    """(export_line, artifact_kind, batch_no, field, change) of every batch against batch_no - 1 of its line and kind.

    Read off the migration steps between the versions in the store, to which
    the files are added first. added, removed: no file of the earlier, later
    batch has the path; renamed: the sets of its last keys as written differ;
    retyped: the sets of its JSON types differ and neither is empty. Rows
    without line, kind or batch belong to no batch.
    """
    names, _ = contract_map(contract)
    versions = (store or SchemaStore(files.sparkSession)).register(files, names).versions()
    return migration_steps(versions).select("export_line", "artifact_kind", "batch_no", "field", "change")


def chains(steps: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(export_line, artifact_kind, chain): the steps of the named top-level fields of each kind, from the first batch to the last.

    A chain has at most one step of each change per field and batch of its line.
    """
    own = F.lit(False)
    for kind, names in fields.items():
        own |= (F.col("artifact_kind") == kind) & F.col("field").isin(names)
    order = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(_STEPS) for x in (c, i)]), F.col("change"))
    step = F.struct("batch_no", order.alias("n"), "field", "change", "new_key", "new_type")
    return steps.where(own).groupBy("export_line", "artifact_kind").agg(F.array_sort(F.collect_list(step)).alias("chain"))


_CAST = {"string": "string", "number": "double", "boolean": "boolean", "array": "array<string>", "object": "string"}
# The words that are booleans.
_WORDS = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}
_DECIMAL = re.compile(r"[+-]?(?:(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_LOST = object()


def _own_type(value) -> str | None:
    return "object" if isinstance(value, _Pairs) else _type(value)


def _cast(value, json_type: str):
    """value as another JSON type, or _LOST: numbers from decimal texts (thousands commas only where they belong), whole numbers exactly; booleans from their words and from 1 and 0; any value as text and as the only element of an array."""
    own = _own_type(value)
    if value is None or own == json_type:
        return value
    if json_type == "string":
        return _dump(value)
    if json_type == "array":
        return [value]
    if json_type == "number" and own == "boolean":
        return int(value)
    if json_type == "number" and own == "string" and _DECIMAL.fullmatch(text := value.strip()):
        text = text.replace(",", "")
        number = int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else _fraction(text)
        return number if abs(number) != float("inf") else _LOST
    if json_type == "boolean" and own in ("number", "string"):
        return _WORDS.get(_dump(value).strip().lower() if own == "number" else value.strip().lower(), _LOST)
    return _LOST


def _dump(value) -> str:
    if isinstance(value, _Fraction):
        return value.text

    def plain(x):
        if isinstance(x, _Pairs):
            return {k: plain(v) for k, v in x}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), ensure_ascii=False)


def migrate(value, batch: int | None, chain: list[dict], names: dict[str, str], types: dict[str, str]) -> tuple[dict[str, str | None], dict[str, str], list[str]]:
    """({field: JSON text}, {other key: JSON text}, log) of a parsed file taken from its batch through all later steps to the contract.

    Each later step renames, casts or defaults the field it is about. A cast on
    the way is taken only if it can be undone, so the chain loses nothing; the
    last cast, to the contract's type, may fail: then the field is null and its
    text is kept among the other keys. So is that of a whole number that a
    double cannot hold.
    """
    own: dict[str, tuple[str, object]] = {}
    extra: dict[str, str] = {}
    if not isinstance(value, _Pairs):
        return {}, {}, ["damaged"]
    log = []
    for key, v in value:
        f = names.get(stripped(key))
        if f is None:
            extra[key] = _dump(v)
        elif v is not None or f not in own:
            own[f] = key, v
    for s in chain if batch is not None else ():
        f, to, kind = s["field"], s["new_key"], s["new_type"]
        if s["batch_no"] <= batch:
            continue
        at = f"{f}, batch {s['batch_no']}: "
        if s["change"] == "added":
            if f not in own:
                own[f] = to, None
                log.append(f"{at}default null")
        elif f in own:
            key, v = own[f]
            if s["change"] == "renamed" and key != to:
                own[f] = to, v
                log.append(f"{at}rename {key} to {to}")
            elif s["change"] == "retyped" and kind and v is not None and _own_type(v) != kind:
                new = _cast(v, kind)
                if new is not _LOST and _cast(new, _own_type(v)) == v:
                    own[f] = key, new
                    log.append(f"{at}cast {_own_type(v)} to {kind}")
                else:
                    log.append(f"{at}kept {_own_type(v)}")
            elif s["change"] == "removed":
                log.append(f"{at}kept although removed")
    out: dict[str, str | None] = {}
    for f in sorted(types):
        if f not in own:
            out[f] = None
            log.append(f"{f}: default null")
            continue
        key, v = own[f]
        if key != f:
            log.append(f"{f}: rename {key} to {f}")
        kind = _own_type(v)
        new = _cast(v, types[f])
        if new is _LOST:
            log.append(f"{f}: lost {kind}")
            extra[key] = _dump(v)
            new = None
        elif kind not in (None, types[f]):
            log.append(f"{f}: cast {kind} to {types[f]}")
        if isinstance(new, int) and not isinstance(new, bool) and types[f] == "number" and abs(new) > 1 << 53 and (abs(new) >= 1 << 1023 or int(float(new)) != new):
            log.append(f"{f}: rounded {new}")
            extra[key] = str(new)
        out[f] = None if new is None else _dump(new)
    return out, extra, log


def conform(files: DataFrame, contract: DataFrame, kind: str, store: SchemaStore | None = None) -> DataFrame:
    """The consistent table of one artifact_kind: a row per file.

    file_name, export_line, batch_no, captured_at, schema_version (the
    fingerprint of the file's schema), one column per canonical field typed as
    the contract says, extra (a map of the JSON texts of other top-level
    fields, and of values a column cannot hold) and steps (every rename, cast
    and default applied, in order). Each file is routed by its batch through
    the later migration steps of its line, see migrate. Top-level keys are
    matched as in schema_changes; a repeated field keeps its last value that is
    not null. Missing fields default to null. Files that come twice with the
    same content make one row; a damaged file makes a row of nulls with the
    step `damaged`; a file without line or batch takes no steps but the last.
    """
    all_names, all_types = contract_map(contract)
    names, types = all_names.get(kind, {}), all_types.get(kind, {})
    mine = files.where(F.col("artifact_kind") == kind)
    versions = (store or SchemaStore(files.sparkSession)).register(mine, all_names).versions()
    # a row per line, of known size once written, so that Spark chooses the join by it
    chain = materialize(chains(migration_steps(versions).where(F.col("artifact_kind") == kind), {kind: list(types)}).drop("artifact_kind"), "chains")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            marks, rows = [], []
            for body, batch, steps in zip(pdf.body, pdf.batch_no, pdf.chain, strict=True):
                value = parse(body)
                marks.append(fingerprint(set(members(value, names))))
                rows.append(migrate(value, None if pd.isna(batch) else int(batch), [] if steps is None else list(steps), names, types))
            fields, extras, logs = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pdf.drop(columns=["body", "chain"]).assign(schema_version=marks, fields=fields, extra=extras, steps=logs)

    base = mine.select("file_name", "export_line", "batch_no", "captured_at", "body").distinct().join(chain, "export_line", "left").select("file_name", "export_line", "batch_no", "captured_at", "body", "chain")
    schema = "file_name string, export_line string, batch_no int, captured_at timestamp, schema_version string, fields map<string,string>, extra map<string,string>, steps array<string>"
    rows = base.mapInPandas(route, schema)
    fixed = {"file_name", "export_line", "batch_no", "captured_at", "schema_version", "extra", "steps"}
    cols = []
    for f in sorted(types):
        raw = F.element_at("fields", F.lit(f))
        t = _CAST.get(types[f], "string")
        if t == "array<string>":
            col = F.from_json(raw, "array<string>")
        elif t == "string" and types[f] == "string":
            col = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        else:
            col = raw.cast(t)
        cols.append(col.alias(f"{f}_field" if f in fixed else f))
    return rows.select("file_name", "export_line", "batch_no", "captured_at", "schema_version", *cols, "extra", "steps")

