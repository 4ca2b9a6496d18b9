"""Nested records to flat child tables that keep the parent's key and the place in the parent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators.drift import _refuse
from causeway.operators.hierarchy import latest_state
from causeway.session import scratch_path

#: One emitted row: which table it belongs to, its own key, its parent's key, its place in the parent, and its scalar fields.
TAGGED = "tag string, pk string, parent_pk string, ord long, payload string"


def escaped(segment: Column) -> Column:
    """A part of a key path with its own `~` and `/` written as ~0 and ~1, so that different paths never make the same key."""
    return F.when(segment.contains("~") | segment.contains("/"), F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))).otherwise(segment)


def unescaped(segment: Column) -> Column:
    return F.when(segment.contains("~"), F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))).otherwise(segment)


def _escape(text: str) -> str:
    return text.replace("~", "~0").replace("/", "~1")


def _struct(tag: str, pk: Column, parent: Column, ord_: Column, payload: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), pk.alias("pk"), parent.alias("parent_pk"), ord_.cast("long").alias("ord"), payload.alias("payload"))


def _no_rows() -> Column:
    return F.array().cast("array<struct<tag:string,pk:string,parent_pk:string,ord:bigint,payload:string>>")


def _nested(t: T.DataType) -> bool:
    return isinstance(t, (T.StructType, T.ArrayType, T.MapType))


def _payload(node: Column, t: T.DataType) -> Column:
    """The scalars of a node as JSON text: of a struct its scalar fields, else {"value": ...}."""
    if isinstance(t, T.StructType):
        own = [node[f.name].alias(f.name) for f in t.fields if not _nested(f.dataType)]
        return F.to_json(F.struct(*own)) if own else F.lit("{}")
    return F.lit(None).cast("string") if _nested(t) else F.to_json(F.struct(node.alias("value")))


def _emit(node: Column, t: T.DataType, tag: str, parent: Column) -> list[Column]:
    """Array expressions with the rows of everything nested in node, depth first."""
    out: list[Column] = []
    if isinstance(t, T.StructType):
        for f in t.fields:
            if _nested(f.dataType):
                out += _child(node[f.name], f.dataType, f"{tag}.{f.name}" if tag else f.name, parent)
    return out


def _child(node: Column, t: T.DataType, tag: str, parent: Column) -> list[Column]:
    if isinstance(t, T.MapType):
        entry = T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)])
        return _child(F.map_entries(node), T.ArrayType(entry), tag, parent)
    if isinstance(t, T.ArrayType):
        et = t.elementType

        def element(x: Column, i: Column) -> Column:
            pk = F.concat(parent, F.lit(f"/{_escape(tag.rpartition('.')[2])}/"), i.cast("string"))
            row = F.array(_struct(tag, pk, parent, i, _payload(x, et)))
            inner = _child(x, et, tag + ".item", pk) if isinstance(et, (T.ArrayType, T.MapType)) else _emit(x, et, tag, pk)
            # a null element keeps its place and makes no row
            return F.when(x.isNotNull(), F.concat(row, *inner) if inner else row)

        return [F.coalesce(F.flatten(F.array_compact(F.transform(node, element))), _no_rows())]
    pk = F.concat(parent, F.lit(f"/{_escape(tag.rpartition('.')[2])}"))
    row = F.array(_struct(tag, pk, parent, F.lit(0), _payload(node, t)))
    inner = _emit(node, t, tag, pk)
    return [F.when(node.isNotNull(), F.concat(row, *inner) if inner else row).otherwise(_no_rows())]


def tagged_rows(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """The rows of all child tables of df in one pass, as TAGGED.

    A depth-first visitor over the schema builds one expression that emits,
    for each record, a row per array element, map entry and struct below
    `columns` (all but the key by default): no join and no shuffle. pk is the
    record's key followed by the path inside it, parent_pk the pk of what holds
    it (see escaped for keys with slashes); null elements keep their place in ord and make no row; null arrays,
    maps and structs make none. Records with a null key make no row. Copies of
    a record repeat its rows; distinct() removes them.
    """
    out: list[Column] = []
    for f in df.schema.fields:
        if f.name != key and (columns is None or f.name in columns) and _nested(f.dataType):
            out += _child(F.col(f"`{f.name}`"), f.dataType, f.name, escaped(F.col(f"`{key}`").cast("string")))
    if not out:
        return df.sparkSession.createDataFrame([], TAGGED)
    return df.where(F.col(f"`{key}`").isNotNull()).select(F.inline(F.concat(*out)))


def _visit(value, tag: str, pk: str, parent: str, ord_: int) -> Iterator[tuple[str, str, str, int, str]]:
    """Depth-first rows of a parsed JSON value, without recursion limits."""
    stack = [(value, tag, pk, parent, ord_)]
    while stack:
        x, tag, pk, parent, ord_ = stack.pop()
        if isinstance(x, dict):
            yield tag, pk, parent, ord_, json.dumps({k: v for k, v in x.items() if not isinstance(v, (dict, list))}, ensure_ascii=False)
            stack.extend((v, f"{tag}.{k}", f"{pk}/{_escape(k)}", pk, 0) for k, v in reversed(x.items()) if isinstance(v, (dict, list)))
        elif isinstance(x, list):
            yield tag, pk, parent, ord_, "{}"
            stack.extend((v, f"{tag}.item", f"{pk}/{i}", pk, i) for i, v in reversed(list(enumerate(x))) if v is not None)
        else:
            yield tag, pk, parent, ord_, json.dumps({"value": x}, ensure_ascii=False)


def _loads(text: str | None):
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        return None


def fact_objects(document, path: tuple[str, ...]) -> Iterator[tuple[dict, str]]:
    """(object, pred) of every object with a string pred below path, in reading order; steps of the path given as JSON text are read too."""
    x = document
    for step in path:
        if not isinstance(x, dict):
            return
        x = x.get(step)
        if isinstance(x, str):
            x = _loads(x)
    stack = [x]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if isinstance(x.get("pred"), str):
                yield x, x["pred"]
            stack.extend(reversed(x.values()))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def tagged_json(df: DataFrame, key: str, column: str, fact_path: tuple[str, ...] = (), only_facts: bool = False) -> DataFrame:
    """The rows of all child tables of a column of JSON texts, as TAGGED, each text parsed once.

    Tags are the paths of keys, with `.item` for the elements of arrays; the
    root has the tag `column` and the record's key as parent, also where it is
    an array. Damaged texts make no row. With a fact_path, objects with a
    string pred anywhere below it, wherever they are nested, are also emitted
    under the tag `fact_path` itself, ord counting them in reading order;
    only_facts leaves the other tags out.
    """
    fact_tag = ".".join(fact_path)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, text in zip(pdf.key, pdf.value, strict=True):
                value = _loads(text)
                if value is None:
                    continue
                k = _escape(k)
                if not only_facts:
                    out += _visit(value, column, f"{k}/{_escape(column)}", k, 0)
                if fact_path:
                    out += [(fact_tag, f"{k}/{_escape(fact_tag)}/{i}", k, i, json.dumps({"pred": p}, ensure_ascii=False)) for i, (_, p) in enumerate(fact_objects(value, fact_path))]
            yield pd.DataFrame(out, columns=["tag", "pk", "parent_pk", "ord", "payload"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(column).alias("value")).where("key is not null and value is not null")
    return rows.mapInPandas(visit, TAGGED)


def write_tables(tagged: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write all child tables in one go, a folder per tag."""
    tagged.write.mode(mode).partitionBy("tag").parquet(path)


def read_table(spark, path: str, tag: str, schema: str) -> DataFrame:
    """One child table: pk, parent_pk, ord and the payload's fields under schema. Reads only the folder of its tag."""
    rows = spark.read.schema(TAGGED).parquet(path).where(F.col("tag") == tag)
    return rows.select("pk", "parent_pk", "ord", F.from_json("payload", schema).alias("p")).select("pk", "parent_pk", "ord", "p.*")


def flat_leaves(observations: DataFrame, regulations: DataFrame) -> DataFrame:
    """(record_table, record_id, path, ord, leaf): the facts and operating systems of observations, the preconditions of regulations.

    Both tables go through their visitors once, the tagged rows are written by
    tag, and each child table is read back under its schema. The os is that of
    context.env or, where it has none, of the key `env.os` of context.extra. Of
    a regulation the state with the latest updated_at counts, if its JSON is
    whole. Copies of a record make equal rows, which count once.
    """
    os = F.coalesce(F.col("context.env.os"), F.col("context.extra")["env.os"])
    obs = observations.select(
        "observation_id",
        F.transform("facts", lambda f: F.when(f.isNotNull(), F.struct(f["pred"].alias("pred")))).alias("facts"),
        # the two places of the os as one optional struct, so that the visitor emits one row
        F.struct(F.when(os.isNotNull(), F.struct(os.alias("os"))).alias("env")).alias("context"),
    )
    now = latest_state(regulations.select("regulation_id", "updated_at", "arrived_at", "data"), "regulation_id", "updated_at", ["arrived_at"])
    spark = observations.sparkSession
    path = scratch_path(spark, "child-tables")
    # the struct that holds env has no column of its own here
    write_tables(tagged_rows(obs, "observation_id").where("tag <> 'context'"), path)
    write_tables(tagged_json(now, "regulation_id", "data", ("pattern", "pre"), only_facts=True), path, "append")
    facts = read_table(spark, path, "facts", "pred string").select(F.lit("observations").alias("record_table"), "parent_pk", F.lit("facts").alias("path"), "ord", F.col("pred").alias("leaf"))
    systems = read_table(spark, path, "context.env", "os string").select(F.lit("observations").alias("record_table"), F.regexp_replace("parent_pk", "/context$", "").alias("parent_pk"), F.lit("context.env.os").alias("path"), "ord", F.col("os").alias("leaf"))
    pre = read_table(spark, path, "pattern.pre", "pred string").select(F.lit("regulations").alias("record_table"), "parent_pk", F.lit("pattern.pre").alias("path"), "ord", F.col("pred").alias("leaf"))
    rows = facts.unionByName(systems).unionByName(pre)
    return rows.select("record_table", unescaped(F.col("parent_pk")).alias("record_id"), "path", "ord", "leaf").distinct()


def rule_sides(df: DataFrame, key: str, column: str, path: tuple[str, ...] = ("pattern",), sides: tuple[str, ...] = ("pre", "eff")) -> DataFrame:
    """(<key>, side, ord, pred, val): the facts below either side of a rule's JSON text, in reading order.

    val is a string's content or the JSON text of another value, null where
    there is none. Damaged texts make no row.
    """

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, text in zip(pdf.key, pdf.value, strict=True):
                value = _loads(text)
                for side in sides:
                    out += [(k, side, i, p, v) for i, p, v in _facts_with_values(value, (*path, side))]
            yield pd.DataFrame(out, columns=[key, "side", "ord", "pred", "val"])

    rows = df.select(F.col(key).alias("key"), F.col(column).alias("value")).where("key is not null and value is not null")
    return rows.mapInPandas(visit, f"`{key}` string, side string, ord long, pred string, val string")


def _facts_with_values(document, path: tuple[str, ...]) -> Iterator[tuple[int, str, str | None]]:
    for n, (fact, pred) in enumerate(fact_objects(document, path)):
        v = fact.get("value")
        yield n, pred, v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def rule_args(df: DataFrame, key: str, column: str, path: tuple[str, ...] = ("pattern",), sides: tuple[str, ...] = ("pre", "eff")) -> DataFrame:
    """(<key>, side, pred, args): the arguments of each fact of a rule as a map of strings, null where it has none."""

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, text in zip(pdf.key, pdf.value, strict=True):
                value = _loads(text)
                for side in sides:
                    for fact, pred in fact_objects(value, (*path, side)):
                        args = fact.get("args")
                        out.append((k, side, pred, {a: v if v is None or isinstance(v, str) else json.dumps(v) for a, v in args.items()} if isinstance(args, dict) else None))
            yield pd.DataFrame(out, columns=[key, "side", "pred", "args"])

    rows = df.select(F.col(key).alias("key"), F.col(column).alias("value")).where("key is not null and value is not null")
    return rows.mapInPandas(visit, f"`{key}` string, side string, pred string, args map<string,string>")


_PATTERN = "array<struct<pred:string,val:string,args:array<struct<k:string,v:string>>>>"


def rule_patterns(df: DataFrame, key: str, column: str, path: tuple[str, ...] = ("pattern",), sides: tuple[str, ...] = ("pre", "eff"), scope: str = "scope") -> DataFrame:
    """(<key>, <sides>, scope): the facts of either side of a rule with their arguments as sorted pairs, in reading order, and the rule's scope as sorted pairs.

    Values, arguments and scope entries are a string's content or the JSON text
    of another value. Damaged texts make no row; a scope that is no object is empty.
    """
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    pairs = lambda x: [{"k": k, "v": plain(v)} for k, v in sorted(x.items())] if isinstance(x, dict) else []

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for k, text in zip(pdf.key, pdf.value, strict=True):
                value = _loads(text)
                if value is None:
                    continue
                facts = [[{"pred": p, "val": plain(f.get("value")), "args": pairs(f.get("args"))} for f, p in fact_objects(value, (*path, side))] for side in sides]
                out.append((k, *facts, pairs(value.get(scope) if isinstance(value, dict) else None)))
            yield pd.DataFrame(out, columns=[key, *sides, "scope"])

    rows = df.select(F.col(key).alias("key"), F.col(column).alias("value")).where("key is not null and value is not null")
    return rows.mapInPandas(visit, f"`{key}` string, " + ", ".join(f"{s} {_PATTERN}" for s in sides) + ", scope array<struct<k:string,v:string>>")
