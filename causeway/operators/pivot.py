"""Entity-attribute-value rows into one typed row per entity, with reported conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.text import strip

#: The most attributes that become columns; values of further attributes are kept in the map column `other`.
MAX_COLUMNS = 2000

_JSON_NUMBER = r"\A-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
_DECIMAL = r"\A[+-]?(?:(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
# The spellings of booleans.
_TRUE = ("true", "yes", "on", "t", "y", "1")
_FALSE = ("false", "no", "off", "f", "n", "0")


def attribute_key(col: Column) -> Column:
    """The compared form of an attribute name: lower case without white space around it."""
    return F.lower(strip(col))


def json_scalar(value: Column) -> Column:
    """struct(kind, text) of a JSON scalar's text: kind is null, string, number, boolean or broken; text the string's content or the literal."""
    raw = strip(value)
    quoted = raw.rlike(r'(?s)\A".*"\z')
    # get_json_object unescapes; a text without a backslash needs no parser
    plain = F.when(~raw.contains("\\"), F.when(raw.rlike(r'(?s)\A"[^"]*"\z'), raw.substr(F.lit(2), F.length(raw) - 2))).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
    kind = (
        F.when(raw.isNull() | (raw == "null"), "null")
        .when(quoted & plain.isNotNull(), "string")
        .when(raw.rlike(_JSON_NUMBER), "number")
        .when(raw.isin("true", "false"), "boolean")
        .otherwise("broken")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "string", plain).otherwise(raw).alias("text"))


def typed_text(kind: Column, text: Column, value_type: Column) -> Column:
    """The canonical text of a scalar under number, boolean or text (any other type name means text); null if it does not fit.

    Numbers compare as doubles, so 49, 4.9e1 and "+49" are one value.
    """
    scalar = kind.isin("string", "number", "boolean")
    trimmed = F.when(kind == "string", strip(text)).otherwise(text)
    number = F.when(kind.isin("string", "number") & trimmed.rlike(_DECIMAL), F.regexp_replace(trimmed, ",", "").try_cast("double"))
    number = F.when(number == 0, F.lit(0.0)).otherwise(number)  # -0 is 0
    low = F.lower(trimmed)
    as_number = trimmed.try_cast("double")
    boolean = (
        F.when(kind == "number", F.when(as_number == 1, "true").when(as_number == 0, "false"))
        .when(scalar & low.isin(*_TRUE), "true")
        .when(scalar & low.isin(*_FALSE), "false")
    )
    return F.when(value_type == "number", number.cast("string")).when(value_type == "boolean", boolean).otherwise(F.when(scalar, trimmed))


def long_facts(df: DataFrame, entity: str, facts: str) -> DataFrame:
    """(entity, attr, value): one row per fact of the array column; null arrays, null facts and facts without a name give none."""
    return df.select(F.col(entity).alias("entity"), F.explode(facts).alias("f")).select("entity", attribute_key(F.col("f.pred")).alias("attr"), F.col("f.value").alias("value")).where("entity is not null and attr is not null")


def type_list(types: DataFrame, attr: str, value_type: str) -> DataFrame:
    """(attr, value_type) with one row per attribute; an attribute listed twice takes the type first in order."""
    return types.select(attribute_key(F.col(attr)).alias("attr"), F.col(value_type).alias("value_type")).where("attr is not null").groupBy("attr").agg(F.min("value_type").alias("value_type"))


def cells(long: DataFrame, types: DataFrame) -> DataFrame:
    """(entity, attr, value_type, low, high, misfits, fits): each cell of the wide table with its duplicates resolved.

    low and high are the smallest and the greatest fitting canonical value:
    equal means one value, different means conflict, null means that none
    fits. Null values count for nothing, and a cell of only those has no row.
    The type list is joined by size (Spark broadcasts it while it is small).
    Values are combined before the shuffle, so repeated rows and hot entities
    cost no more than their distinct cells.
    """
    scalar = json_scalar(F.col("value"))
    typed = long.select("entity", "attr", scalar.alias("s")).where("s.kind <> 'null'").join(types, "attr", "left").select("entity", "attr", F.coalesce("value_type", F.lit("text")).alias("value_type"), typed_text(F.col("s.kind"), F.col("s.text"), F.coalesce("value_type", F.lit("text"))).alias("v"))
    return typed.groupBy("entity", "attr", "value_type").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.when(F.col("v").isNull(), 1).otherwise(0)).alias("misfits"), F.count("v").alias("fits")
    )


def discover(long: DataFrame, types: DataFrame, most: int = MAX_COLUMNS) -> list[tuple[str, str]]:
    """The attributes of long (column attr) that get a column, with their types, by name: the listed ones first, at most `most`."""
    found = long.select("attr").distinct()
    rows = (
        types.withColumn("listed", F.lit(0)).unionByName(found.join(types, "attr", "left_anti").select("attr", F.lit("text").alias("value_type"), F.lit(1).alias("listed")))
        .orderBy("listed", "attr").limit(most).collect()
    )  # bounded by `most`
    return [(r["attr"], r["value_type"]) for r in rows]


def column_name(attr: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "_" for c in attr) or "_"


def wide(cell: DataFrame, attributes: list[tuple[str, str]], entities: DataFrame | None = None) -> DataFrame:
    """One row per entity with one typed column per attribute, by one conditional aggregation each.

    A cell with one fitting value holds it, cast to double, boolean or string;
    a cell with several different ones is null and named in the array
    `conflict`; one with a value that does not fit its type is named in
    `untyped`, and is null if nothing fits. Attributes beyond `attributes` go
    to the map `other`. entities: a frame with the column entity, whose rows
    without any cell get a row of nulls. Column names are made of the
    attribute's letters and digits; where two attributes would clash, or hit
    entity, conflict, untyped or other, the later gets a number.
    """
    sql_type = {"number": "double", "boolean": "boolean"}
    used, cols = {"entity", "conflict", "untyped", "other"}, []
    # attributes are told apart by their number, not by comparing texts in each aggregation; at most MAX_COLUMNS rows
    numbered = F.broadcast(cell.sparkSession.createDataFrame([(a, i) for i, (a, _) in enumerate(attributes)], "attr string, __i int"))
    for i, (attr, kind) in enumerate(attributes):
        base = name = column_name(attr)
        k = 1
        while name in used:
            k += 1
            name = f"{base}_{k}"
        used.add(name)
        cols.append(F.max(F.when(F.col("__i") == i, F.col("one").cast(sql_type.get(kind, "string")))).alias(name))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("attr"))))  # at most an entity's attributes
    other = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("__i").isNull() & F.col("one").isNotNull(), F.struct("attr", "one")))))
    marked = cell.join(numbered, "attr", "left").withColumn("one", F.when(F.col("low") == F.col("high"), F.col("low")))
    out = marked.groupBy("entity").agg(*cols, names(F.col("low") != F.col("high")).alias("conflict"), names(F.col("misfits") > 0).alias("untyped"), other.alias("other"))
    return out if entities is None else entities.select("entity").where("entity is not null").distinct().join(out, "entity", "left")


def issues(table: DataFrame) -> DataFrame:
    """(entity, attr, issue) of a wide() table: its cells that could not be filled rightly. Spark drops the columns it does not read before the pivot."""
    named = lambda issue: F.transform(issue, lambda a: F.struct(a.alias("attr"), F.lit(issue).alias("issue")))
    found = F.concat(named("conflict"), named("untyped"))
    return table.select("entity", F.explode(found).alias("c")).select("entity", "c.attr", "c.issue")


def long_again(table: DataFrame, attributes: list[tuple[str, str]]) -> DataFrame:
    """(entity, attr, value) of a wide() table: its filled cells as texts, and its other attributes."""
    fixed = ("entity", "conflict", "untyped", "other")
    cols = [c for c in table.columns if c not in fixed]
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"`{c}`").cast("string").alias("value")) for (a, _), c in zip(attributes, cols, strict=True)])
    rest = F.transform(F.map_entries("other"), lambda e: F.struct(e["key"].alias("attr"), e["value"].alias("value")))
    both = F.concat(cells, F.coalesce(rest, F.array().cast("array<struct<attr:string,value:string>>")))
    return table.select("entity", F.explode(both).alias("c")).select("entity", "c.attr", "c.value").where("value is not null")
