"""Facts: signatures, matching of patterns, validity in time, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.session import materialize

#: Up to this many members a row's subsets are enumerated; there are 2 to this power at most.
ENUMERATED = 10


def signature(pred: Column, value: Column, args: Column | None = None) -> Column:
    """pred|value, or pred|k:v,..|value with the arguments in order of their keys."""
    if args is None:
        return F.concat_ws("|", pred, value)
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ",")
    return F.concat_ws("|", pred, F.when(F.size(args) > 0, joined), value)


def is_variable(col: Column) -> Column:
    return F.coalesce(col.startswith("?"), F.lit(False))


def is_wildcard(col: Column) -> Column:
    return F.coalesce(col == "*", F.lit(False))


def args_unify(pattern: Column, args: Column) -> Column:
    """Whether args has all entries of pattern; `*` and a variable match anything, and a variable used twice must meet equal values."""
    entries = F.map_entries(pattern)
    known = F.coalesce(args, F.create_map().cast("map<string,string>"))
    fits = F.forall(entries, lambda e: F.map_contains_key(known, e["key"]) & (is_wildcard(e["value"]) | is_variable(e["value"]) | known[e["key"]].eqNullSafe(e["value"])))
    variables = F.filter(entries, lambda e: is_variable(e["value"]))
    bound = F.transform(variables, lambda e: F.struct(e["value"].alias("k"), known[e["key"]].alias("v")))
    consistent = F.size(F.array_distinct(bound)) == F.size(F.array_distinct(F.transform(variables, lambda e: e["value"])))
    return F.coalesce(fits & consistent, F.lit(True))


def substitute(args: Column, bindings: Column) -> Column:
    """args with bound variables replaced."""
    return F.transform_values(args, lambda k, v: F.coalesce(F.element_at(bindings, v), v))


def scope_compatible(scope: Column, context: Column) -> Column:
    """Whether every entry of scope is an entry of context; an empty or null scope fits all."""
    return F.coalesce(F.forall(F.map_entries(scope), lambda e: context[e["key"]].eqNullSafe(e["value"])), F.lit(True))


def improved(val: Column) -> Column:
    """Whether a value says that something got better."""
    low = F.lower(val)
    return low.isin("true", "improved", "fixed", "resolved") | low.contains("improv")


def degraded(val: Column) -> Column:
    """Whether a value says that something got worse."""
    low = F.lower(val)
    return low.isin("false", "degraded", "broken", "failed") | low.contains("degrad") | low.contains("fail")


def subset(small: Column, large: Column) -> Column:
    return F.size(F.array_except(small, large)) == 0


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def valid_at(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Half-open validity; a missing end is open."""
    return (valid_from.isNull() | (at >= valid_from)) & (valid_to.isNull() | (at < valid_to))


def versions(df: DataFrame, keys: list[str], valid_from: str) -> DataFrame:
    """df with valid_to: the start of the next version of the same keys."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(valid_from))
    return df.withColumn("valid_to", F.lead(valid_from).over(w))


def satisfying(rules: DataFrame, observations: DataFrame, facts: DataFrame, needed: str = "pre") -> DataFrame:
    """(regulation_id, observation_id): observations that have every signature of a rule's `needed` array.

    Each rule is looked up by its rarest signature only, so frequent ones never
    multiply rows; the others are then checked on the observation's array.
    Rules that need nothing match nothing here.
    """
    counts = facts.select("observation_id", "sig").distinct().groupBy("sig").agg(F.count("*").alias("n"))
    exploded = rules.select("regulation_id", F.explode(needed).alias("sig"))
    rarest = exploded.join(counts, "sig", "left").groupBy("regulation_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sig")).alias("a")).where("a.n > 0").select("regulation_id", F.col("a.sig").alias("sig"))
    hits = rarest.join(facts.select("observation_id", "sig").distinct(), "sig").select("regulation_id", "observation_id")
    return hits.join(rules.select("regulation_id", needed), "regulation_id").join(observations.select("observation_id", "sigs"), "observation_id").where(subset(F.col(needed), F.col("sigs"))).select("regulation_id", "observation_id")


def containing(needs: DataFrame, members: DataFrame, **counts: Column) -> DataFrame:
    """(need, n, <counts>): of how many keys the members hold all of each need; needs that none holds are left out.

    needs: need, sorted arrays of distinct texts, empty ones count nothing.
    members: key, sig, distinct rows. counts: conditions on key, each counted
    apart. Keys with the same members among those needed are counted as one.
    Their subsets of the needs' sizes are enumerated and summed up, which is
    linear in the keys; those with more than ENUMERATED members are looked up
    by each need's rarest member. No row stands for a pair of a need and a key.
    """
    asked = needs.where(F.size("need") > 0).select("need").distinct()
    numbers = asked.select(F.explode("need").alias("sig")).distinct().withColumn("number", F.monotonically_increasing_id())
    numbers = materialize(numbers, "member-numbers")
    sums = ["n", *counts]
    whose = members.join(numbers, "sig").groupBy("key").agg(F.array_sort(F.collect_list("number")).alias("own"))  # a record's members
    alike = whose.groupBy("own").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    alike = materialize(alike, "members")
    of = asked.select("need", F.explode("need").alias("sig")).join(numbers, "sig").groupBy("need").agg(F.array_sort(F.collect_list("number")).alias("set"))
    of = materialize(of, "needs")
    most = of.agg(F.max(F.size("set")).alias("m")).first()["m"] or 0  # one value
    none = F.array(F.array().cast("array<bigint>"))
    subsets = F.aggregate("own", none, lambda acc, x: F.concat(acc, F.transform(F.filter(acc, lambda s: F.size(s) < most), lambda s: F.array_append(s, x))))
    few = alike.where(F.size("own") <= ENUMERATED).select(*sums, F.explode(subsets).alias("set")).groupBy("set").agg(*[F.sum(c).alias(c) for c in sums])
    many = alike.where(F.size("own") > ENUMERATED)
    held = many.select("*", F.explode("own").alias("number"))
    rarity = held.groupBy("number").agg(F.count("*").alias("c"))
    rarest = of.select("set", F.explode("set").alias("number")).join(rarity, "number", "left").groupBy("set").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "number")).alias("r")).where("r.c > 0").select("set", F.col("r.number").alias("number"))
    wide = held.join(rarest, "number").where(subset(F.col("set"), F.col("own"))).groupBy("set").agg(*[F.sum(c).alias(c) for c in sums])
    out = of.join(few.unionByName(wide), "set").groupBy("need").agg(*[F.sum(c).alias(c) for c in sums])
    return out


def pair_counts(sets: DataFrame, key: str, members: str) -> DataFrame:
    """(a, b, n): in how many rows each pair a < b of members occurs together.

    Pairs are made inside each row's array, which is one record, and combined
    before the shuffle.
    """
    m = F.array_sort(F.array_distinct(members))
    pairs = F.flatten(F.transform(m, lambda x: F.transform(F.filter(m, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def scope_contains(a: Column, b: Column) -> Column:
    """Whether scope a contains scope b: equal env, version and project where both are set, a's stack holds b's, a's time range encloses b's.

    Scopes are structs(env, version, project, stack array, time_from, time_to); null ends are open.
    """
    same = F.lit(True)
    for f in ("env", "version", "project"):
        same &= a[f].isNull() | b[f].isNull() | (a[f] == b[f])
    none = F.array().cast("array<string>")
    stack = F.size(F.array_except(F.coalesce(b["stack"], none), F.coalesce(a["stack"], none))) == 0
    begin = a["time_from"].isNull() | F.coalesce(a["time_from"] <= b["time_from"], F.lit(False))
    end = a["time_to"].isNull() | F.coalesce(a["time_to"] >= b["time_to"], F.lit(False))
    return same & stack & begin & end


def scopes_overlap(a: Column, b: Column) -> Column:
    """Whether two scopes can hold at once: no conflict in env or project, a common stack item where both have some, overlapping times."""
    ok = F.lit(True)
    for f in ("env", "project"):
        ok &= a[f].isNull() | b[f].isNull() | (a[f] == b[f])
    some = F.coalesce(F.size(a["stack"]) > 0, F.lit(False)) & F.coalesce(F.size(b["stack"]) > 0, F.lit(False))
    ok &= ~some | F.arrays_overlap(a["stack"], b["stack"])
    ok &= F.coalesce(a["time_from"] <= b["time_to"], F.lit(True)) & F.coalesce(b["time_from"] <= a["time_to"], F.lit(True))
    return ok


def merge_scopes(a: Column, b: Column) -> Column:
    """The union of two scopes: scalars that agree or stand alone, all stack items, the outer times (open if either is)."""
    one = [F.when(a[f].isNull() | (a[f] == b[f]), b[f]).when(b[f].isNull(), a[f]).alias(f) for f in ("env", "version", "project")]
    none = F.array().cast("array<string>")
    both = lambda f, pick: F.when(a[f].isNotNull() & b[f].isNotNull(), pick(a[f], b[f])).alias(f)
    return F.struct(*one, F.array_union(F.coalesce(a["stack"], none), F.coalesce(b["stack"], none)).alias("stack"), both("time_from", F.least), both("time_to", F.greatest))


def common_entries(maps: Column) -> Column:
    """The entries that all maps of an array have; empty for an empty array."""
    first = F.coalesce(F.get(maps, F.lit(0)), F.create_map().cast("map<string,string>"))
    return F.map_filter(first, lambda k, v: F.forall(maps, lambda m: m[k].eqNullSafe(v) & F.map_contains_key(m, k)))
