"""The frames most queries start from, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators import explain, reasoning
from causeway.operators.flatten import rule_patterns as rule_patterns_of
from causeway.operators.flatten import rule_sides
from causeway.operators.hierarchy import latest_state
from causeway.operators.pivot import attribute_key, json_scalar
from causeway.tables import load


def facts(spark: SparkSession, d: str) -> DataFrame:
    """(observation_id, client, project, ord, pred, val, sig): the facts of observations that have a value, copies of a record removed."""
    obs = load(spark, d, "observations").select("observation_id", "client", "project", F.posexplode("facts").alias("ord", "f"))
    s = json_scalar(F.col("f.value"))
    out = obs.select("observation_id", "client", "project", F.col("ord").cast("long").alias("ord"), attribute_key(F.col("f.pred")).alias("pred"), s.alias("s")).where("pred is not null and s.kind <> 'null'")
    val = F.when(F.col("s.kind") == "string", F.trim(F.col("s.text"))).otherwise(F.col("s.text"))
    return out.withColumn("val", val).drop("s").where("observation_id is not null").distinct().withColumn("sig", F.concat_ws("|", "pred", "val"))


def context_entries() -> Column:
    """The context of an observation as a map of dotted keys, without nulls; a key of `extra` counts where its proper place has nothing."""
    c = F.col("context")
    own = {"shift": c.shift, "env.os": c.env.os, "env.arch": c.env.arch, "env.runtime.name": c.env.runtime["name"], "env.runtime.level": c.env.runtime.level.cast("string")}
    place = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    extra = F.map_filter(F.coalesce(c.extra, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~F.map_contains_key(place, k))
    return F.when(c.isNotNull(), F.map_concat(place, extra)).otherwise(F.create_map().cast("map<string,string>"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """(observation_id, key, value): the distinct context entries of each observation."""
    o = load(spark, d, "observations").where("observation_id is not null")
    return o.select("observation_id", F.explode(context_entries()).alias("key", "value")).distinct()


#: Values that are their own text: words and numbers without quotes or white space around them.
_PLAIN = r"\A[A-Za-z0-9.+-]+\z"


def observation_patterns(spark: SparkSession, d: str) -> DataFrame:
    """(observation_id, goals, known, context): of each observation the goals (its focus, else all its facts), what is known (facts, then context) and its context, in the form of explain.

    Facts without pred or value are none. Copies of a record are equal but for their arrival, so any of them counts.
    """
    o = load(spark, d, "observations").where("observation_id is not null").groupBy("observation_id").agg(F.first(F.struct("facts", "focus_facts", "context")).alias("o"))
    o = o.select("observation_id", "o.facts", "o.focus_facts", "o.context").withColumn("entries", explain.pairs(context_entries()))
    none = F.array().cast(f"array<{explain.FACT}>")

    def read(facts: str, args) -> Column:
        def one(f: Column) -> Column:
            # the scalar is read once, not at each of its uses; the values of most facts are plain
            read_ = lambda s: F.when(s["kind"] != "null", explain.fact(attribute_key(f["pred"]), F.when(s["kind"] == "string", F.trim(s["text"])).otherwise(s["text"]), args(f)))
            return F.when(f["value"].rlike(_PLAIN) & (f["value"] != "null"), explain.fact(attribute_key(f["pred"]), f["value"], args(f))).otherwise(explain.once(json_scalar(f["value"]), read_))

        return F.filter(F.transform(facts, one), lambda f: f["pred"].isNotNull())

    # the facts are read in a step of their own, since each member of a focus looks at all of them
    o = o.withColumns({"facts": F.coalesce(read("facts", lambda f: explain.pairs(f["args"])), none), "focus": read("focus_facts", lambda f: F.array().cast(explain.PAIRS))})
    facts, focus = F.col("facts"), F.col("focus")
    about = F.transform("entries", lambda e: explain.fact(e["k"], e["v"], F.array().cast(explain.PAIRS)))
    # a focus names facts without their arguments: they are those of the first such fact
    meant = F.transform(focus, lambda g: F.coalesce(F.get(F.filter(facts, lambda f: (f["pred"] == g["pred"]) & f["val"].eqNullSafe(g["val"])), F.lit(0)), g))
    return o.select("observation_id", F.coalesce(meant, facts).alias("goals"), F.concat(facts, about).alias("known"), F.col("entries").alias("context"))


def rule_patterns(spark: SparkSession, d: str) -> DataFrame:
    """(regulation_id, score, scope, pre, eff) of the rules that are not retired, in the form of explain."""
    sets = reasoning.scored(rule_sets(spark, d)).where("status is null or status <> 'retired'").select("regulation_id", "score")
    return sets.join(rule_patterns_of(_latest(spark, d), "regulation_id", "data"), "regulation_id").select("regulation_id", "score", "scope", "pre", "eff")


def rule_scopes(spark: SparkSession, d: str) -> DataFrame:
    """(regulation_id, scope): the scope of each rule as sorted pairs."""
    return rule_patterns_of(_latest(spark, d), "regulation_id", "data").select("regulation_id", "scope")


def rules(spark: SparkSession, d: str) -> DataFrame:
    """(regulation_id, status, kind, s, c, updated_at): the latest state of each rule whose JSON is whole, with its evidence counts."""
    now = _latest(spark, d)
    count = lambda p: F.coalesce(F.get_json_object("data", p).cast("long"), F.lit(0))
    return now.where(F.get_json_object("data", "$").isNotNull()).select(
        "regulation_id", "status", F.get_json_object("data", "$.evidence.kind").alias("kind"), count("$.evidence.support_n").alias("s"), count("$.evidence.counterexample_n").alias("c"), "updated_at"
    )


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_state(load(spark, d, "regulations").select("regulation_id", "updated_at", "arrived_at", "data", "status"), "regulation_id", "updated_at", ["arrived_at"]).where("regulation_id is not null")


def rule_facts(spark: SparkSession, d: str) -> DataFrame:
    """(regulation_id, side, ord, pred, val, sig): the facts of both sides of each rule, side pre or eff."""
    return rule_sides(_latest(spark, d), "regulation_id", "data").withColumn("sig", F.concat_ws("|", "pred", "val"))


def rule_sets(spark: SparkSession, d: str) -> DataFrame:
    """rules with pre, eff (sorted distinct signatures) and pre_preds, eff_preds."""
    sides = rule_facts(spark, d).groupBy("regulation_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col(c)))).alias(n) for n, side, c in (("pre", "pre", "sig"), ("eff", "eff", "sig"), ("pre_preds", "pre", "pred"), ("eff_preds", "eff", "pred"))]
    )
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return rules(spark, d).join(sides, "regulation_id", "left").select(
        "regulation_id", "status", "kind", "s", "c", "updated_at", *[empty(c) for c in ("pre", "eff", "pre_preds", "eff_preds")]
    )


def observation_sets(spark: SparkSession, d: str) -> DataFrame:
    """(observation_id, project, sigs, preds): each observation's distinct signatures and preds, sorted."""
    return facts(spark, d).groupBy("observation_id").agg(F.min("project").alias("project"), F.array_sort(F.collect_set("sig")).alias("sigs"), F.array_sort(F.collect_set("pred")).alias("preds"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind, weight, evidence, mode): the rule graph, an edge from each precondition to each effect.

    Parallel edges of several rules are one: the best weight s / (s + c), the
    summed support, compiled as soon as one rule is confirmed.
    """
    f = rule_facts(spark, d).select("regulation_id", "side", "sig").distinct()
    pre, eff = (f.where(F.col("side") == s).select("regulation_id", F.col("sig").alias(n)) for s, n in (("pre", "src"), ("eff", "dst")))
    r = rules(spark, d).where("status <> 'retired'")
    both = pre.join(eff, "regulation_id").join(r, "regulation_id").where("src <> dst")
    weight = F.when(F.col("s") + F.col("c") > 0, F.col("s") / (F.col("s") + F.col("c"))).otherwise(0.3)
    return both.groupBy("src", "dst").agg(
        F.lit("causes").alias("kind"), F.max(weight).alias("weight"), F.sum("s").alias("evidence"), F.max((F.col("status") == "confirmed").cast("int")).alias("__c")
    ).select("src", "dst", "kind", "weight", "evidence", F.when(F.col("__c") == 1, "compiled").otherwise("tentative").alias("mode"))


def typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind, weight, evidence, mode): the graph with all kinds of edges.

    A precondition causes, prevents (effects that are false, no or off) or, by
    observation only, indicates an effect; a fact is_a predicate, a predicate
    is part_of its device, and the predicates of a confirmed rule's effects
    require those of its preconditions. Parallel edges of one kind are one, as
    in edges().
    """
    f = rule_facts(spark, d).select("regulation_id", "side", "sig", "pred", "val").distinct()
    r = rules(spark, d).where("status <> 'retired'")
    weight = F.when(F.col("s") + F.col("c") > 0, F.col("s") / (F.col("s") + F.col("c"))).otherwise(0.3)
    kind = F.when(F.col("kind") == "observational", "indicates").when(F.col("val").isin("false", "no", "off"), "prevents").otherwise("causes")
    pre, eff = f.where("side = 'pre'"), f.where("side = 'eff'")
    row = ["src", "dst", "kind", "w", "s", "m"]
    both = pre.select("regulation_id", F.col("sig").alias("src")).distinct().join(eff.select("regulation_id", F.col("sig").alias("dst"), "val").distinct(), "regulation_id").join(r, "regulation_id").where("src <> dst")
    out = both.select("src", "dst", kind.alias("kind"), weight.alias("w"), "s", (F.col("status") == "confirmed").cast("int").alias("m"))
    fixed = lambda t, k: t.distinct().select("src", "dst", F.lit(k).alias("kind"), F.lit(1.0).alias("w"), F.lit(0).cast("long").alias("s"), F.lit(1).alias("m"))
    out = out.unionByName(fixed(f.where("sig <> pred").select(F.col("sig").alias("src"), F.col("pred").alias("dst")), "is_a"))
    out = out.unionByName(fixed(f.where(F.col("pred").contains(".")).select(F.col("pred").alias("src"), F.split("pred", "[.]")[0].alias("dst")), "part_of"))
    needs = eff.select("regulation_id", F.col("pred").alias("src")).distinct().join(pre.select("regulation_id", F.col("pred").alias("dst")).distinct(), "regulation_id").join(r.where("status = 'confirmed'"), "regulation_id").where("src <> dst")
    out = out.unionByName(needs.select("src", "dst", F.lit("requires").alias("kind"), weight.alias("w"), "s", F.lit(1).alias("m")).select(*row))
    g = out.groupBy("src", "dst", "kind").agg(F.max("w").alias("weight"), F.sum("s").alias("evidence"), F.max("m").alias("m"))
    return g.select("src", "dst", "kind", "weight", "evidence", F.when(F.col("m") == 1, "compiled").otherwise("tentative").alias("mode"))


def stories(spark: SparkSession, d: str) -> DataFrame:
    """One row per story: the first to arrive of its copies."""
    t = load(spark, d, "stories").where("id is not null")
    cols = [c for c in t.columns if c not in ("id", "arrived_at")]
    return t.groupBy("id").agg(F.min(F.struct("arrived_at", *cols)).alias("v")).select("id", "v.arrived_at", *[F.col("v")[c].alias(c) for c in cols])


SQL = r"""
with recursive obs_rows as (select distinct observation_id, client, project, unnest(facts) f, generate_subscripts(facts, 1) - 1 ord from observations where observation_id is not null),
facts as (
  select distinct observation_id, client, project, cast(ord as bigint) ord, lower(trim(f.pred)) pred, trim(case when json_type(f.value) = 'VARCHAR' then cast(f.value as json) ->> '$' else f.value end) val,
    lower(trim(f.pred)) || '|' || trim(case when json_type(f.value) = 'VARCHAR' then cast(f.value as json) ->> '$' else f.value end) sig
  from obs_rows where f.pred is not null and f.value is not null and trim(f.value) <> 'null'
),
reg_latest as (select regulation_id, data, status, updated_at from (select *, row_number() over (partition by regulation_id order by updated_at desc nulls last, arrived_at desc nulls last, data desc) rn from regulations where regulation_id is not null) where rn = 1 and json_valid(data)),
rules as (select regulation_id, status, json_extract_string(data, '$.evidence.kind') kind, coalesce(cast(json_extract_string(data, '$.evidence.support_n') as bigint), 0) s, coalesce(cast(json_extract_string(data, '$.evidence.counterexample_n') as bigint), 0) c, updated_at from reg_latest),
pat as (select regulation_id, case when json_type(json_extract(data, '$.pattern')) = 'VARCHAR' then case when json_valid(json_extract_string(data, '$.pattern')) then json_extract_string(data, '$.pattern') end else cast(json_extract(data, '$.pattern') as varchar) end p from reg_latest),
sides as (select regulation_id, side, case when json_type(json_extract(p, '$.' || side)) = 'VARCHAR' then case when json_valid(json_extract_string(p, '$.' || side)) then json_extract_string(p, '$.' || side) end else cast(json_extract(p, '$.' || side) as varchar) end x from pat, (values ('pre'), ('eff')) v(side) where p is not null),
rule_facts as (
  select regulation_id, side, row_number() over (partition by regulation_id, side order by t.id) - 1 ord, json_extract_string(t.value, '$.pred') pred, json_extract_string(t.value, '$.value') val,
    json_extract_string(t.value, '$.pred') || coalesce('|' || json_extract_string(t.value, '$.value'), '') sig
  from sides, json_tree(sides.x) t where x is not null and t.type = 'OBJECT' and json_type(json_extract(t.value, '$.pred')) = 'VARCHAR'
),
rule_sets as (
  select r.*, coalesce(f.pre, []) pre, coalesce(f.eff, []) eff, coalesce(f.pre_preds, []) pre_preds, coalesce(f.eff_preds, []) eff_preds from rules r left join (
    select regulation_id, list_sort(list_distinct(list(sig) filter (side = 'pre'))) pre, list_sort(list_distinct(list(sig) filter (side = 'eff'))) eff, list_sort(list_distinct(list(pred) filter (side = 'pre'))) pre_preds, list_sort(list_distinct(list(pred) filter (side = 'eff'))) eff_preds from rule_facts group by 1) f using (regulation_id)
),
observation_sets as (select observation_id, min(project) project, list_sort(list_distinct(list(sig))) sigs, list_sort(list_distinct(list(pred))) preds from facts group by 1),
edges as (
  select a.sig src, b.sig dst, 'causes' kind, max(case when s + c > 0 then s / (s + c) else 0.3 end) weight, cast(sum(s) as bigint) evidence, case when max(case when status = 'confirmed' then 1 else 0 end) = 1 then 'compiled' else 'tentative' end as mode
  from (select distinct regulation_id, sig from rule_facts where side = 'pre') a join (select distinct regulation_id, sig from rule_facts where side = 'eff') b using (regulation_id) join rules r using (regulation_id) where status <> 'retired' and a.sig <> b.sig group by 1, 2
),
story as (select distinct on (id) * from stories where id is not null order by id, arrived_at),
ctx_rows as (select observation_id, unnest([{k: 'shift', v: context.shift}, {k: 'env.os', v: context.env.os}, {k: 'env.arch', v: context.env.arch}, {k: 'env.runtime.name', v: context.env.runtime.name}, {k: 'env.runtime.level', v: cast(context.env.runtime.level as varchar)}]) e from observations where observation_id is not null),
ctx_own as (select distinct observation_id, e.k k, e.v v from ctx_rows where e.v is not null),
ctx as (select * from ctx_own union select x.observation_id, x.e.key, x.e.value from (select observation_id, unnest(map_entries(context.extra)) e from observations where observation_id is not null) x left join ctx_own o on o.observation_id = x.observation_id and o.k = x.e.key where x.e.value is not null and o.k is null),
scope as (select regulation_id, t.key k, json_extract_string(t.value, '$') v from reg_latest, json_each(json_extract(data, '$.scope')) t where json_type(json_extract(data, '$.scope')) = 'OBJECT'),
goal_rows as (select observation_id, unnest(case when focus_facts is not null then list_transform(focus_facts, lambda x: {'pred': x.pred, 'value': x.value}) else list_transform(facts, lambda x: {'pred': x.pred, 'value': x.value}) end) f from observations where observation_id is not null),
goals as (select distinct observation_id, pred, val, pred || '|' || val sig from (select observation_id, lower(trim(f.pred)) pred, trim(case when json_type(f.value) = 'VARCHAR' then cast(f.value as json) ->> '$' else f.value end) val from goal_rows where f.pred is not null and f.value is not null and trim(f.value) <> 'null'))
"""
