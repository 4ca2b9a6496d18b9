"""Explanation of observations by backward chaining with unification: one beam search over all observations at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators import beam as held
from causeway.session import materialize, materialize_counted
from causeway.skew import hot_of_counts, salted_join

# What an assumption and a rule cost, and how far the search goes.
ASSUMPTION_COST, RULE_COST = 1.2, 0.05
BEAM, DEPTH, TOP = 20, 8, 5

PAIRS = "array<struct<k:string,v:string>>"
FACT = f"struct<pred:string,val:string,args:{PAIRS}>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _of(pairs: Column, key: Column) -> Column:
    return F.get(F.filter(pairs, lambda e: e["k"] == key), F.lit(0))["v"]


def _variable(col: Column) -> Column:
    return F.coalesce(col.startswith("?"), F.lit(False))


def pairs(args: Column) -> Column:
    """A map as sorted pairs, which can be compared; empty for null."""
    return F.coalesce(F.array_sort(F.transform(F.map_entries(args), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))), F.array().cast(PAIRS))


def fact(pred: Column, val: Column, args: Column) -> Column:
    return F.struct(pred.alias("pred"), val.alias("val"), args.alias("args"))


def unify(pattern: Column, target: Column, bound: Column) -> Column:
    """The bindings (pairs) under which pattern is target, or null: equal preds; equal values or the pattern's is `*`;
    each argument of the pattern in the target, `*` for any, a variable for one that agrees with all it is bound to.
    Further arguments of the target do not matter; a variable as value is a plain value."""
    same = (pattern["pred"] == target["pred"]) & (F.coalesce(pattern["val"] == "*", F.lit(False)) | pattern["val"].eqNullSafe(target["val"]))
    fits = F.forall(pattern["args"], lambda e: F.exists(target["args"], lambda x: (x["k"] == e["k"]) & (F.coalesce(e["v"] == "*", F.lit(False)) | _variable(e["v"]) | e["v"].eqNullSafe(x["v"]))))
    new = F.transform(F.filter(pattern["args"], lambda e: _variable(e["v"])), lambda e: F.struct(e["v"].alias("k"), _of(target["args"], e["k"]).alias("v")))
    consistent = lambda b: F.when(F.size(b) == F.size(F.array_distinct(F.transform(b, lambda e: e["k"]))), b)
    return F.when(same & fits, once(F.array_distinct(F.concat(bound, new)), consistent))


def substitute(pattern: Column, bound: Column) -> Column:
    """pattern with its bound variables replaced."""
    value = lambda e: F.when(_variable(e["v"]) & F.exists(bound, lambda b: b["k"] == e["v"]), _of(bound, e["v"])).otherwise(e["v"])
    return fact(pattern["pred"], pattern["val"], F.transform(pattern["args"], lambda e: F.struct(e["k"].alias("k"), value(e).alias("v"))))


def entails(known: Column, pattern: Column, bound: Column) -> Column:
    """The bindings of the first known fact that unifies with pattern, or null."""
    return F.get(F.filter(F.transform(known, lambda k: unify(pattern, k, bound)), lambda b: b.isNotNull()), F.lit(0))


def fits(scope: Column, context: Column) -> Column:
    """Whether every pair of scope is a pair of context."""
    return F.forall(scope, lambda s: F.exists(context, lambda c: (c["k"] == s["k"]) & (c["v"] == s["v"])))


def candidate_counts(rules: DataFrame) -> DataFrame:
    """(pred, val, scopes): how many rules have an effect, per scope they hold in."""
    e = rules.select("regulation_id", "scope", F.explode("eff").alias("e")).select("regulation_id", "scope", "e.pred", "e.val").distinct()
    n = e.groupBy("pred", "val", "scope").agg(F.count("*").alias("n"))
    return n.groupBy("pred", "val").agg(F.array_sort(F.collect_list(F.struct("scope", "n"))).alias("scopes"))  # a row per distinct scope


def _count_for(scopes: Column, context: Column) -> Column:
    """How many candidates hold in a context."""
    return F.coalesce(F.aggregate(F.filter(scopes, lambda s: fits(s["scope"], context)), F.lit(0).cast("long"), lambda a, s: a + s["n"]), F.lit(0).cast("long"))


_SCOPES = f"array<struct<scope:{PAIRS},n:bigint>>"


_PRE = f"array<struct<i:int,pred:string,val:string,args:{PAIRS},scopes:{_SCOPES}>>"


def _conditions(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """(regulation_id, pre): the preconditions of each rule that has some, with the scopes of what could derive them."""
    p = rules.select("regulation_id", F.posexplode("pre").alias("i", "p")).select("regulation_id", "i", "p", F.col("p.pred").alias("pred"), F.col("p.val").alias("val"))
    p = p.join(counts, [p["pred"].eqNullSafe(counts["pred"]), p["val"].eqNullSafe(counts["val"])], "left").select("regulation_id", F.struct("i", F.col("p.pred").alias("pred"), F.col("p.val").alias("val"), F.col("p.args").alias("args"), F.coalesce("scopes", F.array().cast(_SCOPES)).alias("scopes")).alias("p"))
    return p.groupBy("regulation_id").agg(F.array_sort(F.collect_list("p"), lambda x, y: x["i"] - y["i"]).alias("pre"))


def _effects(rules: DataFrame, keep: int) -> DataFrame:
    """(pred, val, eff, regulation_id, gain, scope): the rules by effect.

    Of rules with the same effect, arguments and scope only the `keep` best can
    ever be in a beam, since they unify alike and differ in score only; they
    are found in two levels, so that a frequent effect is no hot group.
    """
    e = rules.select("regulation_id", "scope", F.round(F.log("score"), 9).alias("gain"), F.explode(F.array_distinct("eff")).alias("eff")).select("*", F.col("eff.pred").alias("pred"), F.col("eff.val").alias("val"))
    alike = [F.col("eff"), F.col("scope")]
    best = [F.desc("gain"), F.col("regulation_id")]
    salt = F.pmod(F.xxhash64("regulation_id"), F.lit(32))
    e = e.withColumn("__r", F.row_number().over(Window.partitionBy(*alike, salt).orderBy(*best))).where(F.col("__r") <= keep)
    e = e.withColumn("__r", F.row_number().over(Window.partitionBy(*alike).orderBy(*best))).where(F.col("__r") <= keep)
    return e.select("pred", "val", "eff", "regulation_id", "gain", "scope")


def explain(observations: DataFrame, rules: DataFrame, beam: int = BEAM, depth: int = DEPTH, top: int = TOP, length_cost: float = RULE_COST, most_assumptions: int = 10, normalised: bool = True) -> DataFrame:
    """(observation_id, rank, score, rules, assumed): the best explanations of each observation by its rules.

    observations: observation_id, goals and known (arrays of FACT), context
    (pairs). rules: regulation_id, score, scope (pairs), pre and eff (arrays of
    FACT). A state holds the open goals; of them the one that the fewest rules
    in scope could derive, the first of equals, is closed: by each rule with a
    matching effect that was not used before (its preconditions, under the
    bindings, become goals unless a known fact entails them), or, if there is
    none, by assuming it. A rule adds the logarithm of its score less
    length_cost, an assumption costs ASSUMPTION_COST. After each step the
    `beam` best states of an observation are kept. A chain must end within
    depth - 1 steps; score is its sum, by the number of rules if normalised.

    Observations without goals, with more goals than steps, or without any
    chain that ends have no row.

    The rules that can be in a beam are sent to the workers, where each
    observation is searched on its own (see beam.search). Rules that are too
    many for that are joined, and each step is written to the shared folder:
    goals meet effects by a join with salted hot keys; states are ranked per
    observation, which has at most beam times the candidates of a goal.
    """
    steps = depth - 1
    # read by every step
    rules = materialize(rules.select("regulation_id", "score", "scope", "pre", "eff"), "rules")
    counts = materialize(candidate_counts(rules), "candidate-counts")
    effects = materialize(_effects(rules, beam + steps), "effects")
    used = rules.join(effects.select("regulation_id").distinct(), "regulation_id", "leftsemi").where(F.size("pre") > 0).select("regulation_id", "pre")
    if effects.count() + (used.agg(F.sum(F.size("pre"))).first()[0] or 0) <= held.MAX_HELD:
        h = held.hold(
            effects.select("pred", "val", F.col("eff.args").alias("args"), "regulation_id", "gain", "scope"), used,
            counts.select("pred", "val", F.explode("scopes").alias("s")).select("pred", "val", "s.scope", "s.n"),
        )
        # few rows make much work here, so their partitions must not be merged by size; like goals meet in a task, which
        # remembers its searches. Single goals repeat the most, so those are spread
        salt = F.when(F.size("goals") == 1, F.pmod(F.xxhash64("observation_id"), F.lit(4))).otherwise(F.lit(0))
        spread = _searchable(observations, h, steps).repartition(4 * observations.sparkSession.sparkContext.defaultParallelism, F.xxhash64("goals"), salt)
        return held.searched(h, spread, beam, steps, top, ASSUMPTION_COST, length_cost, most_assumptions, normalised)
    pre = materialize(_conditions(rules, counts).join(effects.select("regulation_id").distinct(), "regulation_id", "leftsemi"), "conditions")
    sizes = effects.groupBy("pred", "val").agg(F.count("*").alias("n"))
    state = materialize(_start(observations, rules, counts, steps, most_assumptions), "states")
    finished = [_ended(state.where(F.size("goals") == 0), normalised)]
    front = state.where((F.size("goals") > 0) & (F.col("steps") < steps))
    order = [F.desc("total"), "path", "assumed", "goals", "bound"]
    own = ["observation_id", "context", "known", "goals", "path", "assumed", "bound", "total", "steps"]
    for _ in range(steps):
        at = F.array_min(F.transform("goals", lambda g, i: F.struct(g["n"].alias("n"), i.alias("i"))))["i"]
        pick = front.withColumn("__at", at).select(*own, "node", F.get("goals", F.col("__at")).alias("goal"), F.filter("goals", lambda g, i: i != F.col("__at")).alias("rest"))
        assumed = F.concat("assumed", F.array(F.concat_ws("|", "goal.pred", "goal.val")))
        step = ["observation_id", "node", "regulation_id", "path", "b", "total"]
        idle = pick.where(F.size("assumed") < most_assumptions).withColumn("regulation_id", F.lit(None).cast("string")).withColumn("b", F.col("bound")).select(*step[:-1], (F.col("total") - ASSUMPTION_COST).alias("total"))
        open_ = pick.where("goal.n > 0").select("observation_id", "node", "goal", "bound", "context", "path", "total", F.col("goal.pred").alias("pred"), F.col("goal.val").alias("val"))
        met = salted_join(open_, effects, ["pred", "val"], hot=hot_of_counts(sizes, ["pred", "val"], "n", least=1000))
        met = met.where(~F.array_contains("path", F.col("regulation_id")) & fits(F.col("scope"), F.col("context"))).withColumn("b", unify(F.col("eff"), F.col("goal"), F.col("bound"))).where("b is not null")
        derived = met.select("observation_id", "node", "regulation_id", F.array_append("path", F.col("regulation_id")).alias("path"), "b", F.round(F.col("total") + F.col("gain") - length_cost, 9).alias("total"))
        # a goal is assumed only where no rule derives it
        both = derived.unionByName(idle).repartition("observation_id").withColumn("some", F.max(F.col("regulation_id").isNotNull()).over(Window.partitionBy("observation_id", "node"))).where("regulation_id is not null or not some")
        # the order begins with total and path, so no other can be in the beam; only for these are the preconditions looked at
        both = both.withColumn("__r", F.rank().over(Window.partitionBy("observation_id").orderBy(*order[:2]))).where(F.col("__r") <= beam).select(*step)
        both = both.join(pick.select("observation_id", "node", "context", "known", "rest", F.col("assumed").alias("before"), assumed.alias("after"), F.col("steps").alias("past")), ["observation_id", "node"]).join(pre, "regulation_id", "left")
        both = both.withColumn("r", _preconditions(F.coalesce("pre", F.array().cast(_PRE)), F.col("known"), F.col("b"), F.col("context")))
        both = both.select(
            "observation_id", "context", "known", F.when(F.col("regulation_id").isNull(), F.col("rest")).otherwise(_distinct_facts(F.concat("r.goals", "rest"))).alias("goals"), "path",
            F.when(F.col("regulation_id").isNull(), F.col("after")).otherwise(F.col("before")).alias("assumed"), F.col("r.bound").alias("bound"), "total", (F.col("past") + 1).alias("steps"),
        )
        ranked = both.withColumn("node", F.row_number().over(Window.partitionBy("observation_id").orderBy(*order))).where(F.col("node") <= beam)
        nxt, seen = materialize_counted(ranked.select(*own, "node"), "states", open=F.count_if((F.size("goals") > 0) & (F.col("steps") < steps)))
        finished.append(_ended(nxt.where(F.size("goals") == 0), normalised))
        front = nxt.where((F.size("goals") > 0) & (F.col("steps") < steps))
        if not seen["open"]:
            break
    every = finished[0]
    for f in finished[1:]:
        every = every.unionByName(f)
    rank = F.row_number().over(Window.partitionBy("observation_id").orderBy(F.desc("score"), "path", "assumed"))  # at most beam times depth rows
    out = every.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return out.select("observation_id", "rank", "score", F.array_join("path", ",").alias("rules"), F.size("assumed").cast("long").alias("assumed"))


#: With more predicates or keys than this a list of them is no condition.
_LISTED = 1000


def _searchable(observations: DataFrame, h: held.Held, steps: int) -> DataFrame:
    """(observation_id, goals, known, context) of the observations that can have a chain, with what the rules ask for only: facts by predicate, context by the keys of scopes.

    A generator instead of a condition, which would be pushed down and compute the goals again.
    """
    keys = {k for s in h.scopes for k, _ in s}
    known = F.filter("known", lambda f: f["pred"].isin(sorted(h.asked))) if len(h.asked) <= _LISTED else F.col("known")
    context = F.filter("context", lambda e: e["k"].isin(sorted(keys))) if len(keys) <= _LISTED else F.col("context")
    some = lambda g: (F.size(g) > 0) & (F.size(F.array_distinct(g)) <= steps)
    row = lambda g: F.struct("observation_id", g.alias("goals"), known.alias("known"), context.alias("context"))
    return observations.select(F.inline(once(F.col("goals"), lambda g: F.when(some(g), F.array(row(g))))))


def _ended(state: DataFrame, normalised: bool) -> DataFrame:
    by = F.greatest(F.size("path"), F.lit(1)) if normalised else F.lit(1)
    return state.select("observation_id", F.round(F.col("total") / by, 9).alias("score"), "path", "assumed")


def _distinct_facts(goals: Column) -> Column:
    """goals without repeats; equal facts have equal counts in one context."""
    return F.array_distinct(goals)


def _preconditions(pre: Column, known: Column, bound: Column, context: Column) -> Column:
    """struct(bound, goals): pre taken in order; what a known fact entails binds, what none does becomes a goal."""
    goal = f"array<struct<pred:string,val:string,args:{PAIRS},n:bigint>>"
    zero = F.struct(bound.alias("bound"), F.array().cast(goal).alias("goals"))

    def step(acc: Column, p: Column) -> Column:
        def judged(p2: Column) -> Column:
            def chosen(b: Column) -> Column:
                new = F.array(F.struct(p2["pred"].alias("pred"), p2["val"].alias("val"), p2["args"].alias("args"), _count_for(p["scopes"], context).alias("n")))
                return F.struct(F.coalesce(b, acc["bound"]).alias("bound"), F.when(b.isNull(), F.concat(acc["goals"], new)).otherwise(acc["goals"]).alias("goals"))

            return once(entails(known, p2, acc["bound"]), chosen)

        return once(substitute(p, acc["bound"]), judged)

    return F.aggregate(pre, zero, step)


def _start(observations: DataFrame, rules: DataFrame, counts: DataFrame, steps: int, most_assumptions: int) -> DataFrame:
    """The first state of each observation; goals that no rule could derive are assumed at once, a step each, as they come first in any order."""
    o = observations.select("observation_id", "context", F.array_distinct("goals").alias("goals"), F.array_distinct("known").alias("known")).where(F.size("goals") > 0)
    g = o.where(F.size("goals") <= steps).select("observation_id", "context", F.posexplode("goals").alias("i", "g")).select("observation_id", "context", "i", "g", F.col("g.pred").alias("pred"), F.col("g.val").alias("val"))
    g = g.join(counts, [g["pred"].eqNullSafe(counts["pred"]), g["val"].eqNullSafe(counts["val"])], "left")
    g = g.select("observation_id", F.struct("i", F.col("g.pred").alias("pred"), F.col("g.val").alias("val"), F.col("g.args").alias("args"), F.when(F.col("scopes").isNotNull(), _count_for(F.col("scopes"), F.col("context"))).otherwise(F.lit(0).cast("long")).alias("n")).alias("g"))
    goals = g.groupBy("observation_id").agg(F.array_sort(F.collect_list("g"), lambda x, y: x["i"] - y["i"]).alias("gs"))  # at most `steps` goals
    # only facts that some rule needs, by value or by any, can be asked for
    needed = rules.select(F.explode("pre").alias("p")).select("p.pred", "p.val").distinct()
    k = o.select("observation_id", F.posexplode("known").alias("i", "k")).select("observation_id", "i", "k", F.explode(F.array(F.col("k.val"), F.lit("*"))).alias("val")).withColumn("pred", F.col("k.pred"))
    k = k.join(needed, [k["pred"].eqNullSafe(needed["pred"]), k["val"].eqNullSafe(needed["val"])], "leftsemi").select("observation_id", "i", "k").distinct()
    known = k.groupBy("observation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "k")), lambda x, y: x["i"] - y["i"]), lambda x: x["k"]).alias("facts"))  # a record's facts
    plain = lambda a: F.transform(a, lambda g: F.struct(g["pred"].alias("pred"), g["val"].alias("val"), g["args"].alias("args"), g["n"].alias("n")))
    both = o.drop("goals", "known").join(goals, "observation_id").join(known, "observation_id", "left")
    bare = F.transform(F.filter("gs", lambda g: g["n"] == 0), lambda g: F.concat_ws("|", g["pred"], g["val"]))
    out = both.select(
        "observation_id", "context", F.coalesce("facts", F.array().cast(f"array<{FACT}>")).alias("known"), plain(F.filter("gs", lambda g: g["n"] > 0)).alias("goals"), F.array().cast("array<string>").alias("path"), bare.alias("assumed"),
        F.array().cast(PAIRS).alias("bound"), F.round(-ASSUMPTION_COST * F.size(bare), 9).alias("total"), F.size(bare).alias("steps"), F.lit(1).alias("node"),
    )
    return out.where((F.size("assumed") <= most_assumptions) & (F.size("goals") + F.col("steps") <= steps))
