"""Queries on the graph, its algebra, rules, views and patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import text_features as tx
from causeway.operators import facts as fx
from causeway.operators import explain, graph, reasoning
from causeway.plans import base
from causeway.plans.base import SQL
from causeway.session import materialize
from causeway.skew import hot_keys, ranked, salted_join
from causeway.tables import load

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = (SQL if prelude else "") + sql
        return f

    return add


def _values(rows) -> str:
    lit = lambda x: "null" if x is None else ("true" if x is True else "false" if x is False else "'" + str(x) + "'")
    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_RULES = _values([(a, b, True, r, m, e) for a, b, r, m, e in graph.ALLOWED] + [(a, b, False, None, None, None) for a, b in graph.FORBIDDEN]) + " v(first, second, allowed, result, mode, evidence)"
_KINDS = _values(graph.KINDS) + " k(kind, family, transitive, force)"


# -- algebra of edge kinds


@query(f"select a.kind first, b.kind as second, coalesce(v.allowed, false) allowed, v.result from {_KINDS} a join {_KINDS} b on true left join {_RULES} on v.first = a.kind and v.second = b.kind".replace(" k(kind, family, transitive, force) a", " a(kind, family, transitive, force)").replace(" k(kind, family, transitive, force) b", " b(kind, family, transitive, force)"), False)
def alg_compose(spark, d):
    """Every ordered pair of kinds with what it composes to; undefined pairs are forbidden."""
    kinds = [k for k, *_ in graph.KINDS]
    pairs = spark.createDataFrame([(a, b) for a in kinds for b in kinds], "first string, second string")
    return pairs.join(graph.compose_table(spark), ["first", "second"], "left").select("first", "second", F.coalesce("allowed", F.lit(False)).alias("allowed"), "result")


@query(f"select first, second, result, mode from {_RULES} where allowed", False)
def alg_rules(spark, d):
    return graph.compose_table(spark).where("allowed").select("first", "second", "result", "mode")


@query(f"select first, second from {_RULES} where not allowed", False)
def alg_forbidden(spark, d):
    return graph.compose_table(spark).where("not allowed").select("first", "second")


@query(f"select second, allowed, result from {_RULES} where first = 'is_a'", False)
def alg_composable_with(spark, d):
    return graph.compose_table(spark).where("first = 'is_a'").select("second", "allowed", "result")


@query(f"select a.family first_family, b.family second_family, max(coalesce(v.allowed, false)) allowed from {_KINDS} a join {_KINDS} b on true left join {_RULES} on v.first = a.kind and v.second = b.kind group by 1, 2".replace(" k(kind, family, transitive, force) a", " a(kind, family, transitive, force)").replace(" k(kind, family, transitive, force) b", " b(kind, family, transitive, force)"), False)
def alg_cross_family(spark, d):
    k = graph.kind_table(spark).select("kind", "family")
    p = alg_compose(spark, d).join(k.withColumnsRenamed({"kind": "first", "family": "first_family"}), "first").join(k.withColumnsRenamed({"kind": "second", "family": "second_family"}), "second")
    return p.groupBy("first_family", "second_family").agg(F.max("allowed").alias("allowed"))


_FOLD = f"""with recursive v as (select * from {_RULES}), k as (select kind from {_KINDS}),
w(kinds, cur, worst) as (select kind, kind, 0 from k union all
  select w.kinds || '>' || v.second, v.result, greatest(w.worst, case v.mode when 'direct' then 0 when 'inherit' then 1 when 'candidate' then 2 else 3 end) from w join v on v.first = w.cur and v.allowed where len(string_split(w.kinds, '>')) < 3)
select kinds, cur result, ['direct', 'inherit', 'candidate', 'weak'][worst + 1] as mode from w where len(string_split(kinds, '>')) = 3"""


@query(_FOLD, False)
def alg_validate_paths(spark, d):
    """Which chains of three kinds are legal, with their reduced kind and weakest mode."""
    kinds = [k for k, *_ in graph.KINDS]
    chains = spark.createDataFrame([([a, b, c],) for a in kinds for b in kinds for c in kinds], "kinds array<string>")
    return chains.withColumn("f", graph.fold_kinds(F.col("kinds"))).where("f.valid").select(F.array_join("kinds", ">").alias("kinds"), "f.result", "f.mode")


# -- graph


@query("select min(content) content, k canonical, count(distinct content) aliases from (select content, array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(content), '[^a-z0-9_一-龥]+', ' ', 'g'), ' '), lambda w: len(w) > 0)), ' ') k from (select distinct pred || ': ' || val content from facts)) group by k")
def snk_add_atoms(spark, d):
    """Contents with equal canonical keys are one atom, named by the first; the others are its aliases."""
    c = base.facts(spark, d).select(F.concat("pred", F.lit(": "), "val").alias("content")).distinct()
    return c.groupBy(tx.canonical(F.col("content")).alias("canonical")).agg(F.min("content").alias("content"), F.count("*").alias("aliases")).select("content", "canonical", "aliases")


@query("select src, dst, round(weight, 9) weight, evidence, mode from edges")
def snk_add_refs(spark, d):
    return base.edges(spark, d).select("src", "dst", F.round("weight", 9).alias("weight"), "evidence", "mode")


@query("select src, dst from edges where not (src like 'turbine.%' or dst like 'turbine.%')")
def snk_remove_atoms(spark, d):
    """Edges that remain once all atoms of a device are removed with what hangs on them."""
    e = base.edges(spark, d)
    gone = e.select(F.explode(F.array("src", "dst")).alias("node")).where("node like 'turbine.%'").distinct()
    return e.join(gone, e.src == gone.node, "left_anti").join(gone, e.dst == gone.node, "left_anti").select("src", "dst")


_HUBS = "(select node from (select src node from edges union all select dst from edges) group by 1 order by count(*) desc, node limit 5)"


def _hubs(spark, d, n=5):
    return graph.degrees(base.edges(spark, d)).orderBy(F.desc(F.col("n_out") + F.col("n_in")), "node").limit(n).select("node")


@query(f"select h.node, e.dst other, round(weight, 9) weight, 'outgoing' direction from {_HUBS} h join edges e on e.src = h.node union all select h.node, e.src, round(weight, 9), 'incoming' from {_HUBS} h join edges e on e.dst = h.node")
def gra_neighbours(spark, d):
    return graph.neighbours(base.edges(spark, d), F.broadcast(_hubs(spark, d))).select("node", "other", F.round("weight", 9).alias("weight"), "direction")


_STARTS = "(select src node from edges where mode = 'compiled' group by 1 order by count(*) desc, src limit 5)"
_REACH = f""", walk(start, node, distance) as (select node, node, 0 from {_STARTS} union select w.start, e.dst, w.distance + 1 from walk w join edges e on e.src = w.node where w.distance < 3)
select start, node, cast(min(distance) as bigint) distance from walk group by 1, 2 having min(distance) > 0"""


def _starts(spark, d):
    return base.edges(spark, d).where("mode = 'compiled'").groupBy(F.col("src").alias("start")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "start").limit(5).select("start")


@query(_REACH)
def gra_reachable(spark, d):
    return graph.reachable(base.edges(spark, d), _starts(spark, d), 3).select("start", "node", F.col("distance").cast("long").alias("distance"))


@query("select src, dst, mode from edges where not (mode = 'tentative' and weight < 0.5)")
def gra_prune(spark, d):
    return base.edges(spark, d).where("not (mode = 'tentative' and weight < 0.5)").select("src", "dst", "mode")


@query("select mode, count(*) n, round(avg(weight), 9) mean_weight, cast(sum(evidence) as bigint) evidence from edges group by 1")
def gra_stats(spark, d):
    return base.edges(spark, d).groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 9).alias("mean_weight"), F.sum("evidence").alias("evidence"))


@query(", atoms as (select observation_id, sig from facts union select observation_id, k || '|' || v from ctx) select a.sig || ' & ' || b.sig pair, count(*) n from atoms a join atoms b on a.observation_id = b.observation_id and a.sig < b.sig group by 1")
def gra_ingest_cooccurrence(spark, d):
    """Co-occurrence edges between all facts and context entries of one observation, single ones too; where both have the same text they are one atom."""
    facts = base.facts(spark, d).select("observation_id", "sig")
    context = base.contexts(spark, d).select("observation_id", F.concat_ws("|", "key", "value").alias("sig"))
    sets = facts.unionByName(context).groupBy("observation_id").agg(F.collect_set("sig").alias("sigs"))
    return fx.pair_counts(sets, "observation_id", "sigs").select(F.concat("a", F.lit(" & "), "b").alias("pair"), "n")


@query("select o.observation_id, f.regulation_id from facts o join rule_facts f on f.side = 'eff' and f.pred = o.pred and f.val = o.val group by all")
def gra_effect_candidates(spark, d):
    """Each pair is made at the first effect that both have, so that the pairs need not be brought together."""
    e = base.rule_facts(spark, d).where("side = 'eff' and val is not null").groupBy("regulation_id").agg(F.collect_set("sig").alias("eff"))
    e = e.select("regulation_id", "eff", F.explode("eff").alias("sig"))
    o = base.facts(spark, d).groupBy("observation_id").agg(F.collect_set("sig").alias("sigs"))  # a record's facts
    o = materialize(o.select("observation_id", "sigs", F.explode("sigs").alias("sig")).join(e.select("sig").distinct(), "sig", "leftsemi"), "facts-asked-for")
    both = salted_join(o, e, ["sig"], hot=hot_keys(o, ["sig"], least=1000))
    first = F.array_min(F.array_intersect("eff", "sigs"))
    return both.where((F.size("eff") == 1) | (F.col("sig") == first)).select("observation_id", "regulation_id")


@query("select a.regulation_id first, a.sig bridge, b.n followers from (select distinct regulation_id, sig from rule_facts where side = 'eff') a join (select sig, count(distinct regulation_id) n from rule_facts where side = 'pre' group by 1) b on a.sig = b.sig")
def gra_can_chain(spark, d):
    """For each effect of a rule how many rules can follow: the bridge stands for the pairs it joins."""
    f = base.rule_facts(spark, d).select("regulation_id", "side", "sig").distinct()
    b = f.where("side = 'pre'").groupBy("sig").agg(F.count("*").alias("followers"))
    return f.where("side = 'eff'").join(b, "sig").select(F.col("regulation_id").alias("first"), F.col("sig").alias("bridge"), "followers")


@query("select a.regulation_id first, a.sig shared, b.n - 1 partners from (select distinct regulation_id, sig from rule_facts where side = 'eff' and sig is not null) a join (select sig, count(distinct regulation_id) n from rule_facts where side = 'eff' group by 1) b on a.sig = b.sig where b.n > 1")
def gra_can_merge(spark, d):
    """For each effect of a rule how many other rules share it."""
    f = base.rule_facts(spark, d).where("side = 'eff'").select("regulation_id", "sig").distinct()
    n = f.groupBy("sig").agg((F.count("*") - 1).alias("partners")).where("partners > 0")
    return f.join(n, "sig").select(F.col("regulation_id").alias("first"), F.col("sig").alias("shared"), "partners")


# -- scores and explanation

_SCORE = "least(1.0, greatest(0.01, case kind when 'intervention' then 1.0 when 'quasi_experiment' then 0.8 else 0.5 end * greatest(0.05, greatest(0.05, 1 - exp(-s / 5.0)) * exp(-c)) * least(1.0, 0.4 + 0.05 * (len(pre) + len(eff))) * case status when 'confirmed' then 1.0 when 'hypothesis' then 0.85 when 'candidate' then 0.65 when 'retired' then 0.1 else 0.8 end))"


@query(f"select regulation_id, round({_SCORE}, 9) score, round(greatest(0.05, greatest(0.05, 1 - exp(-s / 5.0)) * exp(-c)), 9) reputation, round(least(1.0, 0.4 + 0.05 * (len(pre) + len(eff))), 9) specificity from rule_sets")
def exp_rule_scores(spark, d):
    r = reasoning.scored(base.rule_sets(spark, d))
    return r.select("regulation_id", F.round("score", 9).alias("score"), F.round(reasoning.reputation(F.col("s"), F.col("c")), 9).alias("reputation"), F.round(reasoning.specificity(F.col("pre"), F.col("eff")), 9).alias("specificity"))


@query()
def exp_explain(spark, d):
    """The five best explanations of every observation by the rules that are not retired: at most eight steps, a beam of 20."""
    return explain.explain(base.observation_patterns(spark, d), base.rule_patterns(spark, d))


@query()
def exp_scored_explain(spark, d):
    """The ten likeliest chains of each observation: the product of the rules' scores, without costs of length."""
    t = explain.explain(base.observation_patterns(spark, d), base.rule_patterns(spark, d), beam=30, depth=5, top=10, length_cost=0.0, most_assumptions=5, normalised=False)
    return t.select("observation_id", "rank", F.round(F.exp("score"), 9).alias("probability"), "rules", "assumed")


@query()
def exp_detect(spark, d):
    """Observations that no chain explains well enough, with the reason the best one fails by; none where no chain ends."""
    o = materialize(base.observation_patterns(spark, d), "observation-patterns")  # read twice
    best = explain.explain(o, base.rule_patterns(spark, d), top=1).drop("rank")
    poor = F.col("score").isNull() | (F.col("score") < -2.2) | (F.col("assumed") > 0)
    reason = F.when(F.col("score").isNull(), "no_chain").when(F.col("score") < -2.2, "low_score").when(F.col("assumed") > 0, "pre_not_satisfied").when(F.col("rules") == "", "no_covering_rule").otherwise("unknown")
    return o.where(F.size("goals") > 0).select("observation_id").join(best, "observation_id", "left").where(poor).select("observation_id", reason.alias("reason"), "score", "assumed")


@query(""", c as (select preds, min(observation_id) observation_id, count(*) n from observation_sets where len(preds) > 0 group by 1)
select a.observation_id a, b.observation_id b, a.n a_size, b.n b_size, round(len(list_intersect(a.preds, b.preds)) / len(list_distinct(list_concat(a.preds, b.preds))), 9) similarity from c a join c b on a.observation_id < b.observation_id and len(list_intersect(a.preds, b.preds)) / len(list_distinct(list_concat(a.preds, b.preds))) >= 0.8""")
def exp_similar_observations(spark, d):
    """Pairs of alike predicate sets, each named by its first observation, with how many observations have it; exp_observation_classes names them all."""
    sets = materialize(base.observation_sets(spark, d).select("observation_id", "preds"), "observation-sets")
    size = sets.where(F.size("preds") > 0).groupBy("preds").agg(F.min("observation_id").alias("id"), F.count("*").alias("n")).select("id", "n")
    pairs = reasoning.similar_pairs(sets, "observation_id", "preds", 0.8)
    return pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("a_size")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("b_size")), "b").select("a", "b", "a_size", "b_size", "similarity")


@query()
def exp_leader_clusters(spark, d):
    """The leader of every observation with facts: greedy leader clusters of its predicate set at Jaccard similarity 0.8."""
    return reasoning.led(base.observation_sets(spark, d), "observation_id", "preds", 0.8)


@query("select observation_id, min(observation_id) over (partition by preds) class_id, count(*) over (partition by preds) size from observation_sets where len(preds) > 0")
def exp_observation_classes(spark, d):
    """The class of every observation with facts: the smallest id with the same predicates, which stands for it in exp_similar_observations, and how many have it."""
    sets = base.observation_sets(spark, d).where(F.size("preds") > 0).select("observation_id", "preds")
    return sets.join(sets.groupBy("preds").agg(F.min("observation_id").alias("class_id"), F.count("*").alias("size")), "preds").select("observation_id", "class_id", "size")


_INDUCE = """, ex as (select distinct sig from rule_facts where side = 'eff' and sig is not null), u as (select distinct project, observation_id, sig from facts where project is not null and sig not in (select sig from ex)),
t as (select project, count(distinct observation_id) total from u group by 1), s as (select project, sig, count(*) n from u group by 1, 2)
select project, sig eff, n, round(n / total, 9) support from (select s.*, total, row_number() over (partition by project order by n desc, sig) rn from s join t using (project)) where rn <= 3"""


@query(_INDUCE)
def exp_induce_effects(spark, d):
    """Per project the most common facts that no rule explains: the effects of candidate rules."""
    u = reasoning.unexplained(base.facts(spark, d).where("project is not null").select("project", "observation_id", "sig").distinct(), base.rule_facts(spark, d))
    total = u.groupBy("project").agg(F.count_distinct("observation_id").alias("total"))
    s = u.groupBy("project", "sig").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("n"), "sig"))
    return s.withColumn("rn", rn).where("rn <= 3").join(total, "project").select("project", F.col("sig").alias("eff"), "n", F.round(F.col("n") / F.col("total"), 9).alias("support"))


@query("select regulation_id, case when s + c > 0 and c / (s + c) > 0.3 then 'retired' when status = 'candidate' and s >= 3 and c / (s + c) < 0.2 then 'hypothesis' when status = 'hypothesis' and s >= 10 and c / (s + c) < 0.1 then 'confirmed' else status end status from rules")
def exp_promote(spark, d):
    n = F.col("s") + F.col("c")
    rate = F.when(n > 0, F.col("c") / n).otherwise(0.0)
    new = F.when(rate > 0.3, "retired").when((F.col("status") == "candidate") & (F.col("s") >= 3) & (rate < 0.2), "hypothesis").when((F.col("status") == "hypothesis") & (F.col("s") >= 10) & (rate < 0.1), "confirmed").otherwise(F.col("status"))
    return base.rules(spark, d).select("regulation_id", new.alias("status"))


_CHAINED = """select distinct a.regulation_id first, b.regulation_id as second, array_to_string(list_sort(list_distinct(list_concat(a.pre, list_filter(b.pre, lambda x: not list_contains(a.eff, x))))), ';') pre, array_to_string(b.eff, ';') eff, least(a.s, b.s) support from rule_sets a join rule_sets b on a.regulation_id <> b.regulation_id and len(list_intersect(a.eff, b.pre)) > 0"""


@query(f"select pre, eff, min(first || '>' || second) chain from ({_CHAINED}) x where (pre, eff) not in (select array_to_string(pre, ';'), array_to_string(eff, ';') from rule_sets) group by 1, 2 order by chain, pre, eff limit 20")
def exp_discover_compositions(spark, d):
    """The first twenty compositions whose preconditions and effects are those of no rule yet, repeats left out; all are of the level above their parts."""
    sets = materialize(base.rule_sets(spark, d).select("regulation_id", "pre", "eff", "s"), "rule-sets")
    return reasoning.first_compositions(sets, 20)


@query(_CHAINED)
def exp_chain_compose(spark, d):
    return reasoning.chain_compositions(base.rule_sets(spark, d))


@query("select sig eff, count(distinct regulation_id) n, cast(sum(s) as bigint) support from (select distinct regulation_id, sig from rule_facts where side = 'eff') join rules using (regulation_id) group by 1 having count(distinct regulation_id) > 1")
def exp_merge_conditions(spark, d):
    e = base.rule_facts(spark, d).where("side = 'eff'").select("regulation_id", "sig").distinct()
    return e.join(base.rules(spark, d), "regulation_id").groupBy(F.col("sig").alias("eff")).agg(F.count("*").alias("n"), F.sum("s").alias("support")).where("n > 1")


@query("select pred, count(distinct regulation_id) n from rule_facts where side = 'pre' group by 1 order by n desc, pred limit 5")
def exp_first_questions(spark, d):
    return base.rule_facts(spark, d).where("side = 'pre'").groupBy("pred").agg(F.count_distinct("regulation_id").alias("n")).orderBy(F.desc("n"), "pred").limit(5)


@query("select regulation_id, round(c / (s + c), 9) rate from rules where c > 0 order by round(c / (s + c), 9) desc, regulation_id limit 5")
def exp_reduce_uncertainty(spark, d):
    return base.rules(spark, d).where("c > 0").select("regulation_id", F.round(F.col("c") / (F.col("s") + F.col("c")), 9).alias("rate")).orderBy(F.desc("rate"), "regulation_id").limit(5)


@query("select pred, low - 0.2 * (high - low) target_low, high + 0.2 * (high - low) target_high from (select pred, min(x) low, max(x) high from (select pred, try_cast(val as double) x from facts) where x is not null group by 1) where high > low")
def exp_suggest_exploration(spark, d):
    from causeway.plans.records import agg_numeric_ranges

    span = F.col("high") - F.col("low")
    return agg_numeric_ranges(spark, d).where("high > low").select("pred", (F.col("low") - 0.2 * span).alias("target_low"), (F.col("high") + 0.2 * span).alias("target_high"))


_INTER = """, p as (select distinct pred from facts), co as (select a.p a, b.p b, count(*) n from (select observation_id, unnest(preds) p from observation_sets) a join (select observation_id, unnest(preds) p from observation_sets) b on a.observation_id = b.observation_id and a.p < b.p group by 1, 2)
select a.pred a, b.pred b, coalesce(n, 0) n, round(1.0 / (coalesce(n, 0) + 1), 9) score from p a join p b on a.pred < b.pred left join co on co.a = a.pred and co.b = b.pred where coalesce(n, 0) <= 1 order by n, a, b limit 5"""


@query(_INTER)
def exp_suggest_interaction(spark, d):
    """The five pairs of parameters that were met least, once at most: by counting the unmet ones of each parameter, of which only the first five parameters are then paired with all."""
    p = materialize(base.facts(spark, d).select("pred").distinct(), "parameters")
    later = ranked(p.withColumn("one", F.lit(1)), ["one"], ["pred"], "place")
    n = p.count()
    met = materialize(fx.pair_counts(base.observation_sets(spark, d), "observation_id", "preds"), "met")
    seen = met.groupBy(F.col("a").alias("pred")).agg(F.count("*").alias("seen"))
    first = later.join(seen, "pred", "left").where(F.lit(n) - F.col("place") - F.coalesce("seen", F.lit(0)) > 0).orderBy("pred").limit(5).select(F.col("pred").alias("a"))
    unmet = p.join(F.broadcast(first), F.col("pred") > F.col("a")).select("a", F.col("pred").alias("b")).join(met, ["a", "b"], "left_anti").select("a", "b", F.lit(0).cast("long").alias("n"))  # five rows against all
    few = unmet.unionByName(met.where("n = 1").select("a", "b", "n"))
    return few.orderBy("n", "a", "b").limit(5).select("a", "b", "n", F.round(1.0 / (F.col("n") + 1), 9).alias("score"))


@query("select regulation_id, s from rules where c = 0 and s >= 3 order by regulation_id limit 5")
def exp_suggest_counterfactual(spark, d):
    return base.rules(spark, d).where("c = 0 and s >= 3").orderBy("regulation_id").limit(5).select("regulation_id", "s")


@query("select r.regulation_id from rules r where status <> 'retired' and exists (select 1 from rule_facts f join (select pred from facts group by 1 order by count(*) desc, pred limit 3) p on p.pred = f.pred where f.regulation_id = r.regulation_id) order by 1 limit 100")
def exp_load_relevant(spark, d):
    """Rules about the most frequent predicates."""
    top = base.facts(spark, d).groupBy("pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pred").limit(3).select("pred")
    hit = base.rule_facts(spark, d).join(F.broadcast(top), "pred", "leftsemi").select("regulation_id").distinct()  # three rows
    return base.rules(spark, d).where("status <> 'retired'").join(hit, "regulation_id", "leftsemi").select("regulation_id").orderBy("regulation_id").limit(100)


_FLUSH = """, w as (select *, row_number() over (partition by regulation_id order by updated_at desc nulls last, arrived_at desc nulls last, data desc) rn from regulations where regulation_id is not null)
select regulation_id, ['retired', 'candidate', 'hypothesis', 'confirmed'][max(case status when 'retired' then 0 when 'candidate' then 1 when 'hypothesis' then 2 when 'confirmed' then 3 else 0 end) + 1] status, max(case when json_valid(data) then coalesce(cast(json_extract_string(data, '$.evidence.support_n') as bigint), 0) else 0 end) s from w group by 1"""


@query(_FLUSH)
def exp_flush_merge(spark, d):
    """Short- and long-term states merged: counters by maximum, states by rank."""
    rank = F.when(F.col("status") == "candidate", 1).when(F.col("status") == "hypothesis", 2).when(F.col("status") == "confirmed", 3).otherwise(0)
    s = F.coalesce(F.get_json_object("data", "$.evidence.support_n").cast("long"), F.lit(0))
    t = load(spark, d, "regulations").where("regulation_id is not null").groupBy("regulation_id").agg(F.max(rank).alias("r"), F.max(s).alias("s"))
    return t.select("regulation_id", F.element_at(F.array(*[F.lit(x) for x in ("retired", "candidate", "hypothesis", "confirmed")]), F.col("r") + 1).alias("status"), "s")


@query("select sig, count(*) proofs, max(w) best, bool_or(w > 0.5) any_, round(1 - product(1 - w), 9) either from (select distinct f.regulation_id, f.sig, r.s / (r.s + r.c + 1) w from rule_facts f join rules r using (regulation_id) where side = 'eff') group by 1")
def exp_provenance_semirings(spark, d):
    """The proofs of each effect under the boolean, the max-product and the independent-or semiring."""
    e = base.rule_facts(spark, d).where("side = 'eff'").select("regulation_id", "sig").distinct().join(base.rules(spark, d), "regulation_id").withColumn("w", F.col("s") / (F.col("s") + F.col("c") + 1))
    return e.groupBy("sig").agg(F.count("*").alias("proofs"), F.max("w").alias("best"), F.bool_or(F.col("w") > 0.5).alias("any_"), F.round(1 - F.product(1 - F.col("w")), 9).alias("either"))


@query("select sig, regulation_id, round(w, 9) w, rank from (select *, row_number() over (partition by sig order by round(w, 9) desc, regulation_id) rank from (select distinct f.regulation_id, f.sig, r.s / (r.s + r.c + 1) w from rule_facts f join rules r using (regulation_id) where side = 'eff')) where rank <= 3")
def exp_top_proofs(spark, d):
    e = base.rule_facts(spark, d).where("side = 'eff'").select("regulation_id", "sig").distinct().join(base.rules(spark, d), "regulation_id").select("sig", "regulation_id", F.round(F.col("s") / (F.col("s") + F.col("c") + 1), 9).alias("w"))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("w"), "regulation_id")).cast("long")).where("rank <= 3")


# -- views


@query("select pre_key, effect, n, round(weight, 9) weight, evidence, case when weight >= 0.7 and evidence >= 3 then 'confirmed' when weight >= 0.4 then 'hypothesis' else 'candidate' end status from (select array_to_string(pre, ';') pre_key, effect, count(*) n, avg(case when s + c > 0 then s / (s + c) else 0.3 end) weight, cast(sum(s) as bigint) evidence from (select *, unnest(eff) effect from rule_sets where status <> 'retired') group by 1, 2)")
def view_rules(spark, d):
    """Rules grouped by preconditions and effect, with pooled weight, evidence and status."""
    w = F.when(F.col("s") + F.col("c") > 0, F.col("s") / (F.col("s") + F.col("c"))).otherwise(0.3)
    r = base.rule_sets(spark, d).where("status <> 'retired'").select(F.array_join("pre", ";").alias("pre_key"), F.explode("eff").alias("effect"), w.alias("w"), "s")
    g = r.groupBy("pre_key", "effect").agg(F.count("*").alias("n"), F.avg("w").alias("weight"), F.sum("s").alias("evidence"))
    status = F.when((F.col("weight") >= 0.7) & (F.col("evidence") >= 3), "confirmed").when(F.col("weight") >= 0.4, "hypothesis").otherwise("candidate")
    return g.select("pre_key", "effect", "n", F.round("weight", 9).alias("weight"), "evidence", status.alias("status"))


@query("select regulation_id, 'rv_' || substr(sha256(array_to_string(list_concat(pre, eff), ',')), 1, 8) view_id from rule_sets")
def view_ids(spark, d):
    return base.rule_sets(spark, d).select("regulation_id", F.concat(F.lit("rv_"), F.substring(F.sha2(F.array_join(F.concat("pre", "eff"), ","), 256), 1, 8)).alias("view_id"))


@query("select pred, count(distinct regulation_id) n, round(count(distinct regulation_id) filter (status = 'confirmed') / count(distinct regulation_id), 9) confidence, case when count(distinct regulation_id) = 1 then 'single' when count(distinct regulation_id) <= 5 then 'small' when count(distinct regulation_id) <= 15 then 'medium' else 'large' end abstraction from rule_facts join rules using (regulation_id) where side = 'eff' group by 1")
def view_clusters(spark, d):
    """Knowledge clusters: the rules about one effect predicate."""
    e = base.rule_facts(spark, d).where("side = 'eff'").select("regulation_id", "pred").distinct().join(base.rules(spark, d), "regulation_id")
    g = e.groupBy("pred").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "confirmed").alias("k"))
    size = F.when(F.col("n") == 1, "single").when(F.col("n") <= 5, "small").when(F.col("n") <= 15, "medium").otherwise("large")
    return g.select("pred", "n", F.round(F.col("k") / F.col("n"), 9).alias("confidence"), size.alias("abstraction"))


@query("select regulation_id, round(case when s + c > 0 then s / (s + c) else 0.3 end, 9) confidence from rules")
def view_confidence(spark, d):
    n = F.col("s") + F.col("c")
    return base.rules(spark, d).select("regulation_id", F.round(F.when(n > 0, F.col("s") / n).otherwise(0.3), 9).alias("confidence"))


# -- patterns


@query("select shape, n from (select split_part(split_part(src, '|', 1), '.', 2) || '-causes-' || split_part(split_part(dst, '|', 1), '.', 2) shape, count(*) n from edges group by 1) where n >= 2")
def pat_suggest_templates(spark, d):
    area = lambda c: F.coalesce(F.get(F.split(F.split(c, "[|]")[0], "[.]"), F.lit(1)), F.lit(""))
    return graph.shape_counts(base.edges(spark, d), F.concat(area("src"), F.lit("-causes-"), area("dst")))


@query("select node, n_out, n_in from (select node, cast(sum(o) as bigint) n_out, cast(sum(i) as bigint) n_in from (select src node, 1 o, 0 i from edges union all select dst, 0, 1 from edges) group by 1) where n_out >= 2 and n_in >= 1")
def pat_fingerprints(spark, d):
    return graph.degrees(base.edges(spark, d)).where("n_out >= 2 and n_in >= 1").select("node", "n_out", "n_in")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
