"""Queries on stores, facts and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators import facts as fx
from causeway.operators import stores
from causeway.operators.orphans import Reference
from causeway.plans import base
from causeway.plans.base import SQL
from causeway.session import materialize
from causeway.skew import hot_keys, ranked, salted_join
from causeway.tables import load

Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = False):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = (SQL if prelude else "") + sql
        return f

    return add


_OBS = "(select observation_id, min(client) client, min(project) project, min(arrived_at) arrived from observations where observation_id is not null group by 1)"
_STORY = "(select distinct on (id) * from stories where id is not null order by id, arrived_at)"


def _obs(spark, d) -> DataFrame:
    return load(spark, d, "observations").where("observation_id is not null").groupBy("observation_id").agg(F.min("client").alias("client"), F.min("project").alias("project"), F.min("arrived_at").alias("arrived"))


# -- scans and lookups


@query(f"select observation_id, client, project from {_OBS} order by arrived desc, observation_id limit 100")
def src_list_observations(spark, d):
    return stores.newest(_obs(spark, d), "arrived", "observation_id", 100).select("observation_id", "client", "project")


@query(f"select observation_id, client, project from {_OBS} where observation_id = (select min(observation_id) from observations)")
def src_get_observation(spark, d):
    t = _obs(spark, d)
    first = load(spark, d, "observations").agg(F.min("observation_id").alias("observation_id"))
    return t.join(first, "observation_id", "leftsemi").select("observation_id", "client", "project")


@query(f"select id, status, client from {_STORY} where status = 'resolved' order by arrived_at desc, id limit 50 offset 10")
def src_list_events(spark, d):
    return stores.newest(base.stories(spark, d).where("status = 'resolved'"), "arrived_at", "id", 50, 10).select("id", "status", "client")


@query(f"select id, client, created_at from {_STORY} where id = (select max(id) from stories)")
def src_get_event(spark, d):
    last = load(spark, d, "stories").agg(F.max("id").alias("id"))
    return base.stories(spark, d).join(last, "id", "leftsemi").select("id", "client", "created_at")


@query(f"select id, problem_class_id from {_STORY} where problem_class_id = 'PC_12'")
def src_events_by_cluster(spark, d):
    return base.stories(spark, d).where("problem_class_id = 'PC_12'").select("id", "problem_class_id")


@query(f"select id, status from {_STORY} where status in ('open', 'exploring')")
def src_open_events(spark, d):
    return base.stories(spark, d).where(F.col("status").isin("open", "exploring")).select("id", "status")


@query("select regulation_id, status from reg_latest where status = 'candidate' order by updated_at desc, regulation_id limit 100", True)
def src_list_regulations(spark, d):
    return stores.newest(base.rules(spark, d).where("status = 'candidate'"), "updated_at", "regulation_id", 100).select("regulation_id", "status")


@query("select regulation_id, status, s, c from rules where regulation_id = (select min(regulation_id) from rules)", True)
def src_get_regulation(spark, d):
    t = base.rules(spark, d)
    return t.join(t.agg(F.min("regulation_id").alias("regulation_id")), "regulation_id", "leftsemi").select("regulation_id", "status", "s", "c")


@query("select regulation_id, status from rules where status <> 'retired'", True)
def src_active_regulations(spark, d):
    return base.rules(spark, d).where("status <> 'retired'").select("regulation_id", "status")


@query("select regulation_id from reg_latest where contains(data, '\"turbine.build\"')", True)
def src_search_regulations_text(spark, d):
    """The rules that mention a predicate anywhere, as text."""
    return base._latest(spark, d).where(F.get_json_object("data", "$").isNotNull() & F.col("data").contains('"turbine.build"')).select("regulation_id")


@query("select regulation_id from rule_sets where list_contains(eff_preds, 'turbine.build')", True)
def src_search_regulations_by_effect(spark, d):
    return base.rule_sets(spark, d).where(F.array_contains("eff_preds", "turbine.build")).select("regulation_id")


@query("select regulation_id from rule_sets where list_contains(pre_preds, 'turbine.build')", True)
def src_search_regulations_by_pre(spark, d):
    return base.rule_sets(spark, d).where(F.array_contains("pre_preds", "turbine.build")).select("regulation_id")


@query("select regulation_id from rule_sets where exists(select 1 from (select unnest(list_concat(pre_preds, eff_preds)) p) where contains(lower(p), 'build'))", True)
def prj_search_regulations_by_predicate(spark, d):
    return base.rule_sets(spark, d).where(F.exists(F.concat("pre_preds", "eff_preds"), lambda p: stores.contains(p, "build"))).select("regulation_id")


@query("select observation_id from observation_sets where len(list_filter(preds, lambda p: contains(p, 'temp'))) > 0", True)
def prj_search_observations_by_predicate(spark, d):
    return base.observation_sets(spark, d).where(F.exists("preds", lambda p: stores.contains(p, "temp"))).select("observation_id")


@query("select regulation_id from rule_sets where list_contains(eff, 'turbine.sealed|true')", True)
def prj_regulations_for_effect(spark, d):
    return base.rule_sets(spark, d).where(F.array_contains("eff", "turbine.sealed|true")).select("regulation_id")


@query("select regulation_id from rule_sets where list_contains(pre, 'turbine.sealed|true')", True)
def prj_regulations_with_precondition(spark, d):
    return base.rule_sets(spark, d).where(F.array_contains("pre", "turbine.sealed|true")).select("regulation_id")


# -- sinks and changes


@query("select regulation_id, status from (select *, row_number() over (partition by regulation_id order by updated_at desc, arrived_at desc, data desc) rn from regulations where regulation_id is not null) where rn = 1")
def snk_upsert_regulations(spark, d):
    """All arrivals of rules folded into one state per rule."""
    t = load(spark, d, "regulations").withColumn("version", F.struct("updated_at", "arrived_at", "data")).select("regulation_id", "version", "status")
    half = F.col("version.arrived_at") < F.lit("2025-03-01").cast("timestamp")
    return stores.upsert(t.where(half), t.where(~half), "regulation_id", "version").select("regulation_id", "status")


@query("select regulation_id, case when exists (select 1 from rule_facts f where f.regulation_id = r.regulation_id and f.side = 'eff' and f.pred like 'turbine.%') then 'clustered' else status end status from rules r", True)
def snk_patch_status(spark, d):
    hit = base.rule_facts(spark, d).where("side = 'eff' and pred like 'turbine.%'").select("regulation_id", F.lit("clustered").alias("status")).distinct()
    return stores.patch(base.rules(spark, d).select("regulation_id", "status"), hit, "regulation_id", ["status"])


@query("select p.pred, p.area, coalesce(n, 0) n from (select lower(trim(pred)) pred, min(area) area from predicates group by 1) p left join (select pred, count(*) n from facts group by 1) f on f.pred = p.pred", True)
def snk_increment_counters(spark, d):
    p = load(spark, d, "predicates").groupBy(F.lower(F.trim("pred")).alias("pred")).agg(F.min("area").alias("area")).withColumn("n", F.lit(0).cast("long"))
    return stores.add_counts(p, base.facts(spark, d).select("pred"), "pred", "n")


@query(f"select id from {_STORY} where deleted_at is null")
def snk_delete_by_key(spark, d):
    t = base.stories(spark, d)
    return stores.delete(t.select("id"), t.where("deleted_at is not null").select("id"), "id")


@query("select outcome, least(1.0, greatest(0.0, coalesce(avg(score), 0.5))) confidence from (select o.status outcome, e.score from (select distinct id, status from outcome_records) o left join (select distinct id, outcome_record_id, score from prediction_errors) e on lower(trim(e.outcome_record_id)) = lower(o.id)) group by 1")
def snk_clamped_confidence(spark, d):
    o = load(spark, d, "outcome_records").select("id", F.col("status").alias("outcome")).distinct()
    e = load(spark, d, "prediction_errors").select("id", F.lower(F.trim("outcome_record_id")).alias("k"), "score").distinct().select("k", "score")
    return o.join(e, F.lower(o.id) == e.k, "left").groupBy("outcome").agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.avg("score"), F.lit(0.5)))).alias("confidence"))


@query("select id, count(*) arrivals, epoch_us(min(arrived_at)) first_arrived from mechanism_instances where id is not null group by 1")
def snk_append_once(spark, d):
    """An append-only log that ignores repeated ids, with the number of ignored arrivals."""
    t = load(spark, d, "mechanism_instances").where("id is not null")
    return t.groupBy("id").agg(F.count("*").alias("arrivals"), F.unix_micros(F.min("arrived_at")).alias("first_arrived"))


# -- facts and patterns


@query("select distinct observation_id, f.pred || coalesce('|' || nullif(array_to_string(list_sort(list_transform(map_entries(f.args), lambda e: e.key || ':' || coalesce(e.value, 'null'))), ','), ''), '') || '|' || f.value sig from (select observation_id, unnest(facts) f from observations) where f.pred is not null and f.value is not null")
def prj_fact_signature(spark, d):
    t = load(spark, d, "observations").select("observation_id", F.explode("facts").alias("f")).where("f.pred is not null and f.value is not null")
    return t.select("observation_id", fx.signature(F.col("f.pred"), F.col("f.value"), F.col("f.args")).alias("sig")).distinct()


@query("select distinct observation_id, coalesce(len(focus_facts), len(facts)) goals from observations where observation_id is not null")
def prj_observation_goals(spark, d):
    n = F.when(F.col("focus_facts").isNotNull(), F.size("focus_facts")).when(F.col("facts").isNotNull(), F.size("facts"))
    return load(spark, d, "observations").where("observation_id is not null").select("observation_id", n.cast("long").alias("goals")).distinct()


@query("select distinct id, case when score >= 0.9 then 'excellent' when score >= 0.7 then 'adequate' when score >= 0.4 then 'poor' when score is not null then 'failure' end grade from prediction_errors")
def prj_fidelity_grade(spark, d):
    s = F.col("score")
    return load(spark, d, "prediction_errors").select("id", F.when(s >= 0.9, "excellent").when(s >= 0.7, "adequate").when(s >= 0.4, "poor").when(s.isNotNull(), "failure").alias("grade")).distinct()


@query("select kind, count(*) n from (select case when s = '*' then 'wildcard' when s like '?%' then 'variable' else 'constant' end kind from (select json_extract_string(t.value, '$.args.slot') s from sides, json_tree(sides.x) t where x is not null and t.type = 'OBJECT' and json_type(json_extract(t.value, '$.pred')) = 'VARCHAR') where s is not null) group by 1", True)
def prj_argument_kinds(spark, d):
    """How the arguments of rule facts split into wildcards, variables and constants."""
    from causeway.operators.flatten import rule_args

    slot = F.col("args")["slot"]
    t = rule_args(base._latest(spark, d), "regulation_id", "data").where(slot.isNotNull())
    return t.groupBy(F.when(fx.is_wildcard(slot), "wildcard").when(fx.is_variable(slot), "variable").otherwise("constant").alias("kind")).agg(F.count("*").alias("n"))


@query("select observation_id, k pred, v val from ctx", True)
def prj_context_to_facts(spark, d):
    """All context entries of each observation as facts."""
    return base.contexts(spark, d).select("observation_id", F.col("key").alias("pred"), F.col("value").alias("val"))


@query(""", n as (select count(distinct observation_id) n from observations where observation_id is not null), need as (select r.regulation_id, count(s.k) need from reg_latest r left join scope s using (regulation_id) group by 1),
hit as (select regulation_id, count(*) n from (select s.regulation_id, c.observation_id from scope s join ctx c on c.k = s.k and c.v = s.v join need using (regulation_id) group by 1, 2, need having count(*) = need) group by 1)
select regulation_id, case when need = 0 then (select n from n) else coalesce(hit.n, 0) end n from need left join hit using (regulation_id)""", True)
def prj_scope_compatible(spark, d):
    """For each rule the number of observations its scope fits: counted per distinct scope, then given to its rules."""
    r = base.rule_scopes(spark, d)
    sets = materialize(base.contexts(spark, d).groupBy("observation_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", "key", "value"))).alias("sigs")), "contexts")
    scopes = r.where(F.size("scope") > 0).groupBy(F.transform("scope", lambda e: F.concat_ws("|", e["k"], e["v"])).alias("pre")).agg(F.min("regulation_id").alias("regulation_id"))
    facts = sets.select("observation_id", F.explode("sigs").alias("sig"))
    hit = fx.satisfying(scopes, sets, facts).groupBy("regulation_id").agg(F.count("*").alias("k")).join(scopes, "regulation_id").select("pre", "k")
    whole = load(spark, d, "observations").agg(F.count_distinct("observation_id").alias("n")).first()["n"]  # one value
    own = r.withColumn("pre", F.transform("scope", lambda e: F.concat_ws("|", e["k"], e["v"])))
    return own.join(hit, "pre", "left").select("regulation_id", F.when(F.size("pre") == 0, F.lit(whole)).otherwise(F.coalesce("k", F.lit(0))).alias("n"))


def _members(spark, d):
    """(key, sig): the distinct facts of each observation."""
    return base.facts(spark, d).select(F.col("observation_id").alias("key"), "sig").distinct()


@query("select r.regulation_id, count(*) support from (select regulation_id, pre from rule_sets where len(pre) > 0) r join observation_sets o on list_has_all(o.sigs, r.pre) group by 1", True)
def agg_count_support(spark, d):
    rules = materialize(base.rule_sets(spark, d).select("regulation_id", F.col("pre").alias("need")), "rules")
    held = fx.containing(rules, _members(spark, d))
    return rules.join(held, "need").select("regulation_id", F.col("n").alias("support"))


@query("select r.regulation_id, count(*) filter (len(list_intersect(o.sigs, r.eff)) > 0) support, count(*) filter (len(list_intersect(o.sigs, r.eff)) = 0) conflicts from (select regulation_id, pre, eff from rule_sets where len(pre) > 0) r join observation_sets o on list_has_all(o.sigs, r.pre) group by 1", True)
def exp_validate_rules(spark, d):
    """Support and conflicts of every rule over all observations that satisfy its preconditions."""
    every = materialize(base.rule_sets(spark, d).select("regulation_id", "pre", "eff").where(F.size("pre") > 0), "rules")
    # the parts of more effects than these are too many: such rules meet their observations
    wide = F.size(F.array_except("eff", "pre")) > fx.ENUMERATED
    rules, obs = every.where(~wide), base.observation_sets(spark, d)
    hits = fx.satisfying(every.where(wide), obs, base.facts(spark, d)).join(every, "regulation_id").join(obs.select("observation_id", "sigs"), "observation_id")
    hits = hits.groupBy("regulation_id").agg(F.count_if(F.arrays_overlap("sigs", "eff")).alias("support"), F.count_if(~F.arrays_overlap("sigs", "eff")).alias("conflicts"))
    # who shows some of the effects: by inclusion and exclusion over those that are no preconditions
    free = F.array_except("eff", "pre")
    parts = F.aggregate(free, F.array(F.array().cast("array<string>")), lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.array_append(s, x))))
    sign = F.when(F.size("part") % 2 == 1, 1).otherwise(-1)
    met = rules.select("regulation_id", "pre", (F.size("eff") > F.size(free)).alias("always"), F.explode(parts).alias("part"))
    met = materialize(met.select("regulation_id", "always", F.when(F.size("part") > 0, sign).otherwise(0).alias("sign"), F.array_sort(F.concat("pre", "part")).alias("need")), "needs")
    held = fx.containing(met, _members(spark, d))
    n = met.join(held, "need").groupBy("regulation_id", "always").agg(F.sum(F.when(F.col("sign") == 0, F.col("n"))).alias("n"), F.sum(F.col("n") * F.col("sign")).alias("some"))
    some = F.when(F.col("always"), F.col("n")).otherwise(F.col("some"))
    out = n.select("regulation_id", some.alias("support"), (F.col("n") - some).alias("conflicts"))
    return out.unionByName(hits) if every.where(wide).limit(1).count() else out


@query("select first, regulation_id as copy from (select regulation_id, min(regulation_id) over (partition by pre, eff) first from rule_sets) where first <> regulation_id", True)
def prj_duplicate_rules(spark, d):
    """Each rule that repeats another's preconditions and effects, with the first of them: two rules are equal exactly if they have one first."""
    t = base.rule_sets(spark, d).select("regulation_id", "pre", "eff")
    first = t.groupBy("pre", "eff").agg(F.min("regulation_id").alias("first"))
    return t.join(first, ["pre", "eff"]).where("first <> regulation_id").select("first", F.col("regulation_id").alias("copy"))


# -- time


@query("select id, status, epoch_us(generated_at) generated_at, epoch_us(lead(generated_at) over (partition by id order by generated_at nulls first)) valid_to from (select distinct id, status, generated_at from mechanism_instances where id is not null)")
def tmp_close_intervals(spark, d):
    t = load(spark, d, "mechanism_instances").where("id is not null").select("id", "status", "generated_at").distinct()
    return fx.versions(t, ["id"], "generated_at").select("id", "status", *[F.unix_micros(c).alias(c) for c in ("generated_at", "valid_to")])


@query("select status, count(*) n from (select *, lead(generated_at) over (partition by id order by generated_at nulls first) valid_to from (select distinct id, status, generated_at from mechanism_instances where id is not null)) where (generated_at is null or timestamptz '2025-06-01 00:00:00+00' >= generated_at) and (valid_to is null or timestamptz '2025-06-01 00:00:00+00' < valid_to) group by 1")
def tmp_valid_as_of(spark, d):
    t = load(spark, d, "mechanism_instances").where("id is not null").select("id", "status", "generated_at").distinct()
    at = F.lit("2025-06-01 00:00:00+00:00").cast("timestamp")
    return fx.versions(t, ["id"], "generated_at").where(fx.valid_at(F.col("generated_at"), F.col("valid_to"), at)).groupBy("status").agg(F.count("*").alias("n"))


@query("select id, status, epoch_us(generated_at) generated_at, row_number() over (partition by id order by generated_at nulls first, status) version from (select distinct id, status, generated_at from mechanism_instances where id is not null)")
def tmp_history(spark, d):
    t = load(spark, d, "mechanism_instances").where("id is not null").select("id", "status", "generated_at").distinct()
    version = F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_first("generated_at"), "status"))
    return t.select("id", "status", F.unix_micros("generated_at").alias("generated_at"), version.cast("long").alias("version"))


@query(f"select o.observation_id, epoch_us(max(s.arrived_at)) story_arrived from {_OBS} o left join {_STORY} s on s.client = o.client and s.arrived_at <= o.arrived group by 1")
def tmp_as_of_join(spark, d):
    """The latest story of the same client at each observation's arrival, by one sort of both sides instead of a join of pairs."""
    o = _obs(spark, d).select("client", F.col("arrived").alias("t"), "observation_id", F.lit(None).cast("timestamp").alias("s"))
    s = base.stories(spark, d).select("client", F.col("arrived_at").alias("t"), F.lit(None).cast("string").alias("observation_id"), F.col("arrived_at").alias("s"))
    return _as_of(o.unionByName(s))


def _as_of(rows: DataFrame) -> DataFrame:
    # days bound the groups that are sorted: the last value of earlier days is carried over as one row per client and day
    rows = rows.withColumn("day", F.to_date("t"))
    per_day = rows.groupBy("client", "day").agg(F.max("s").alias("last"))
    before = per_day.withColumn("carried", F.max("last").over(Window.partitionBy("client").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("client", "day", "carried")
    w = Window.partitionBy("client", "day").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("here", F.max("s").over(w))
    return run.where("observation_id is not null").join(before.withColumnRenamed("client", "bc").withColumnRenamed("day", "bd"), F.col("client").eqNullSafe(F.col("bc")) & (F.col("day") == F.col("bd")), "left").select("observation_id", F.unix_micros(F.when(F.col("client").isNotNull(), F.coalesce("here", "carried"))).alias("story_arrived"))


# -- statistics


@query("select distinct sig, min(observation_id) over (partition by sig) first_observation from facts", True)
def agg_dedup_facts(spark, d):
    return base.facts(spark, d).groupBy("sig").agg(F.min("observation_id").alias("first_observation"))


@query("select v.status, count(r.regulation_id) n from (values ('candidate'), ('hypothesis'), ('confirmed'), ('retired')) v(status) left join rules r using (status) group by 1", True)
def agg_status_counts(spark, d):
    return stores.counts_by(base.rules(spark, d), "status", ["candidate", "hypothesis", "confirmed", "retired"])


@query("select episode_id, count(*) total, count(*) filter (status = 'success') supports, count(*) filter (status = 'failure') contradicts, epoch_us(max(recorded_at)) latest from (select distinct id, episode_id, status, recorded_at from outcome_records) group by 1")
def agg_evidence_summary(spark, d):
    t = load(spark, d, "outcome_records").select("id", "episode_id", "status", "recorded_at").distinct()
    return t.groupBy("episode_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("supports"), F.count_if(F.col("status") == "failure").alias("contradicts"), F.unix_micros(F.max("recorded_at")).alias("latest"))


@query("select episode_id from (select episode_id, count(*) filter (status = 'success') s, count(*) filter (status = 'failure') c, max(recorded_at) latest from (select distinct id, episode_id, status, recorded_at from outcome_records) group by 1) where s >= 1 and c / (s + c) <= 0.3 and latest >= (select max(recorded_at) from outcome_records) - interval 30 days")
def agg_healthy_evidence(spark, d):
    t = load(spark, d, "outcome_records").select("id", "episode_id", "status", "recorded_at").distinct()
    s, c = (F.count_if(F.col("status") == x) for x in ("success", "failure"))
    sums = t.groupBy("episode_id").agg(s.alias("s"), c.alias("c"), F.max("recorded_at").alias("latest")).where("s >= 1")
    newest = load(spark, d, "outcome_records").agg(F.max("recorded_at").alias("m")).first()["m"]  # one value
    return sums.where((F.col("c") / (F.col("s") + F.col("c")) <= 0.3) & (F.col("latest") >= F.lit(newest) - F.expr("interval 30 days"))).select("episode_id")


@query("select status, count(*) n, count(distinct episode_id) episodes, count(distinct caused_by_action_execution_id) actions from (select distinct id, status, episode_id, caused_by_action_execution_id from outcome_records) group by 1")
def agg_evidence_stats(spark, d):
    t = load(spark, d, "outcome_records").select("id", "status", "episode_id", "caused_by_action_execution_id").distinct()
    return t.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("episode_id").alias("episodes"), F.count_distinct("caused_by_action_execution_id").alias("actions"))


@query("select project, sig, count(distinct observation_id) n, count(distinct observation_id) / any_value(total) support from facts join (select project, count(distinct observation_id) total from facts group by 1) using (project) group by 1, 2 having count(distinct observation_id) / any_value(total) >= 0.02", True)
def agg_common_facts(spark, d):
    """Signatures in at least 2 % of a project's observations."""
    f = base.facts(spark, d).select("project", "observation_id", "sig").distinct()
    totals = f.groupBy("project").agg(F.count_distinct("observation_id").alias("total"))
    return f.groupBy("project", "sig").agg(F.count("*").alias("n")).join(totals, "project").select("project", "sig", "n", (F.col("n") / F.col("total")).alias("support")).where("support >= 0.02")


_DISC = """, c as (select project, sig, count(distinct observation_id) n from facts where project is not null group by 1, 2), t as (select project, count(distinct observation_id) total from facts where project is not null group by 1), g as (select sig, count(distinct observation_id) / (select count(distinct observation_id) from facts) f from facts group by 1),
s as (select project, sig, n / total support, n / total / f lift from c join t using (project) join g using (sig) where n / total >= 0.005)
select project, sig, round(support, 9) support, round(lift, 9) lift, rank from (select *, row_number() over (partition by project order by round(support * lift, 12) desc, sig) rank from s where lift > 1) where rank <= 5"""


@query(_DISC, True)
def agg_discriminative_patterns(spark, d):
    """Per project the five signatures that are most frequent there against their frequency everywhere."""
    f = base.facts(spark, d).select("project", "observation_id", "sig").distinct()
    everywhere = f.select("observation_id", "sig").distinct().groupBy("sig").agg(F.count("*").alias("all_n"))
    total = f.select(F.count_distinct("observation_id").alias("n")).first()["n"]  # one value
    f = f.where("project is not null")
    here = f.groupBy("project", "sig").agg(F.count("*").alias("n")).join(f.groupBy("project").agg(F.count_distinct("observation_id").alias("total")), "project")
    s = here.withColumn("support", F.col("n") / F.col("total")).where("support >= 0.005").join(everywhere, "sig").withColumn("lift", F.col("support") / (F.col("all_n") / F.lit(total)))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc(F.round(F.col("support") * F.col("lift"), 12)), "sig"))
    return s.where("lift > 1").withColumn("rank", rank.cast("long")).where("rank <= 5").select("project", "sig", F.round("support", 9).alias("support"), F.round("lift", 9).alias("lift"), "rank")


@query(""", cl as (select * from (select *, count(*) over (partition by cluster_key) n from (select observation_id, array_to_string(preds, '+') || '@' || coalesce(project, '') cluster_key from observation_sets)) where n >= 3)
select cluster_key, k "key", min(v) "value", count(distinct observation_id) n from cl join ctx using (observation_id) group by 1, 2 having count(distinct v) = 1""", True)
def agg_constant_context(spark, d):
    """The context entries that are constant over all observations of a cluster that have them."""
    t = base.observation_sets(spark, d).select("observation_id", F.concat(F.array_join("preds", "+"), F.lit("@"), F.coalesce("project", F.lit(""))).alias("cluster_key"))
    big = t.groupBy("cluster_key").agg(F.count("*").alias("n")).where("n >= 3").select("cluster_key")
    c = base.contexts(spark, d).join(t.join(big, "cluster_key", "leftsemi"), "observation_id")
    same = c.groupBy("cluster_key", "key").agg(F.min("value").alias("value"), F.max("value").alias("other"), F.count_distinct("observation_id").alias("n"))
    return same.where("value = other").select("cluster_key", "key", "value", "n")


@query("select cluster_key, count(*) n, min(observation_id) first_id from (select observation_id, array_to_string(preds, '+') || '@' || coalesce(project, '') cluster_key from observation_sets) group by 1 having count(*) >= 3", True)
def agg_cluster_by_key(spark, d):
    t = base.observation_sets(spark, d).withColumn("cluster_key", F.concat(F.array_join("preds", "+"), F.lit("@"), F.coalesce("project", F.lit(""))))
    return t.groupBy("cluster_key").agg(F.count("*").alias("n"), F.min("observation_id").alias("first_id")).where("n >= 3")


@query("select pred, count(distinct val) vals, min(val) low, max(val) high from facts group by 1", True)
def agg_values_by_pred(spark, d):
    return base.facts(spark, d).groupBy("pred").agg(F.count_distinct("val").alias("vals"), F.min("val").alias("low"), F.max("val").alias("high"))


@query("select pred, n from (select pred, count(*) n from facts group by 1) order by n desc, pred limit 20", True)
def agg_parameter_frequency(spark, d):
    return base.facts(spark, d).groupBy("pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pred").limit(20)


_TRADE = """, b as (select observation_id, project, pred, max(case when lower(val) in ('true', 'improved', 'fixed', 'resolved') or contains(lower(val), 'improv') then 1 else 0 end) up, max(case when lower(val) in ('false', 'degraded', 'broken', 'failed') or contains(lower(val), 'degrad') or contains(lower(val), 'fail') then 1 else 0 end) down from facts where project is not null group by 1, 2, 3)
select i.pred improved, g.pred degraded, count(*) n from b i join b g on i.project = g.project and i.observation_id <> g.observation_id and i.pred <> g.pred where i.up = 1 and g.down = 1 group by 1, 2"""


@query(_TRADE, True)
def agg_tradeoffs(spark, d):
    """How often one predicate is up in one observation of a project and another down in a second one.

    Pairs of observations are never made: they are the product of two counts
    per project, less the pairs inside one observation.
    """
    f = base.facts(spark, d).where("project is not null")
    up = f.where(fx.improved(F.col("val"))).select("project", "observation_id", "pred").distinct()
    down = f.where(fx.degraded(F.col("val"))).select("project", "observation_id", "pred").distinct()
    u = up.groupBy("project", F.col("pred").alias("improved")).agg(F.count("*").alias("nu"))
    w = down.groupBy("project", F.col("pred").alias("degraded")).agg(F.count("*").alias("nd"))
    every = u.join(w, "project").where("improved <> degraded").groupBy("improved", "degraded").agg(F.sum(F.col("nu") * F.col("nd")).alias("n"))
    same = up.select("observation_id", "project", F.col("pred").alias("improved")).join(down.select("observation_id", "project", F.col("pred").alias("degraded")), ["observation_id", "project"]).where("improved <> degraded").groupBy("improved", "degraded").agg(F.count("*").alias("m"))
    return every.join(same, ["improved", "degraded"], "left").select("improved", "degraded", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")


_UNCOV = """, v as (select pred, count(distinct val) vals, count(*) n from facts group by 1 having count(distinct val) between 2 and 50), top as (select * from v order by n desc, pred limit 10),
combo as (select a.pred a, b.pred b, count(distinct a.val || chr(1) || b.val) seen from facts a join facts b on a.observation_id = b.observation_id and a.pred < b.pred where a.pred in (select pred from top) and b.pred in (select pred from top) group by 1, 2)
select x.pred a, y.pred b, x.vals * y.vals possible, coalesce(seen, 0) seen from top x join top y on x.pred < y.pred left join combo c on c.a = x.pred and c.b = y.pred where x.vals * y.vals > 2 and coalesce(seen, 0) / (x.vals * y.vals) < 0.5"""


@query(_UNCOV, True)
def agg_uncovered_regions(spark, d):
    """Pairs of frequent predicates of which less than half of the possible value combinations were seen."""
    f = base.facts(spark, d)
    top = f.groupBy("pred").agg(F.count_distinct("val").alias("vals"), F.count("*").alias("n")).where("vals between 2 and 50").orderBy(F.desc("n"), "pred").limit(10)
    t = f.join(F.broadcast(top.select("pred")), "pred", "leftsemi").select("observation_id", "pred", "val").distinct()  # ten rows
    a, b = (t.select("observation_id", F.col("pred").alias(x), F.col("val").alias(f"v{x}")) for x in "ab")
    seen = a.join(b, "observation_id").where("a < b").groupBy("a", "b").agg(F.count_distinct("va", "vb").alias("seen"))
    pairs = _pairs(top)
    return pairs.join(seen, ["a", "b"], "left").select("a", "b", "possible", F.coalesce("seen", F.lit(0)).alias("seen")).where(F.col("possible").__gt__(2) & (F.col("seen") / F.col("possible") < 0.5))


def _pairs(top: DataFrame) -> DataFrame:
    """The pairs a < b of the at most ten rows of top, with the product of their value counts."""
    one = top.agg(F.array_sort(F.collect_list(F.struct("pred", "vals"))).alias("p"))
    pairs = F.flatten(F.transform("p", lambda x: F.transform(F.filter("p", lambda y: y["pred"] > x["pred"]), lambda y: F.struct(x["pred"].alias("a"), y["pred"].alias("b"), (x["vals"] * y["vals"]).alias("possible")))))
    return one.select(F.explode(pairs).alias("q")).select("q.a", "q.b", "q.possible")


_CONFLICT = """, c as (select pre_preds, e.pred, min(r.regulation_id) id, count(distinct r.regulation_id) n, min(e.val) low, max(e.val) high from rule_sets r join rule_facts e on e.regulation_id = r.regulation_id and e.side = 'eff' and e.val is not null where len(pre_preds) > 0 group by 1, 2)
select a.id left_id, b.id right_id, a.pred, a.n left_n, b.n right_n from c a join c b on a.pred = b.pred and (a.id < b.id or (a.id = b.id and a.pre_preds = b.pre_preds)) where not (a.low = a.high and b.low = b.high and a.low = b.low)
and len(list_intersect(a.pre_preds, b.pre_preds)) / len(list_distinct(list_concat(a.pre_preds, b.pre_preds))) >= 0.3"""


@query(_CONFLICT, True)
def agg_conflicting_rules(spark, d):
    """Classes of rules with alike preconditions (Jaccard of predicates >= 0.3) that predict different values of one predicate.

    Rules with equal precondition predicates and effect predicate are one
    class, named by its first rule, so copies are never paired; a class that
    contradicts itself is paired with itself. Classes meet only over a shared
    effect predicate and a shared precondition predicate.
    """
    s = base.rule_sets(spark, d).where(F.size("pre_preds") > 0).select("regulation_id", "pre_preds")
    e = base.rule_facts(spark, d).where("side = 'eff' and val is not null").select("regulation_id", "pred", "val").distinct()
    c = s.join(e, "regulation_id").groupBy("pre_preds", "pred").agg(F.min("regulation_id").alias("id"), F.count_distinct("regulation_id").alias("n"), F.min("val").alias("low"), F.max("val").alias("high"))
    c = materialize(c, "rule-classes")
    keyed = c.select("pred", F.explode("pre_preds").alias("k"), "id", F.struct("id", "n", "pre_preds", "low", "high").alias("c"))
    # each side of a hot key is cut into as many parts, so that its pairs are made by many tasks
    pairs = salted_join(keyed.withColumnRenamed("c", "a"), keyed.drop("id").withColumnRenamed("c", "b"), ["pred", "k"], hot=hot_keys(keyed, ["pred", "k"], least=1000)).drop("id")
    mine = (F.col("a.id") < F.col("b.id")) | ((F.col("a.id") == F.col("b.id")) & (F.col("a.pre_preds") == F.col("b.pre_preds")))
    same = (F.col("a.low") == F.col("a.high")) & (F.col("b.low") == F.col("b.high")) & (F.col("a.low") == F.col("b.low"))
    found = pairs.where(mine & ~same & (fx.jaccard(F.col("a.pre_preds"), F.col("b.pre_preds")) >= 0.3))
    return found.groupBy("pred", "a", "b").agg(F.lit(1)).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), "pred", F.col("a.n").alias("left_n"), F.col("b.n").alias("right_n"))


@query(", e as (select distinct r.regulation_id, pre_preds, f.pred, f.val from rule_sets r join rule_facts f on f.regulation_id = r.regulation_id and f.side = 'eff' and f.val is not null where len(pre_preds) > 0) select regulation_id, pred, val, min(regulation_id) over (partition by pre_preds, pred) class_id from e", True)
def agg_conflict_classes(spark, d):
    """The class of every rule and effect predicate in agg_conflicting_rules, with the values the rule predicts."""
    s = base.rule_sets(spark, d).where(F.size("pre_preds") > 0).select("regulation_id", "pre_preds")
    e = s.join(base.rule_facts(spark, d).where("side = 'eff' and val is not null").select("regulation_id", "pred", "val").distinct(), "regulation_id")
    c = e.groupBy("pre_preds", "pred").agg(F.min("regulation_id").alias("class_id"))
    return e.join(c, ["pre_preds", "pred"]).select("regulation_id", "pred", "val", "class_id")


@query("select pred, min(x) low, max(x) high, count(x) n from (select pred, try_cast(val as double) x from facts) where x is not null group by 1", True)
def agg_numeric_ranges(spark, d):
    x = F.when(F.col("val").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.col("val").try_cast("double"))
    return base.facts(spark, d).select("pred", x.alias("x")).where("x is not null").groupBy("pred").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))


@query("select a.p a, b.p b, count(*) n from (select observation_id, unnest(preds) p from observation_sets) a join (select observation_id, unnest(preds) p from observation_sets) b on a.observation_id = b.observation_id and a.p < b.p group by 1, 2", True)
def agg_cooccurrence(spark, d):
    return fx.pair_counts(base.observation_sets(spark, d), "observation_id", "preds")


@query("select distinct pred from facts", True)
def agg_all_parameters(spark, d):
    return base.facts(spark, d).select("pred").distinct()


@query("select regulation_id, case when s + c > 0 then c / (s + c) else 0 end rate from rules", True)
def agg_contradiction_rate(spark, d):
    n = F.col("s") + F.col("c")
    return base.rules(spark, d).select("regulation_id", F.when(n > 0, F.col("c") / n).otherwise(0.0).alias("rate"))


@query("select regulation_id, round((select sum(exp(lgamma(s + c + 1) - lgamma(k + 1) - lgamma(s + c - k + 1) - (s + c) * ln(2.0))) from (select unnest(range(s, s + c + 1)) k)), 6) p from rules", True)
def agg_binomial_tail(spark, d):
    """The probability of at least s supports among s + c fair trials, exact: the terms are built from each other by products."""
    n = F.col("s") + F.col("c")
    log_terms = F.aggregate(F.sequence(F.lit(0), n.cast("int")), F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("sum")), lambda acc, k: F.struct(
        F.when(k == 0, 0.0).otherwise(acc["t"] + F.log((n - k + 1) / F.greatest(k, F.lit(1)))).alias("t"),
        (acc["sum"] + F.when(k >= F.col("s"), F.exp(F.when(k == 0, 0.0).otherwise(acc["t"] + F.log((n - k + 1) / F.greatest(k, F.lit(1)))) - n * F.log(F.lit(2.0)))).otherwise(0.0)).alias("sum"),
    ))
    return base.rules(spark, d).select("regulation_id", F.round(log_terms["sum"], 6).alias("p"))


@query("select regulation_id, round(case when s + c = 0 then 0.05 else least(0.99, s / (s + c) * least(1.0, log2(s + c + 1) / 10) * case status when 'confirmed' then 1.0 when 'hypothesis' then 0.7 when 'candidate' then 0.4 else 0.1 end) end, 9) trust from rules", True)
def agg_trust(spark, d):
    return base.rules(spark, d).select("regulation_id", F.round(_trust(), 9).alias("trust"))


def _trust():
    n = F.col("s") + F.col("c")
    w = F.when(F.col("status") == "confirmed", 1.0).when(F.col("status") == "hypothesis", 0.7).when(F.col("status") == "candidate", 0.4).otherwise(0.1)
    return F.when(n == 0, 0.05).otherwise(F.least(F.lit(0.99), F.col("s") / n * F.least(F.lit(1.0), F.log2(n + 1) / 10) * w))


@query("select tier, count(*) n from (select case when t >= 0.8 then 'axiom' when t >= 0.3 then 'theorem' else 'hypothesis' end tier from (select case when s + c = 0 then 0.05 else least(0.99, s / (s + c) * least(1.0, log2(s + c + 1) / 10) * case status when 'confirmed' then 1.0 when 'hypothesis' then 0.7 when 'candidate' then 0.4 else 0.1 end) end t from rules)) group by 1", True)
def agg_trust_tiers(spark, d):
    t = _trust()
    return base.rules(spark, d).groupBy(F.when(t >= 0.8, "axiom").when(t >= 0.3, "theorem").otherwise("hypothesis").alias("tier")).agg(F.count("*").alias("n"))


@query("select action_kind, count(*) n, count(*) filter (execution_status = 'completed') completed, avg(case when execution_status = 'completed' then 1.0 else 0.0 end) success_rate from (select distinct id, action_kind, execution_status from action_executions) group by 1")
def agg_execution_stats(spark, d):
    t = load(spark, d, "action_executions").select("id", "action_kind", "execution_status").distinct()
    done = F.col("execution_status") == "completed"
    return t.groupBy("action_kind").agg(F.count("*").alias("n"), F.count_if(done).alias("completed"), F.avg(F.when(done, 1.0).otherwise(0.0)).alias("success_rate"))


@query(f"select status, outcome, count(*) n, count(*) filter (not compiled) uncompiled, avg(epoch_ms(resolved_at) - epoch_ms(arrived_at)) mean_ms from {_STORY} group by 1, 2")
def agg_story_stats(spark, d):
    ms = F.unix_millis("resolved_at") - F.unix_millis("arrived_at")
    return base.stories(spark, d).groupBy("status", "outcome").agg(F.count("*").alias("n"), F.count_if(~F.col("compiled")).alias("uncompiled"), F.avg(ms).alias("mean_ms"))


@query("select status, count(*) n, round(avg(len(claim_ids)), 9) mean_claims from (select distinct id, status, claim_ids from mechanism_instances) group by 1")
def agg_claim_stats(spark, d):
    t = load(spark, d, "mechanism_instances").select("id", "status", "claim_ids").distinct()
    return t.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("claim_ids").isNotNull(), F.size("claim_ids"))), 9).alias("mean_claims"))


# -- stores


@query(f"select id, raw_input from {_STORY} where contains(lower(raw_input), 'kiln')")
def sto_search_stories(spark, d):
    return base.stories(spark, d).where(stores.contains(F.col("raw_input"), "kiln")).select("id", "raw_input")


@query(f"select id from {_STORY} where status = 'resolved' and outcome = 'success' and not compiled")
def sto_resolved_for_compile(spark, d):
    return base.stories(spark, d).where("status = 'resolved' and outcome = 'success' and not compiled").select("id")


@query("select id, episode_id, row_number() over (partition by episode_id order by recorded_at, id) - 1 seq from (select id, min(episode_id) episode_id, min(recorded_at) recorded_at from outcome_records where id is not null group by 1)")
def sto_event_sequence(spark, d):
    t = load(spark, d, "outcome_records").where("id is not null").groupBy("id").agg(F.min("episode_id").alias("episode_id"), F.min("recorded_at").alias("recorded_at"))
    return t.select("id", "episode_id", (F.row_number().over(Window.partitionBy("episode_id").orderBy("recorded_at", "id")) - 1).cast("long").alias("seq"))


@query("select distinct id from mechanism_instances where list_contains(claim_ids, (select min(c) from (select unnest(claim_ids) c from mechanism_instances)))")
def sto_by_claim(spark, d):
    t = load(spark, d, "mechanism_instances")
    first = t.select(F.explode("claim_ids").alias("c")).agg(F.min("c").alias("c"))
    return t.select("id", F.explode("claim_ids").alias("c")).join(first, "c", "leftsemi").select("id").distinct()


@query(f"select id, client from (select id, client, row_number() over (partition by client order by id) rn, count(*) over (partition by client) n from {_STORY}) where rn <= ceil(0.8 * n)")
def ent_split_train(spark, d):
    """The first four fifths of each client's stories, by id."""
    s = base.stories(spark, d).select("id", "client")
    n = s.groupBy(F.col("client").alias("__client")).agg(F.count("*").alias("n"))
    t = ranked(s, ["client"], ["id"], "rn").join(n, F.col("client").eqNullSafe(F.col("__client")))
    return t.where(F.col("rn") <= F.ceil(0.8 * F.col("n"))).select("id", "client")


@query("select avg(case when a.exp <> b.exp then 1.0 else 0.0 end) gain, a.action_kind from (select action_kind, id, execution_status exp from (select distinct id, action_kind, execution_status from action_executions)) a join (select distinct id, action_kind, execution_status exp from action_executions) b on a.action_kind = b.action_kind and a.id < b.id group by a.action_kind")
def gov_information_gain(spark, d):
    """Per kind of action the share of pairs whose outcomes differ: from the counts of outcomes, without making pairs."""
    t = load(spark, d, "action_executions").select("id", "action_kind", "execution_status").distinct()
    c = t.groupBy("action_kind", "execution_status").agg(F.count("*").alias("n")).groupBy("action_kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("execution_status").isNotNull(), F.col("n") * F.col("n"))).alias("sq"), F.sum(F.when(F.col("execution_status").isNull(), F.col("n"))).alias("nulls"))
    n, k = F.col("n"), F.coalesce("nulls", F.lit(0))
    known = n - k
    return c.where("n > 1 and action_kind is not null").select((((known * known - F.coalesce("sq", F.lit(0))) / 2) / (n * (n - 1) / 2)).alias("gain"), "action_kind")


@query("select ep episode_id, min(i) broken_at from (select episode_id ep, i, case when lead(a) over (partition by episode_id order by i) <> b then true else false end brk from (select episode_id, row_number() over (partition by episode_id order by recorded_at, id) i, status a, status b from (select distinct id, episode_id, status, recorded_at from outcome_records))) where brk group by 1")
def gov_chain_break(spark, d):
    """The first place of each episode at which the outcome changes."""
    t = load(spark, d, "outcome_records").select("id", "episode_id", "status", "recorded_at").distinct()
    w = Window.partitionBy("episode_id").orderBy("recorded_at", "id")
    s = t.select("episode_id", F.row_number().over(w).cast("long").alias("i"), (F.lead("status").over(w) != F.col("status")).alias("brk"))
    return s.where("brk").groupBy("episode_id").agg(F.min("i").alias("broken_at"))


@query("select record_table, field, count(*) references_, count(distinct k) targets from (select 'prediction_errors' record_table, 'outcome_record_id' field, lower(trim(outcome_record_id)) k from (select distinct id, outcome_record_id from prediction_errors) where trim(outcome_record_id) not in ('', 'null')) group by 1, 2")
def aud_reference_counts(spark, d):
    r = Reference("prediction_errors", "outcome_record_id", "outcome_records")
    t = load(spark, d, r.record_table).select("id", r.field).distinct().select(F.lower(F.trim(r.field)).alias("k")).where("k not in ('', 'null')")
    return t.agg(F.count("*").alias("references_"), F.count_distinct("k").alias("targets")).select(F.lit(r.record_table).alias("record_table"), F.lit(r.field).alias("field"), "references_", "targets")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
