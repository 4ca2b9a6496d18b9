"""Queries on audits, governance records, compilation, refutation, search and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import text_features as tx
from causeway.operators import audit, graph, reasoning
from causeway.operators import facts as fx
from causeway.plans import base, problems_sql, texts
from causeway.plans.base import SQL
from causeway.session import materialize
from causeway.skew import ranked
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


# -- audits


def _audit_sql() -> str:
    parts = []
    for c in audit.CHECKS:
        head = f"select distinct '{c.table}' record_table, id record_id, '{c.code}' code, '{c.field}' field from {c.table} where id is not null and "
        if isinstance(c, audit.Refers):
            k = problems_sql.key(c.field)
            parts.append(head + f"{k} is not null and {k} not in (select {problems_sql.key('id')} from {c.target} where {problems_sql.key('id')} is not null)")
        elif isinstance(c, audit.OneOf):
            parts.append(head + f"coalesce({c.field}, '') not in ({', '.join(repr(v) for v in c.values)})")
        elif isinstance(c, audit.Filled):
            parts.append(head + f"coalesce(trim({c.field}), '') = ''")
        elif isinstance(c, audit.Between):
            parts.append(head + f"not ({c.field} between {c.low} and {c.high})")
        elif isinstance(c, audit.Matches):
            parts.append(head + f"not regexp_matches({c.field}, '{c.pattern}')")
        elif isinstance(c, audit.Needs):
            parts.append(head + f"{c.when} and not coalesce({c.then.replace('size(', 'len(')}, false)")
        elif isinstance(c, audit.Referred):
            k = problems_sql.key(c.source_field)
            parts.append(head + f"{c.when} and {problems_sql.key('id')} not in (select {k} from {c.source} where {k} is not null)")
    return " union all ".join(parts)


def _domain_tables(spark, d):
    return {t: load(spark, d, t) for t in ("action_executions", "outcome_records", "prediction_errors", "mechanism_instances", "experiment_designs", "stories")}


@query(_audit_sql(), False)
def aud_findings(spark, d):
    return audit.findings(_domain_tables(spark, d))


@query(f"select record_table, code, count(*) n from ({_audit_sql()}) group by 1, 2", False)
def aud_summary(spark, d):
    return audit.findings(_domain_tables(spark, d)).groupBy("record_table", "code").agg(F.count("*").alias("n"))


@query("select s.id, count(distinct o.id) outcomes, count(distinct e.id) errors from (select distinct id from stories where id is not null) s left join (select distinct id, episode_id from outcome_records) o on o.episode_id = s.id left join (select distinct id, outcome_record_id from prediction_errors) e on e.outcome_record_id = o.id group by 1", False)
def aud_episode_coverage(spark, d):
    """For each episode its outcomes and their errors, counted bottom up so that no rows are multiplied."""
    o = load(spark, d, "outcome_records").select(F.col("id").alias("oid"), "episode_id").distinct()
    e = load(spark, d, "prediction_errors").select("id", F.col("outcome_record_id").alias("oid")).distinct().groupBy("oid").agg(F.count_distinct("id").alias("k"))
    per = o.join(e, "oid", "left").groupBy(F.col("episode_id").alias("id")).agg(F.count_distinct("oid").alias("outcomes"), F.sum(F.coalesce("k", F.lit(0))).alias("errors"))
    return load(spark, d, "stories").where("id is not null").select("id").distinct().join(per, "id", "left").select("id", F.coalesce("outcomes", F.lit(0)).alias("outcomes"), F.coalesce("errors", F.lit(0)).alias("errors"))


# -- governance records as data


@query("with p as (select distinct regulation_id, sig from rule_facts where side = 'pre'), e as (select distinct sig from rule_facts where side = 'eff' and sig is not null) select p.regulation_id, count(*) premises, count(*) filter (e.sig is null) roots from p left join e on e.sig = p.sig group by 1".replace("with p as", ", p as", 1))
def gov_proof_roots(spark, d):
    """The premises of each rule that no rule concludes."""
    f = base.rule_facts(spark, d).select("regulation_id", "side", "sig").distinct()
    e = f.where("side = 'eff'").select("sig", F.lit(True).alias("derived")).distinct()
    return f.where("side = 'pre'").join(e, "sig", "left").groupBy("regulation_id").agg(F.count("*").alias("premises"), F.count_if(F.col("derived").isNull()).alias("roots"))


@query(" select a.observation_id, round(len(list_intersect(a.sigs, b.sigs)) / len(a.sigs), 9) fidelity from observation_sets a join (select list_distinct(list(sig)) sigs from rule_facts where side = 'eff') b on len(a.sigs) > 0")
def gov_fidelity(spark, d):
    """The share of each observation's facts that some rule would reproduce."""
    f = base.facts(spark, d).select("observation_id", "sig").distinct()
    e = base.rule_facts(spark, d).where("side = 'eff'").select("sig", F.lit(1).alias("hit")).distinct()
    return f.join(e, "sig", "left").groupBy("observation_id").agg(F.round(F.count("hit") / F.count("*"), 9).alias("fidelity"))


_BOUNDS = [("temp_c", "above", 500.0), ("latency_ms", "above", 10000.0), ("queue_len", "below", 1.0)]
_BV = "(values " + ", ".join(f"('{a}', '{k}', {x})" for a, k, x in _BOUNDS) + ") b(var, kind, bound)"


@query(f"select b.var, b.kind, count(*) n from (select split_part(pred, '.', 2) var, try_cast(val as double) x from facts) f join {_BV} on b.var = f.var and ((b.kind = 'above' and x > bound) or (b.kind = 'below' and x < bound)) group by 1, 2")
def gov_boundary_violations(spark, d):
    """Values beyond archived thresholds: an equality on the variable first, the range as residual."""
    x = F.when(F.col("val").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.col("val").try_cast("double"))
    f = base.facts(spark, d).select(F.get(F.split("pred", "[.]"), F.lit(1)).alias("var"), x.alias("x")).where("x is not null")
    b = spark.createDataFrame(_BOUNDS, "var string, kind string, bound double")
    return f.join(F.broadcast(b), "var").where("(kind = 'above' and x > bound) or (kind = 'below' and x < bound)").groupBy("var", "kind").agg(F.count("*").alias("n"))  # a fixed list


@query("select distinct observation_id, len(list_filter(map_keys(context.extra), lambda k: k <> 'site')) visible from observations where observation_id is not null and context.extra is not null", False)
def gov_filter_blind_zone(spark, d):
    """Context signals without those in an observer's blind zone."""
    seen = F.map_filter("context.extra", lambda k, v: ~F.array_contains(F.array(F.lit("site")), k))
    return load(spark, d, "observations").where("observation_id is not null and context.extra is not null").select("observation_id", F.size(seen).cast("long").alias("visible")).distinct()


@query("select pred, area, kind from (select p.pred, p.area, r.kind, row_number() over (partition by p.pred order by r.prio desc, r.kind) rn from (select lower(trim(pred)) pred, min(area) area from predicates group by 1) p join (values ('core', 10, 'allow'), ('plant', 5, 'deny'), ('core', 1, 'deny')) r(area, prio, kind) on r.area = p.area) where rn = 1", False)
def gov_priority_rules(spark, d):
    """Of several rules for an area the one with the highest priority decides."""
    rules = spark.createDataFrame([("core", 10, "allow"), ("plant", 5, "deny"), ("core", 1, "deny")], "area string, prio int, kind string")
    best = rules.groupBy("area").agg(F.max_by("kind", "prio").alias("kind"))
    p = load(spark, d, "predicates").groupBy(F.lower(F.trim("pred")).alias("pred")).agg(F.min("area").alias("area"))
    return p.join(best, "area").select("pred", "area", "kind")


@query("select base_line, id best, round(gain, 9) gain from (select base_line, id, expected_information_gain gain, row_number() over (partition by base_line order by expected_information_gain desc nulls last, id) rn from (select distinct id, base_line, expected_information_gain from experiment_designs)) where rn = 1", False)
def gov_select_experiment(spark, d):
    t = load(spark, d, "experiment_designs").select("id", "base_line", F.col("expected_information_gain").alias("gain")).distinct()
    rn = F.row_number().over(Window.partitionBy("base_line").orderBy(F.desc_nulls_last("gain"), "id"))
    return t.withColumn("rn", rn).where("rn = 1").select("base_line", F.col("id").alias("best"), F.round("gain", 9).alias("gain"))


@query("select e.id, o.status outcome, a.action_kind, s.client from (select distinct id, outcome_record_id, caused_by_action_execution_id from prediction_errors) e join (select distinct id, status, episode_id from outcome_records) o on o.id = e.outcome_record_id join (select distinct id, action_kind from action_executions) a on a.id = e.caused_by_action_execution_id left join (select distinct id, client from stories) s on s.id = o.episode_id", False)
def gov_error_lineage(spark, d):
    """Each prediction error with the outcome, action and episode behind it."""
    e = load(spark, d, "prediction_errors").select("id", "outcome_record_id", "caused_by_action_execution_id").distinct()
    o = load(spark, d, "outcome_records").select(F.col("id").alias("outcome_record_id"), F.col("status").alias("outcome"), "episode_id").distinct()
    a = load(spark, d, "action_executions").select(F.col("id").alias("caused_by_action_execution_id"), "action_kind").distinct()
    s = load(spark, d, "stories").select(F.col("id").alias("episode_id"), "client").distinct()
    return e.join(o, "outcome_record_id").join(a, "caused_by_action_execution_id").join(s, "episode_id", "left").select("id", "outcome", "action_kind", "client")


# -- graph: compilation, conjunctions, invalidation


@query("select a.src, b.dst, case when a.mode = 'compiled' and b.mode = 'compiled' then 'direct' else 'candidate' end mode_, round(a.weight * b.weight, 9) weight from edges a join edges b on a.dst = b.src and a.src <> b.dst where a.weight >= 0.5 and b.weight >= 0.5")
def gra_compile_hops(spark, d):
    """Two-hop chains that are legal, with the product of their weights and what they compile to."""
    e = base.edges(spark, d).where("weight >= 0.5")
    a = e.select("src", F.col("dst").alias("via"), F.col("kind").alias("k1"), F.col("weight").alias("w1"), F.col("mode").alias("m1"))
    b = e.select(F.col("src").alias("via"), "dst", F.col("kind").alias("k2"), F.col("weight").alias("w2"), F.col("mode").alias("m2"))
    j = a.join(b, "via").where("src <> dst").where(graph.fold_kinds(F.array("k1", "k2"))["valid"])
    both = (F.col("m1") == "compiled") & (F.col("m2") == "compiled")
    return j.select("src", "dst", F.when(both, "direct").otherwise("candidate").alias("mode_"), F.round(F.col("w1") * F.col("w2"), 9).alias("weight"))


@query("select array_to_string(pre, ' & ') conjunction, len(pre) parts, count(*) rules from rule_sets where len(pre) >= 2 group by 1, 2")
def gra_conjunctions(spark, d):
    """Sets of preconditions that are one node with PART_OF edges, and how many rules use them."""
    r = base.rule_sets(spark, d).where(F.size("pre") >= 2)
    return r.groupBy(F.array_join("pre", " & ").alias("conjunction"), F.size("pre").cast("long").alias("parts")).agg(F.count("*").alias("rules"))


@query("select conjunction, unnest(pre) part from (select distinct array_to_string(pre, ' & ') conjunction, pre from rule_sets where len(pre) >= 2)")
def gra_expand_preconditions(spark, d):
    r = base.rule_sets(spark, d).where(F.size("pre") >= 2).select("pre").distinct()
    return r.select(F.array_join("pre", " & ").alias("conjunction"), F.explode("pre").alias("part"))


# -- rules: refutation, causes, evaluation


@query("select problem_class_id, w word, n from (select problem_class_id, w, count(distinct id) n, any_value(t) t from (select distinct id, problem_class_id, unnest(list_distinct(list_filter(string_split(lower(regexp_replace(raw_input, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda x: len(x) > 2))) w from stories where problem_class_id is not null and raw_input is not null) join (select problem_class_id, count(distinct id) t from stories where raw_input is not null group by 1) using (problem_class_id) group by 1, 2) where n >= 2 and n / t >= 0.5", False)
def exp_analyze_batch(spark, d):
    """Words that at least half of the stories of a problem class have in common."""
    s = load(spark, d, "stories").where("problem_class_id is not null and raw_input is not null").select("id", "problem_class_id", "raw_input").distinct()
    t = s.groupBy("problem_class_id").agg(F.count_distinct("id").alias("t"))
    w = s.select("id", "problem_class_id", F.explode(F.array_distinct(tx.tokens(F.col("raw_input")))).alias("word")).groupBy("problem_class_id", "word").agg(F.count_distinct("id").alias("n"))
    return w.join(t, "problem_class_id").where("n >= 2 and n / t >= 0.5").select("problem_class_id", "word", "n")


@query("select observation_id, count(*) up from (select distinct observation_id, pred from facts where lower(val) in ('true', 'improved', 'fixed', 'resolved') or contains(lower(val), 'improv')) group by 1")
def prj_improved(spark, d):
    return base.facts(spark, d).where(fx.improved(F.col("val"))).select("observation_id", "pred").distinct().groupBy("observation_id").agg(F.count("*").alias("up"))


@query("select observation_id, count(*) down from (select distinct observation_id, pred from facts where lower(val) in ('false', 'degraded', 'broken', 'failed') or contains(lower(val), 'degrad') or contains(lower(val), 'fail')) group by 1")
def prj_degraded(spark, d):
    return base.facts(spark, d).where(fx.degraded(F.col("val"))).select("observation_id", "pred").distinct().groupBy("observation_id").agg(F.count("*").alias("down"))


@query("select distinct observation_id, coalesce(nullif(array_to_string(raw_refs, ' '), ''), project, '') raw_input from observations where observation_id is not null", False)
def prj_raw_input(spark, d):
    joined = F.array_join("raw_refs", " ")
    return load(spark, d, "observations").where("observation_id is not null").select("observation_id", F.coalesce(F.when(joined != "", joined), "project", F.lit("")).alias("raw_input")).distinct()


# -- views and search


@query("select regulation_id from rule_sets where contains(array_to_string(list_concat(pre, eff), ' '), 'sealed|true')")
def view_search(spark, d):
    return base.rule_sets(spark, d).where(F.array_join(F.concat("pre", "eff"), " ").contains("sealed|true")).select("regulation_id")


@query("select regulation_id, pred, val from rule_facts where side = 'eff' and val is not null group by all")
def view_to_rules(spark, d):
    """View contents split at the first separator into predicate and value."""
    e = base.rule_facts(spark, d).where("side = 'eff' and val is not null").select("regulation_id", "sig").distinct()
    parts = F.split("sig", "[|]", 2)
    return e.select("regulation_id", parts[0].alias("pred"), parts[1].alias("val"))


@query("select pred, count(distinct regulation_id) n, cast(sum(s) as bigint) support, max(updated) latest from (select distinct f.regulation_id, f.pred, r.s, epoch_us(r.updated_at) updated from rule_facts f join rules r using (regulation_id)) group by 1")
def view_merge_clusters(spark, d):
    f = base.rule_facts(spark, d).select("regulation_id", "pred").distinct().join(base.rules(spark, d), "regulation_id")
    return f.groupBy("pred").agg(F.count("*").alias("n"), F.sum("s").alias("support"), F.max(F.unix_micros("updated_at")).alias("latest"))


@query("select source, id, score from (select source, id, score, row_number() over (partition by source order by score desc, id) rn from (select 'story' source, id, 100.0 * (case when contains(t, 'kiln') then 1 else 0 end + case when contains(t, 'slow') then 1 else 0 end) / 2 score from (select distinct id, lower(raw_input) t from stories where id is not null and raw_input is not null) union all select 'rule', regulation_id, 100.0 * (case when contains(t, 'kiln') then 1 else 0 end + case when contains(t, 'slow') then 1 else 0 end) / 2 from (select regulation_id, array_to_string(list_concat(pre, eff), ' ') t from rule_sets)) where score > 0) where rn <= 3")
def rct_search(spark, d):
    """One query over several sources, the three best of each."""
    words = ["kiln", "slow"]
    s = load(spark, d, "stories").where("id is not null and raw_input is not null").select(F.lit("story").alias("source"), "id", F.lower("raw_input").alias("t")).distinct()
    r = base.rule_sets(spark, d).select(F.lit("rule").alias("source"), F.col("regulation_id").alias("id"), F.array_join(F.concat("pre", "eff"), " ").alias("t"))
    score = 100.0 * sum((F.when(F.col("t").contains(w), 1).otherwise(0) for w in words), F.lit(0)) / len(words)
    both = s.unionByName(r).select("source", "id", score.alias("score")).where("score > 0")
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "id"))
    return both.withColumn("rn", rn).where("rn <= 3").select("source", "id", "score")


@query()
def txt_keyword_clusters(spark, d):
    """The leader of every document with keywords: greedy leader clusters of the vectors of its ten leading keywords at cosine 0.3.

    Documents with the same vector are one class, which is clustered by its first.
    """
    top = materialize(texts.txt_tfidf(spark, d).where("tfidf > 0"), "keyword-vectors")
    sets = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word", "tfidf"))).alias("v"))
    own = materialize(sets.join(sets.groupBy("v").agg(F.min("doc_id").alias("class_id")), "v").select("doc_id", "class_id"), "classes")
    one = own.where("doc_id = class_id").select("doc_id")
    leaders = reasoning.cosine_leaders(top.join(one, "doc_id", "leftsemi"), "doc_id", "word", "tfidf", 0.3).withColumnRenamed("doc_id", "class_id")
    return own.join(leaders, "class_id").select("doc_id", "leader")


@query("select doc_id, round(10.0 * sum(idf * least(3, n)) / (3 * sum(idf)), 1) score from (select doc_id, w, idf, (length(lower(text)) - length(replace(lower(text), w, ''))) / length(w) n from documents, (values ('rule', 1.0), ('support', 2.0), ('writer', 1.5)) k(w, idf) where text is not null) group by 1 having sum(n) > 0", False)
def txt_keyword_score(spark, d):
    """Weighted keyword counts of each text, each counted three times at most, on a scale of ten."""
    low = F.lower("text")
    words = {"rule": 1.0, "support": 2.0, "writer": 1.5}
    count = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    total = sum((F.least(F.lit(3.0), count(w)) * x for w, x in words.items()), F.lit(0.0))
    some = sum((count(w) for w in words), F.lit(0.0)) > 0
    return load(spark, d, "documents").where(F.col("text").isNotNull() & some).select("doc_id", F.round(10.0 * total / (3 * sum(words.values())), 1).alias("score"))


@query("""with s as (select distinct on (id) id, client, outcome from stories where id is not null order by id, arrived_at), k as (select * from s where client is not null and outcome is not null),
p as (select *, row_number() over (partition by client order by id) <= ceil(0.8 * count(*) over (partition by client)) train from k), m as (select client, arg_max(outcome, (n, outcome)) guess from (select client, outcome, count(*) n from p where train group by 1, 2) group by 1)
select count(*) n, count(guess) hits, round(avg(case when guess = outcome then 1.0 else 0.0 end), 6) accuracy from p left join m using (client) where not train""", False)
def ent_evaluate(spark, d):
    """Learn the most common outcome of each client on the training part of the stories and score it on the rest."""
    s = base.stories(spark, d).where("client is not null and outcome is not null").select("id", "client", "outcome")
    size = s.groupBy("client").agg(F.count("*").alias("size"))
    split = materialize(ranked(s, ["client"], ["id"], "rn").join(size, "client").withColumn("train", F.col("rn") <= F.ceil(0.8 * F.col("size"))), "split")
    model = split.where("train").groupBy("client", "outcome").agg(F.count("*").alias("n")).groupBy("client").agg(F.max_by("outcome", F.struct("n", "outcome")).alias("guess"))
    return split.where("not train").join(model, "client", "left").agg(F.count("*").alias("n"), F.count("guess").alias("hits"), F.round(F.avg(F.when(F.col("guess") == F.col("outcome"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
