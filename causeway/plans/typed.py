"""Queries on the graph with several kinds of edges: legal paths, exploration, compilation, upkeep, templates, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import graph, templates
from causeway.plans import base
from causeway.plans.base import SQL
from causeway.session import materialize
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


# Fixed values, written out for the SQL apart from the operator's tables: kinds with default forces, and compositions.
_ALG = """ kindf(kind, force) as (values ('is_a', 0), ('part_of', 0), ('causes', 2), ('requires', 0), ('indicates', 3), ('cooccurs', 3), ('similar_to', 3), ('fixes', 2), ('prevents', 2)),
comp(a, b, result, m, p) as (values ('causes', 'causes', 'causes', 0, 0), ('requires', 'causes', 'requires', 0, 0), ('requires', 'requires', 'requires', 0, 0), ('fixes', 'causes', 'fixes', 0, 0), ('prevents', 'causes', 'prevents', 0, 0),
('is_a', 'causes', 'causes', 1, 1), ('is_a', 'fixes', 'fixes', 1, 1), ('is_a', 'requires', 'requires', 1, 1), ('is_a', 'prevents', 'prevents', 1, 1), ('is_a', 'is_a', 'is_a', 0, 0), ('part_of', 'part_of', 'part_of', 0, 0),
('indicates', 'indicates', 'indicates', 3, 2), ('cooccurs', 'cooccurs', 'cooccurs', 3, 2), ('similar_to', 'similar_to', 'similar_to', 3, 2), ('similar_to', 'fixes', 'fixes', 2, 1), ('similar_to', 'causes', 'causes', 2, 1)),
no(a, b) as (values ('indicates', 'causes'), ('cooccurs', 'causes'), ('indicates', 'fixes'), ('cooccurs', 'fixes'), ('part_of', 'causes'), ('indicates', 'prevents'), ('cooccurs', 'prevents'))"""
_NAMES = "['direct', 'inherit', 'candidate', 'weak'][m + 1] as mode, ['necessary', 'sufficient', 'contributory', 'analogical'][f + 1] force, ['inherit', 'revalidate', 'discard'][p + 1] policy"

_TYPED = """, typed as (select src, dst, kind, max(w) weight, cast(sum(s) as bigint) evidence, case when max(m) = 1 then 'compiled' else 'tentative' end as mode from (
  select a.sig src, b.sig dst, case when r.kind = 'observational' then 'indicates' when b.val in ('false', 'no', 'off') then 'prevents' else 'causes' end kind, case when s + c > 0 then s / (s + c) else 0.3 end w, s, case when status = 'confirmed' then 1 else 0 end m
    from (select distinct regulation_id, sig from rule_facts where side = 'pre') a join (select distinct regulation_id, sig, val from rule_facts where side = 'eff') b using (regulation_id) join rules r using (regulation_id) where status <> 'retired' and a.sig <> b.sig
  union all select distinct sig, pred, 'is_a', 1.0, 0, 1 from rule_facts where sig <> pred
  union all select distinct pred, split_part(pred, '.', 1), 'part_of', 1.0, 0, 1 from rule_facts where contains(pred, '.')
  union all select b.pred, a.pred, 'requires', case when s + c > 0 then s / (s + c) else 0.3 end, s, 1 from (select distinct regulation_id, pred from rule_facts where side = 'pre') a join (select distinct regulation_id, pred from rule_facts where side = 'eff') b using (regulation_id) join rules r using (regulation_id) where status = 'confirmed' and a.pred <> b.pred
) group by 1, 2, 3)"""
_START = "(select src node from typed where contains(src, '|') and mode = 'compiled' group by 1 order by count(*) desc, src limit 5)"


def _starts(spark, d):
    """The query set of the walks: the five facts with the most compiled edges."""
    e = base.typed_edges(spark, d).where(F.col("src").contains("|") & (F.col("mode") == "compiled"))
    return e.groupBy(F.col("src").alias("start")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "start").limit(5).select("start")


@query(_TYPED + " select src, dst, kind, round(weight, 9) weight, evidence, mode from typed")
def gra_typed_refs(spark, d):
    """The edges of all kinds: rules cause, prevent or indicate; facts are instances of predicates, which are parts of devices and require each other."""
    return base.typed_edges(spark, d).withColumn("weight", F.round("weight", 9))


@query(_TYPED + ", ends as (select src node, kind, mode, weight from typed union all select dst, kind, mode, weight from typed) select kind, mode, count(*) n, round(avg(weight), 9) mean_weight from typed group by 1, 2")
def gra_typed_stats(spark, d):
    return base.typed_edges(spark, d).groupBy("kind", "mode").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 9).alias("mean_weight"))


@query("with " + _ALG + f""", ch as (select x.kind k1, y.kind k2, z.kind k3, x.force f1, y.force f2, z.force f3 from kindf x, kindf y, kindf z),
j as (select ch.*, c1.result r1, c1.m m1, c1.p p1, c2.result r2, c2.m m2, c2.p p2 from ch left join comp c1 on c1.a = k1 and c1.b = k2 left join comp c2 on c2.a = c1.result and c2.b = k3)
select k1 || '>' || k2 || '>' || k3 kinds, r2 is not null valid, case when r1 is null then 0 when r2 is null then 1 end failed_at,
  case when r1 is null then case when (k1, k2) in (select a, b from no) then 'forbidden' else 'undefined' end when r2 is null then case when (r1, k3) in (select a, b from no) then 'forbidden' else 'undefined' end end reason,
  r2 result, case when r2 is not null then mode end as mode, case when r2 is not null then force end force, case when r2 is not null then policy end policy
from (select *, {_NAMES} from (select *, greatest(coalesce(m1, 0), coalesce(m2, 0)) m, greatest(f1, f2, f3) f, greatest(coalesce(p1, 0), coalesce(p2, 0)) p from j))""", False)
def alg_validate_rich(spark, d):
    """Every chain of three kinds: whether it is legal, where and why not, and the weakest mode, force and evidence policy of the legal ones."""
    kinds = [k for k, *_ in graph.KINDS]
    chains = spark.createDataFrame([([a, b, c],) for a in kinds for b in kinds for c in kinds], "kinds array<string>")
    return chains.withColumn("v", graph.validate_rich(F.col("kinds"))).select(F.array_join("kinds", ">").alias("kinds"), "v.valid", "v.failed_at", "v.reason", "v.result", "v.mode", "v.force", "v.policy")


_WALK = "," + _ALG + f""", walk(start, node, path, kinds, weight, cur, m, f, p) as (
  select node, node, [node], [cast(null as varchar)], cast(1.0 as double), cast(null as varchar), 0, 0, 0 from {_START}
  union all
  select w.start, t.dst, list_append(w.path, t.dst), list_append(w.kinds, t.kind), w.weight * t.weight, coalesce(c.result, t.kind), greatest(w.m, coalesce(c.m, 0)), greatest(w.f, k.force), greatest(w.p, coalesce(c.p, 0))
  from walk w join typed t on t.src = w.node join kindf k on k.kind = t.kind left join comp c on c.a = w.cur and c.b = t.kind where len(w.path) <= 3 and not list_contains(w.path, t.dst) and (w.cur is null or c.result is not null))
select start, array_to_string(path, ' > ') path, array_to_string(kinds[2:], '>') kinds, round(weight, 9) weight, cur result, {_NAMES} from walk where len(path) > 1"""


@query(_TYPED + _WALK)
def gra_legal_paths(spark, d):
    """All paths of at most three edges from the query set whose kinds compose, with what they amount to."""
    p = graph.validated(graph.simple_paths(materialize(base.typed_edges(spark, d), "typed-edges"), _starts(spark, d), 3, legal=True))
    return p.select("start", F.array_join("path", " > ").alias("path"), F.array_join("kinds", ">").alias("kinds"), F.round("weight", 9).alias("weight"), "v.result", "v.mode", "v.force", "v.policy")


def _level(n: int) -> str:
    """The SQL of one level of the exploration: all allowed steps from the frontier before, and the frontier after."""
    seen = " and ".join(f"not exists (select 1 from f{i} x where x.start = s.start and x.node = s.node)" for i in range(n))
    return f""", s{n} as (select f.start, t.dst node, list_append(f.path, t.dst) path, list_append(f.kinds, t.kind) kinds, f.weight * t.weight weight, case when t.mode = 'compiled' then 0 else 1 end soft from f{n - 1} f join typed t on t.src = f.node
  where not list_contains(f.path, t.dst) and (len(f.kinds) = 0 or exists (select 1 from comp c where c.a = f.kinds[-1] and c.b = t.kind))),
f{n} as (select start, node, path, kinds, weight from (select s.*, row_number() over (partition by start, node order by soft, -round(weight, 9), array_to_string(path, ' > '), array_to_string(kinds, '>')) rn from s{n} s where contains(node, '|') and {seen}) where rn = 1)"""


_EXPLORE = _TYPED + "," + _ALG + f", f0 as (select node start, node, [node] path, cast([] as varchar[]) kinds, cast(1.0 as double) weight from {_START})" + "".join(_level(n) for n in (1, 2, 3)) + """, found as (
  select start, array_to_string(path, ' > ') path, array_to_string(kinds, '>') kinds, round(weight, 9) weight from (select * from s1 union all select * from s2 union all select * from s3) where not contains(node, '|'))
select start, path, kinds, weight from (select *, row_number() over (partition by start order by weight desc, path, kinds) rn from found) where rn <= 10"""


@query(_EXPLORE)
def gra_explore(spark, d):
    """The ten best paths of at most three steps from the query set to predicates and devices, each step composing with the one before."""
    return graph.explore(base.typed_edges(spark, d), _starts(spark, d), ~F.col("node").contains("|"), 3, 10)


@query()
def gra_compile(spark, d):
    """The edges after the best path of each start has been compiled and the paths that do not compose have failed."""
    e = materialize(base.typed_edges(spark, d), "typed-edges")
    split = lambda t: t.select(F.split("path", " > ").alias("path"))
    best = graph.explore(e, _starts(spark, d), ~F.col("node").contains("|"), 3, 1)
    tried = graph.simple_paths(e, _starts(spark, d), 2).where(~graph.fold_kinds(F.col("kinds"))["valid"])
    return graph.compile_paths(e, split(best), tried.select("path"))


@query(_TYPED + """, n as (select src, dst, kind, evidence from typed where mode = 'tentative') select src, dst, kind, round(case when mode = 'tentative' then 0.5 else weight end, 9) weight, evidence + case when mode = 'tentative' then 1 else 0 end evidence, mode from typed""")
def gra_put_refs(spark, d):
    """Insert or update: the tentative edges come once more, with another weight."""
    e = materialize(base.typed_edges(spark, d), "typed-edges")
    new = e.where("mode = 'tentative'").select("src", "dst", "kind", F.lit(0.5).alias("weight"), F.lit(1).alias("seq"))
    return graph.put_edges(e, new).withColumn("weight", F.round("weight", 9))


@query(_TYPED + """, keep as (select * from typed where not (mode = 'tentative' and weight < 0.5)), node as (select src node from typed union select dst from typed), deg as (select node, count(*) n from (select src node from keep union all select dst from keep) group by 1)
select node, coalesce(n, 0) degree, n is null orphan from node left join deg using (node)""")
def gra_prune_degrees(spark, d):
    """The degree of each node once weak tentative edges are removed, and whether nothing holds it any more."""
    e = materialize(base.typed_edges(spark, d), "typed-edges")
    none = spark.createDataFrame([], "src string, dst string, via string")
    _, _, deg = graph.remove_edges(e, e.where("mode = 'tentative' and weight < 0.5"), none)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    n = F.col("n_out") + F.col("n_in")
    return nodes.join(deg, "node", "left").select("node", F.coalesce(n, F.lit(0)).alias("degree"), n.isNull().alias("orphan"))


_ENDS = "(select a.node start, b.node \"end\" from (select src node from edges group by 1 order by count(*) desc, src limit 3) a join (select dst node from edges group by 1 order by count(*) desc, dst limit 3) b on a.node <> b.node)"
_BETWEEN = f""", pr as materialized (select * from {_ENDS} x(start, fin)), e1 as materialized (select src, dst, max(weight) weight from edges group by 1, 2),
back(fin, node, n) as (select distinct fin, fin, 0 from pr union select b.fin, e.src, b.n + 1 from back b join e1 e on e.dst = b.node where b.n < 4), near as materialized (select fin, node, min(n) n from back group by 1, 2),
walk(start, fin, node, path, weight) as (select start, fin, start, [start], cast(1.0 as double) from pr union all select w.start, w.fin, e.dst, list_append(w.path, e.dst), w.weight * e.weight from walk w join e1 e on e.src = w.node join near r on r.fin = w.fin and r.node = e.dst and r.n <= 5 - len(w.path)
  where w.node <> w.fin and len(w.path) <= 5 and not list_contains(w.path, e.dst))
select start, fin "end", path, weight from (select *, row_number() over (partition by start, fin order by weight desc, path) rn from (select start, fin, array_to_string(path, ' > ') path, round(weight, 9) weight from walk where node = fin)) where rn <= 50"""


@query(_BETWEEN)
def gra_paths(spark, d):
    """The fifty heaviest simple paths of at most five edges between each of the three busiest sources and each of the three busiest targets."""
    e = materialize(base.edges(spark, d), "edges")
    busy = lambda c, n: [r[0] for r in e.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(n).collect()]  # three names
    pairs = spark.createDataFrame([(a, b) for a in busy("src", 3) for b in busy("dst", 3) if a != b], "start string, end string")
    return graph.paths_between(e, pairs)


_REACH_ALL = """, strong as materialized (select distinct src, dst from edges where mode = 'compiled' and weight >= 0.6 and evidence >= 3),
hop(start, node, n) as (select src, dst, 1 from strong where src <> dst union select h.start, s.dst, h.n + 1 from hop h join strong s on s.src = h.node where h.n < 25 and h.start <> s.dst),
near as (select start, node, min(n) n from hop group by 1, 2), two as (select distinct a.src start, b.dst node from strong a join strong b on a.dst = b.src where a.src <> b.dst and a.src <> a.dst and b.src <> b.dst)
select start src, node dst, cast(case when near.n > 1 then near.n else 2 end as bigint) hops from near left join two using (start, node) where near.n > 1 or two.node is not null"""


@query(_REACH_ALL)
def gra_shortcut_hops(spark, d):
    """The length of each shortcut."""
    return graph.shortcuts(base.edges(spark, d), named=False)


@query()
def gra_shortcuts(spark, d):
    """A shortcut for each pair joined by strong compiled edges over two hops or more, by its shortest chain of any length."""
    return graph.shortcuts(base.edges(spark, d))


@query()
def gra_invalidate_shortcuts(spark, d):
    """The shortcuts that still hold once the edges below 0.8 have changed their weight."""
    e = materialize(base.edges(spark, d), "edges")
    return graph.shortcuts(e, touched=e.where("weight < 0.8").select("src", "dst")).select("src", "dst", "via")


# -- templates and classes, given as tables

_SLOTS = [("diagnosis", "symptom", ["fact"], True, None, 1), ("diagnosis", "origin", ["fact"], True, 2, None), ("diagnosis", "class", ["predicate"], True, None, None), ("dependency", "part", ["predicate"], True, None, None), ("dependency", "whole", ["predicate"], True, None, None), ("dependency", "device", ["device"], False, None, None), ("chain", "first", ["fact"], True, None, None), ("chain", "middle", ["fact"], True, None, None), ("chain", "last", ["fact"], True, None, None)]
_ARROWS = [("diagnosis", 1, "origin", "symptom", "causes"), ("diagnosis", 2, "symptom", "class", "is_a"), ("dependency", 1, "whole", "part", "requires"), ("dependency", 2, "part", "device", "part_of"), ("chain", 1, "first", "middle", "causes"), ("chain", 2, "middle", "last", "causes")]
_INVARIANTS = [("diagnosis", "slot:origin != slot:symptom", True), ("diagnosis", "ref:origin->class:is_a", False), ("dependency", "slot:device exists", True), ("chain", "ref:first->last:causes", True), ("chain", "free text", True)]

_DEG = ", deg as (select node, cast(sum(o) as bigint) n_out, cast(sum(i) as bigint) n_in from (select src node, 1 o, 0 i from typed union all select dst, 0, 1 from typed) group by 1)"
_MATCH = _TYPED + _DEG + """, m as (
  select 'chain' "template", 'first=' || a.src || ', last=' || b.dst || ', middle=' || a.dst bindings, 3 filled, 2 arrows_met, 1.0 score from typed a join typed b on a.dst = b.src and a.src <> b.dst and a.src <> a.dst and b.src <> b.dst where a.kind = 'causes' and b.kind = 'causes'
  union all select 'dependency', 'device=' || b.dst || ', part=' || a.dst || ', whole=' || a.src, 2, 2, 1.0 from typed a join typed b on b.src = a.dst where a.kind = 'requires' and b.kind = 'part_of'
  union all select 'diagnosis', 'class=' || b.dst || ', origin=' || a.src || ', symptom=' || a.dst, 3, 2, 1.0 from typed a join typed b on b.src = a.dst join deg o on o.node = a.src join deg s on s.node = a.dst where a.kind = 'causes' and b.kind = 'is_a' and o.n_out >= 2 and s.n_in >= 1)
select "template", bindings, filled, arrows_met, score, rank from (select *, row_number() over (partition by "template" order by score desc, bindings) rank from (select distinct * from m)) where rank <= 20"""


def _template_tables(spark):
    slots = spark.createDataFrame(_SLOTS, "template string, role string, node_kinds array<string>, required boolean, min_out int, min_in int")
    return slots, spark.createDataFrame(_ARROWS, "template string, seq int, from_role string, to_role string, kind string"), spark.createDataFrame(_INVARIANTS, "template string, rule string, hard boolean")


def _matched(spark, d):
    e = materialize(base.typed_edges(spark, d), "typed-edges")
    kind = F.when(F.col("node").contains("|"), "fact").when(F.col("node").contains("."), "predicate").otherwise("device")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", kind.alias("node_kind"))
    slots, arrows, _ = _template_tables(spark)
    return e, templates.matches(nodes, graph.degrees(e), e, slots, arrows)


@query(_MATCH)
def pat_match_templates(spark, d):
    """The twenty best matches of each template."""
    return _matched(spark, d)[1]


_SLOTS_OF = "map_from_entries(list_transform(string_split(bindings, ', '), lambda b: {'k': split_part(b, '=', 1), 'v': substr(b, instr(b, '=') + 1)}))"


@query(_MATCH.replace('select "template", bindings, filled', ', mt as (select "template", bindings, filled', 1) + f"""), inst as (select "template" || '#' || rank instance, "template", {_SLOTS_OF} s from mt)
select instance, "template", 'ref:origin->class:is_a' rule, false hard from inst i where "template" = 'diagnosis' and not exists (select 1 from typed t where t.src = i.s['origin'] and t.dst = i.s['class'] and t.kind = 'is_a')
union all select instance, "template", 'ref:first->last:causes', true from inst i where "template" = 'chain' and not exists (select 1 from typed t where t.src = i.s['first'] and t.dst = i.s['last'] and t.kind = 'causes')""")
def pat_broken_invariants(spark, d):
    """The invariants that the matches of the templates break."""
    e, found = _matched(spark, d)
    part = F.split("bindings", ", ")
    slots = F.map_from_entries(F.transform(part, lambda b: F.struct(F.regexp_extract(b, "^([^=]*)=", 1).alias("k"), F.regexp_replace(b, "^[^=]*=", "").alias("v"))))
    return templates.broken(found.select(F.concat_ws("#", "template", F.col("rank").cast("string")).alias("instance"), "template", slots.alias("slots")), _template_tables(spark)[2], e)


_CLASSES = [("thermal", "kiln"), ("thermal", "furnace slow"), ("thermal", "temp above step"), ("pace", "slow after step"), ("pace", "lagging"), ("noise", "noisy"), ("noise", "异常"), ("silence", "silent"), ("silence", "went silent after"), ("empty", "")]
_CV = "(values " + ", ".join(f"('{c}', '{s}')" for c, s in _CLASSES if s) + ") v(class, sig)"


@query(f"""with s as (select *, list_distinct(list_filter(string_split(lower(regexp_replace(sig, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: len(w) > 2)) t from {_CV}), x as (select distinct id, lower(raw_input) low, list_filter(string_split(lower(regexp_replace(raw_input, '[^A-Za-z0-9_]+', ' ', 'g')), ' '), lambda w: len(w) > 2) w from stories where raw_input is not null and id is not null),
h as (select id, class, contains(low, sig) ex, len(t) > 0 and 2 * len(list_intersect(t, w)) >= len(t) nr from x, s)
select id, class, round(least(1.0, (2 * count(*) filter (ex) + count(*) filter (not ex)) / (2 * any_value(n.n))), 9) confidence, count(*) filter (ex) exact, count(*) filter (not ex) fuzzy from h join (select class, count(*) n from s group by 1) n using (class) where ex or nr group by 1, 2""", False)
def pat_classify(spark, d):
    """The problem classes of the stories, by a table of signatures."""
    s = load(spark, d, "stories").where("id is not null").select("id", "raw_input").distinct()
    return templates.classify(s, "id", "raw_input", spark.createDataFrame(_CLASSES, "class string, signature string"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(O)
