"""The typed knowledge graph: neighbours, paths, reachability, legality of compositions, shortcuts, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.operators import walks
from causeway.session import materialize, materialize_counted

# Kinds of edges with family, transitivity and default force.
KINDS = [
    ("is_a", "structural", "true", "necessary"),
    ("part_of", "structural", "true", "necessary"),
    ("causes", "explanatory", "true", "contributory"),
    ("requires", "explanatory", "true", "necessary"),
    ("indicates", "evidential", "candidate", "analogical"),
    ("cooccurs", "evidential", "candidate", "analogical"),
    ("similar_to", "evidential", "candidate", "analogical"),
    ("fixes", "interventional", "false", "contributory"),
    ("prevents", "interventional", "false", "contributory"),
]

# What two edges in a row amount to: first, second, result, mode, evidence policy.
ALLOWED = [
    ("causes", "causes", "causes", "direct", "inherit"),
    ("requires", "causes", "requires", "direct", "inherit"),
    ("requires", "requires", "requires", "direct", "inherit"),
    ("fixes", "causes", "fixes", "direct", "inherit"),
    ("prevents", "causes", "prevents", "direct", "inherit"),
    ("is_a", "causes", "causes", "inherit", "revalidate"),
    ("is_a", "fixes", "fixes", "inherit", "revalidate"),
    ("is_a", "requires", "requires", "inherit", "revalidate"),
    ("is_a", "prevents", "prevents", "inherit", "revalidate"),
    ("is_a", "is_a", "is_a", "direct", "inherit"),
    ("part_of", "part_of", "part_of", "direct", "inherit"),
    ("indicates", "indicates", "indicates", "weak", "discard"),
    ("cooccurs", "cooccurs", "cooccurs", "weak", "discard"),
    ("similar_to", "similar_to", "similar_to", "weak", "discard"),
    ("similar_to", "fixes", "fixes", "candidate", "revalidate"),
    ("similar_to", "causes", "causes", "candidate", "revalidate"),
]

# Pairs that are forbidden by name; all pairs in neither list are forbidden too.
FORBIDDEN = [("indicates", "causes"), ("cooccurs", "causes"), ("indicates", "fixes"), ("cooccurs", "fixes"), ("part_of", "causes"), ("indicates", "prevents"), ("cooccurs", "prevents")]

# Modes, forces and evidence policies from strong to weak.
MODES = ["direct", "inherit", "candidate", "weak"]
FORCES = ["necessary", "sufficient", "contributory", "analogical"]
POLICIES = ["inherit", "revalidate", "discard"]


def compose_table(spark: SparkSession) -> DataFrame:
    """(first, second, allowed, result, mode, evidence): the rules of composition, a table of fixed size."""
    rows = [(a, b, True, r, m, e) for a, b, r, m, e in ALLOWED] + [(a, b, False, None, None, None) for a, b in FORBIDDEN]
    return spark.createDataFrame(rows, "first string, second string, allowed boolean, result string, mode string, evidence string")


def kind_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KINDS, "kind string, family string, transitive string, force string")


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def fold_kinds(kinds: Column) -> Column:
    """struct(valid, result, mode) of a sequence of kinds composed from the left.

    mode is the weakest met. An empty or null sequence is not valid; a single
    kind is itself, direct.
    """
    result = _literal_map({f"{a}>{b}": r for a, b, r, _, _ in ALLOWED})
    mode = _literal_map({f"{a}>{b}": str(MODES.index(m)) for a, b, _, m, _ in ALLOWED})
    start = F.struct(F.element_at(kinds, 1).alias("k"), F.lit("0").alias("m"))

    def step(acc: Column, nxt: Column) -> Column:
        key = F.concat_ws(">", acc["k"], nxt)
        return F.struct(F.when(acc["k"].isNotNull(), result[key]).alias("k"), F.greatest(acc["m"], F.coalesce(mode[key], F.lit("0"))).alias("m"))

    out = F.aggregate(F.slice(kinds, 2, F.greatest(F.size(kinds) - 1, F.lit(0))), start, step)
    ok = (F.size(kinds) > 0) & out["k"].isNotNull()
    names = F.array(*[F.lit(m) for m in MODES])
    return F.when(ok, F.struct(F.lit(True).alias("valid"), out["k"].alias("result"), F.element_at(names, out["m"].cast("int") + 1).alias("mode"))).otherwise(
        F.struct(F.lit(False).alias("valid"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("mode"))
    )


def validate_rich(kinds: Column) -> Column:
    """struct(valid, failed_at, reason, result, mode, force, policy, proof) of a sequence of kinds composed from the left.

    mode, force and policy are the weakest met, proof the kinds with their
    forces up to where the fold came. failed_at: the place of the first
    composition that is not allowed, counted from 0; reason: forbidden by name,
    undefined, or empty path.
    """
    result = _literal_map({f"{a}>{b}": r for a, b, r, _, _ in ALLOWED})
    mode = _literal_map({f"{a}>{b}": str(MODES.index(m)) for a, b, _, m, _ in ALLOWED})
    policy = _literal_map({f"{a}>{b}": str(POLICIES.index(e)) for a, b, _, _, e in ALLOWED})
    force = _literal_map({k: str(FORCES.index(f)) for k, _, _, f in KINDS})
    forbidden = F.array(*[F.lit(f"{a}>{b}") for a, b in FORBIDDEN])
    of = lambda k: F.coalesce(force[k], F.lit("2"))
    first = F.element_at(kinds, 1)
    start = F.struct(first.alias("k"), F.lit("0").alias("m"), of(first).alias("f"), F.lit("0").alias("p"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("why"), F.lit(0).alias("i"))

    def step(acc: Column, nxt: Column) -> Column:
        key = F.concat_ws(">", acc["k"], nxt)
        going = acc["at"].isNull()
        ok = going & result[key].isNotNull()
        why = F.when(going & ~ok, F.when(F.array_contains(forbidden, key), "forbidden").otherwise("undefined")).otherwise(acc["why"])
        return F.struct(
            F.when(ok, result[key]).otherwise(acc["k"]).alias("k"), F.when(ok, F.greatest(acc["m"], mode[key])).otherwise(acc["m"]).alias("m"), F.when(ok, F.greatest(acc["f"], of(nxt))).otherwise(acc["f"]).alias("f"),
            F.when(ok, F.greatest(acc["p"], policy[key])).otherwise(acc["p"]).alias("p"), F.when(going & ~ok, acc["i"]).otherwise(acc["at"]).alias("at"), why.alias("why"), (acc["i"] + 1).alias("i"),
        )

    out = F.aggregate(F.slice(kinds, 2, F.greatest(F.size(kinds) - 1, F.lit(0))), start, step)
    some = F.coalesce(F.size(kinds) > 0, F.lit(False))
    valid = some & out["at"].isNull()
    names = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), i.cast("int") + 1)
    used = F.when(some, F.slice(kinds, 1, F.coalesce(out["at"] + 1, F.size(kinds)))).otherwise(F.array().cast("array<string>"))
    proof = F.transform(used, lambda k: F.concat_ws(":", k, names(FORCES, of(k))))
    when = lambda c: F.when(valid, c)
    return F.struct(
        valid.alias("valid"), F.when(some, out["at"]).alias("failed_at"), F.when(~some, "empty path").otherwise(out["why"]).alias("reason"), when(out["k"]).alias("result"), when(names(MODES, out["m"])).alias("mode"),
        when(names(FORCES, out["f"])).alias("force"), when(names(POLICIES, out["p"])).alias("policy"), proof.alias("proof"),
    )


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, kind, weight, direction) of the edges at each of nodes (column node)."""
    out = edges.join(nodes, edges.src == nodes.node).select("node", F.col("dst").alias("other"), "kind", "weight", F.lit("outgoing").alias("direction"))
    into = edges.join(nodes, edges.dst == nodes.node).select("node", F.col("src").alias("other"), "kind", "weight", F.lit("incoming").alias("direction"))
    return out.unionByName(into)


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, distance): what can be reached from each start (column start) in at most depth steps, at its least distance.

    Level by level: a frontier is joined with the edges and stripped of what
    was reached before, so cycles end by themselves and each pair is expanded once.
    """
    front = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("distance")).distinct()
    seen = front
    e = edges.select(F.col("src").alias("node"), "dst").distinct()
    for i in range(1, depth + 1):
        front = front.join(e, "node").select("start", F.col("dst").alias("node"), F.lit(i).alias("distance")).distinct().join(seen, ["start", "node"], "left_anti")
        front = materialize(front, "frontier")
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int, legal: bool = False) -> DataFrame:
    """(start, node, path, kinds, weight): all paths without repeated nodes of at most depth edges.

    weight is the product of the edges'. legal: only paths whose kinds compose
    (fold_kinds), checked at each step, by what the kinds so far amount to, so
    that illegal ones are not carried on.
    """
    rules = F.broadcast(compose_table(edges.sparkSession).where("allowed").select(F.col("first").alias("cur"), F.col("second").alias("kind"), "result"))  # a table of fixed size
    e = edges.select(F.col("src").alias("node"), "dst", "kind", F.col("weight").alias("w"))
    front = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.array().cast("array<string>").alias("kinds"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("cur"))
    out = None
    for i in range(depth):
        step = front.join(e, "node").where(~F.array_contains("path", F.col("dst")))
        if legal:
            step = step.join(rules, ["cur", "kind"]).withColumn("cur", F.col("result")) if i else step.where("kind is not null").withColumn("cur", F.col("kind"))
        front = materialize(step.select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("kinds", F.array("kind")).alias("kinds"), (F.col("weight") * F.col("w")).alias("weight"), "cur"), "paths")
        out = front.drop("cur") if out is None else out.unionByName(front.drop("cur"))
    return out


def validated(paths: DataFrame) -> DataFrame:
    """paths with v, validate_rich() of the column kinds, which is worked out once for each sequence of kinds."""
    of = materialize(paths.select("kinds").distinct(), "kinds").withColumn("v", validate_rich(F.col("kinds")))
    return paths.join(of.withColumnRenamed("kinds", "__kinds"), F.col("kinds").eqNullSafe(F.col("__kinds")), "left").drop("__kinds")


def paths_between(edges: DataFrame, pairs: DataFrame, depth: int = 5, most: int = 50) -> DataFrame:
    """(start, end, path, weight): the `most` heaviest simple paths of at most depth edges between each pair (columns start, end).

    Up to walks.MAX_EDGES edges the paths are taken heaviest first by a worker
    that holds the graph, so only those are made that can be among the `most`.
    Beyond, all are made by joins: first the ends are searched backwards, so
    that the walk from the starts only enters nodes from which its end can
    still be reached in the steps that are left. A path stops at its end.
    """
    e, counts = materialize_counted(edges.groupBy("src", "dst").agg(F.max("weight").alias("w")), "heaviest-edges", n=F.count("*"))
    pairs = pairs.select("start", "end").where("start <> end").distinct()
    if 0 < counts["n"] <= walks.MAX_EDGES:
        return walks.heaviest_paths(walks.hold(e), pairs, depth, most).withColumn("weight", F.round("weight", 9))
    e = e.withColumnRenamed("src", "node")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = reachable(back, pairs.select(F.col("end").alias("start")).distinct(), depth - 1)
    near = materialize(near.select(F.col("start").alias("end"), F.col("node").alias("dst"), "distance").unionByName(pairs.select("end", F.col("end").alias("dst"), F.lit(0).alias("distance")).distinct()), "distances")
    front = pairs.select("start", "end", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(1.0).alias("weight"))
    out = None
    for i in range(1, depth + 1):
        front = front.join(e, "node").where(~F.array_contains("path", F.col("dst"))).join(near.where(F.col("distance") <= depth - i).drop("distance"), ["end", "dst"])
        front = materialize(front.select("start", "end", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("weight") * F.col("w")).alias("weight")), "paths")
        found = front.where(F.col("node") == F.col("end")).select("start", "end", "path", "weight")
        out = found if out is None else out.unionByName(found)
        front = front.where(F.col("node") != F.col("end"))
    out = out.select("start", "end", F.array_join("path", " > ").alias("path"), F.round("weight", 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("start", "end").orderBy(F.desc("weight"), "path"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def shortcuts(edges: DataFrame, least: float = 0.6, evidence: int = 3, touched: DataFrame | None = None, named: bool = True) -> DataFrame:
    """(src, dst, via, hops, weight), or (src, dst, hops) unless named: for each pair joined by compiled edges with enough weight and evidence, its shortest chain of two hops or more, first by name.

    Chains have any length. With touched (src, dst), those over one of its
    hops are left out, as by valid_shortcuts. Up to walks.MAX_EDGES edges each
    start is walked from by a worker that holds the graph; beyond, and where
    names would order otherwise than paths, by joins.
    """
    strong = edges.where((F.col("mode") == "compiled") & (F.col("weight") >= least) & (F.col("evidence") >= evidence) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.max("weight").alias("w"))
    if touched is not None:
        strong = strong.join(touched.select("src", "dst").distinct().withColumn("bad", F.lit(True)), ["src", "dst"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    strong, counts = materialize_counted(strong, "strong-edges", n=F.count("*"))
    if 0 < counts["n"] <= walks.MAX_EDGES and (held := walks.hold(strong)).plain:
        out = walks.chains(held, edges.sparkSession, named)
        return out.withColumn("weight", F.round("weight", 9)) if named else out
    out = _joined_shortcuts(strong)
    out = out if touched is None else valid_shortcuts(out, touched)
    return out if named else out.select("src", "dst", "hops")


def _joined_shortcuts(strong: DataFrame) -> DataFrame:
    """shortcuts() of strong (src, dst, w): each pair is entered once, at its least distance, and from there goes on, until a level finds no new pair."""
    e = strong.select(F.col("src").alias("node"), F.col("dst").alias("next"), "w")
    front = strong.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.concat_ws(" > ", "src", "dst").alias("via"), F.col("w").alias("weight"), F.lit(1).cast("long").alias("hops"))
    direct, seen, out, n = front, front.select("start", "node"), None, 1
    while n:
        step = front.join(e, "node").where("start <> next").select("start", F.col("next").alias("node"), F.concat_ws(" > ", "via", "next").alias("via"), (F.col("weight") * F.col("w")).alias("weight"), (F.col("hops") + 1).alias("hops"))
        best = step.groupBy("start", "node").agg(F.min(F.struct("via", "weight", "hops")).alias("b")).join(seen, ["start", "node"], "left_anti")
        front, counts = materialize_counted(best.select("start", "node", "b.via", "b.weight", "b.hops"), "shortcuts", n=F.count("*"))
        n, seen = counts["n"], seen.unionByName(front.select("start", "node"))
        out = front if out is None else out.unionByName(front)
    # a pair with an edge of its own is reached in one hop; its shortest longer chain is one more hop from a neighbour
    longer = direct.select("start", "node").join(_second(e, direct), ["start", "node"])
    every = out.select("start", "node", "via", "weight", "hops").unionByName(longer.select("start", "node", "via", "weight", "hops"))
    return every.select(F.col("start").alias("src"), F.col("node").alias("dst"), "via", "hops", F.round("weight", 9).alias("weight"))


def _second(e: DataFrame, direct: DataFrame) -> DataFrame:
    """The first chain of two hops of each pair."""
    two = direct.join(e, "node").where("start <> next").select("start", F.col("next").alias("node"), F.concat_ws(" > ", "via", "next").alias("via"), (F.col("weight") * F.col("w")).alias("weight"), F.lit(2).cast("long").alias("hops"))
    return two.groupBy("start", "node").agg(F.min(F.struct("via", "weight", "hops")).alias("b")).select("start", "node", "b.via", "b.weight", "b.hops")


def explore(edges: DataFrame, starts: DataFrame, targets: Column, depth: int = 3, most: int = 10) -> DataFrame:
    """(start, path, kinds, weight): the `most` heaviest paths from each start to a node of the target kinds.

    edges: src, dst, kind, weight, mode. targets: a condition on the column
    node. A step is allowed if its kind composes with the kind before it. A
    node that is no target is gone through once per start, by the first path
    that meets it: fewest steps, then compiled edges before tentative ones,
    heavier, first by name.
    """
    rules = compose_table(edges.sparkSession).where("allowed").select(F.col("first").alias("last"), F.col("second").alias("kind"))
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), "kind", F.col("weight").alias("w"), (F.col("mode") != "compiled").cast("int").alias("soft"))
    front = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.array().cast("array<string>").alias("kinds"), F.lit(1.0).alias("weight")).distinct()
    gone, out = front.select("start", "node"), None
    for _ in range(depth):
        step = front.join(e, "node").where(~F.array_contains("path", F.col("next"))).withColumn("last", F.try_element_at("kinds", F.lit(-1)))
        step = step.where("last is null").drop("last").unionByName(step.join(F.broadcast(rules), ["last", "kind"], "leftsemi").drop("last"))  # a table of fixed size
        step = materialize(step.select("start", F.col("next").alias("node"), F.array_append("path", F.col("next")).alias("path"), F.array_append("kinds", F.col("kind")).alias("kinds"), (F.col("weight") * F.col("w")).alias("weight"), "soft"), "explored")
        found = step.where(targets).drop("soft", "node")
        out = found if out is None else out.unionByName(found)
        first = step.where(~targets).groupBy("start", "node").agg(F.min(F.struct("soft", (-F.round("weight", 9)).alias("neg"), F.array_join("path", " > ").alias("p"), F.array_join("kinds", ">").alias("k"), "path", "kinds", "weight")).alias("b"))
        front = materialize(first.join(gone, ["start", "node"], "left_anti").select("start", "node", "b.path", "b.kinds", "b.weight"), "frontier")
        gone = gone.unionByName(front.select("start", "node"))
    out = out.select("start", F.array_join("path", " > ").alias("path"), F.array_join("kinds", ">").alias("kinds"), F.round("weight", 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("weight"), "path", "kinds"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


# How far a compilation moves weights, and below which a tentative edge goes.
STRENGTHEN, WEAKEN, LEAST_WEIGHT = 0.1, 0.05, 0.1


def compile_paths(edges: DataFrame, correct: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The edges (src, dst, kind, weight, evidence, mode) after the paths (column path, an array of nodes) have been compiled.

    Each hop of a correct path takes the heaviest edge of its pair, ties by
    kind; a path with a hop without an edge, or whose kinds do not compose,
    changes nothing. The edges of the others gain STRENGTHEN up to 1 and one
    evidence per path, and become compiled. The tentative edges on hops of
    failed paths lose WEAKEN per path; if there are failed paths, tentative
    edges below LEAST_WEIGHT are removed.
    """

    def hops(paths: DataFrame) -> DataFrame:
        pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(i.alias("i"), F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
        return paths.where(F.size("path") > 1).select("path", F.explode(pairs).alias("h")).select("path", "h.*")

    best = edges.groupBy("src", "dst").agg(F.min(F.struct((-F.col("weight")).alias("neg"), "kind")).alias("b")).select("src", "dst", F.col("b.kind").alias("kind"))
    paths = correct.select("path").distinct()
    steps = hops(paths).join(best, ["src", "dst"], "left")
    legal = steps.groupBy("path").agg(F.count("kind").alias("k"), F.transform(F.array_sort(F.collect_list(F.struct("i", "kind"))), lambda x: x["kind"]).alias("kinds"))
    legal = legal.where((F.col("k") == F.size("path") - 1) & fold_kinds(F.col("kinds"))["valid"])
    gains = steps.join(legal.select("path"), "path", "leftsemi").groupBy("src", "dst", "kind").agg(F.count("*").alias("gain"))
    out = edges.join(gains, ["src", "dst", "kind"], "left")
    if failed is not None:
        losses = hops(failed.select("path").distinct()).groupBy("src", "dst").agg(F.count("*").alias("loss"))
        out = out.join(losses, ["src", "dst"], "left")
    else:
        out = out.withColumn("loss", F.lit(None).cast("long"))
    compiled = F.col("gain").isNotNull()
    raised = F.least(F.lit(1.0), F.col("weight") + STRENGTHEN * F.col("gain"))
    lowered = F.greatest(F.lit(0.0), F.col("weight") - WEAKEN * F.coalesce("loss", F.lit(0)))
    mode = F.when(compiled, "compiled").otherwise(F.col("mode"))
    weight = F.when(compiled, raised).when(F.col("mode") == "tentative", lowered).otherwise(F.col("weight"))
    out = out.select("src", "dst", "kind", F.round(weight, 9).alias("weight"), (F.col("evidence") + F.coalesce("gain", F.lit(0))).alias("evidence"), mode.alias("mode"))
    return out if failed is None else out.where((F.col("mode") != "tentative") | (F.col("weight") >= LEAST_WEIGHT))


def put_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the rows of new (src, dst, kind, weight, seq) put in: a new edge is tentative without evidence, one that is there takes the weight of the greatest seq and an evidence per row."""
    n = new.groupBy("src", "dst", "kind").agg(F.max_by("weight", "seq").alias("__w"), F.count("*").alias("__n"))
    both = edges.join(n, ["src", "dst", "kind"], "full")
    known = F.col("mode").isNotNull()
    return both.select("src", "dst", "kind", F.coalesce("__w", "weight").alias("weight"), F.when(known, F.col("evidence") + F.coalesce("__n", F.lit(0))).otherwise(F.col("__n") - 1).alias("evidence"), F.coalesce("mode", F.lit("tentative")).alias("mode"))


def patch_edges(edges: DataFrame, changes: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, shortcuts): edges with the non-null kind2, weight2, mode2 that changes give for (src, dst, kind), and the shortcuts over none of whose hops an edge's kind or weight changed."""
    out = edges.join(changes.select("src", "dst", "kind", *[F.col(f"{c}2") for c in ("kind", "weight", "mode")]), ["src", "dst", "kind"], "left")
    moved = changes.where("kind2 is not null or weight2 is not null").select("src", "dst").distinct()
    patched = out.select("src", "dst", F.coalesce("kind2", "kind").alias("kind"), F.coalesce("weight2", "weight").alias("weight"), "evidence", F.coalesce("mode2", "mode").alias("mode"))
    return patched, valid_shortcuts(short, moved)


def valid_shortcuts(short: DataFrame, touched: DataFrame) -> DataFrame:
    """The shortcuts (src, dst, via, ..) none of whose hops is among touched (src, dst)."""
    nodes = F.split("via", " > ")
    hop = F.explode(F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda i: F.struct(F.element_at(nodes, i).alias("src"), F.element_at(nodes, i + 1).alias("dst"))))
    hops = short.select(F.col("src").alias("a"), F.col("dst").alias("b"), hop.alias("h"))
    hit = hops.select("a", "b", "h.src", "h.dst").join(touched, ["src", "dst"], "leftsemi").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return short.join(hit, ["src", "dst"], "left_anti")


def remove_edges(edges: DataFrame, gone: DataFrame, short: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, shortcuts, degrees) without the edges of gone (src, dst, kind) and what rests on them."""
    left = edges.join(gone, ["src", "dst", "kind"], "left_anti")
    return left, valid_shortcuts(short, gone.select("src", "dst").distinct()), degrees(left)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in)."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in"))


def shape_counts(edges: DataFrame, kind_of: Column, least: int = 2) -> DataFrame:
    """(shape, n): how often each pattern of end kinds and edge kind occurs, from `least` on."""
    return edges.groupBy(kind_of.alias("shape")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
