"""Patterns in the graph given as tables: slots, arrows and invariants; problem classes given by their signatures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import text_features as tx
from causeway.session import materialize

# What the filled slots, the arrows and the fingerprints of a match are worth.
SLOT_SHARE, ARROW_SHARE, MARK_SHARE = 0.55, 0.35, 0.1
PLAIN_SLOT_SHARE, PLAIN_ARROW_SHARE = 0.6, 0.4

#: Slots a template may have; each is a column of the match.
MAX_SLOTS = 32
#: Signatures of problem classes: a table that people write.
MAX_SIGNATURES = 5_000


def candidates(nodes: DataFrame, degrees: DataFrame, slots: DataFrame) -> DataFrame:
    """(template, role, node): the nodes that may fill each slot.

    nodes: node, node_kind. degrees: node, n_out, n_in. slots: template, role,
    node_kinds (array), required, min_out, min_in (null: any). The slots are a
    small table, joined by its size on the kind.
    """
    s = slots.select("template", "role", F.explode("node_kinds").alias("node_kind"), "min_out", "min_in").distinct()
    n = nodes.join(s, "node_kind").join(degrees, "node", "left")
    enough = (F.coalesce("n_out", F.lit(0)) >= F.coalesce("min_out", F.lit(0))) & (F.coalesce("n_in", F.lit(0)) >= F.coalesce("min_in", F.lit(0)))
    return n.where(enough).select("template", "role", "node").distinct()


def matches(nodes: DataFrame, degrees: DataFrame, edges: DataFrame, slots: DataFrame, arrows: DataFrame, most: int = 20) -> DataFrame:
    """(template, bindings, filled, arrows_met, score, rank): the best assignments of distinct nodes to the slots of each template.

    arrows: template, seq, from_role, to_role, kind. The arrows are joined one
    by one, in the order of seq, each with the edges of its kind and the nodes
    that may fill its ends; an arrow that no assignment so far can meet is left
    out and costs its share, so the best are those that meet most. Slots of no
    arrow that was met are filled with the first candidate by name that is not
    used, optional ones stay empty. score: 0.55 of the required slots that are
    filled, 0.35 of the arrows met, 0.1 for fingerprints where slots have some;
    0.6 and 0.4 where none has.
    """
    spark = nodes.sparkSession
    cand = materialize(candidates(nodes, degrees, slots), "slot-candidates")
    edges = edges.select("src", "dst", "kind").distinct()
    every = None
    names = slots.select("template").distinct().orderBy("template").collect()  # the templates are a small table
    for (template,) in ((r["template"],) for r in names):
        own = slots.where(F.col("template") == template).orderBy("role").collect()
        lines = arrows.where(F.col("template") == template).orderBy("seq").collect()
        if len(own) > MAX_SLOTS:
            raise ValueError(f"a template has at most {MAX_SLOTS} slots")
        roles = [r["role"] for r in own]
        here = cand.where(F.col("template") == template)
        bound: DataFrame | None = None
        have: list[str] = []
        met = 0
        for a in lines:
            x, y = a["from_role"], a["to_role"]
            if x == y:  # no node has an arrow to itself
                continue
            e = edges.where((F.col("kind") == a["kind"]) & (F.col("src") != F.col("dst")))
            e = e.join(here.where(F.col("role") == x).select(F.col("node").alias("src")), "src", "leftsemi").join(here.where(F.col("role") == y).select(F.col("node").alias("dst")), "dst", "leftsemi").select(F.col("src").alias(x), F.col("dst").alias(y))
            if bound is None:
                step = e
            else:
                on = [c for c in (x, y) if c in have]
                if on:
                    step = bound.join(e, on)
                else:  # an arrow apart from all others would pair everything: it is met by its first edge
                    first = e.orderBy(x, y).first()
                    step = bound.withColumns({x: F.lit(first[0]), y: F.lit(first[1])}) if first else e.withColumns({c: F.lit(None).cast("string") for c in have})
                for new in {x, y} - set(have):
                    for old in have:
                        step = step.where(F.col(new) != F.col(old))
            step = materialize(step, "bindings")
            if step.limit(1).count():
                bound, met = step, met + 1
                have = [*have, *[c for c in (x, y) if c not in have]]
        out = bound if bound is not None else spark.range(1).select()
        for r in own:
            if r["role"] in have or not r["required"]:
                continue
            # few candidates are looked at: as many as there are slots, one of which is free
            free = [x["node"] for x in here.where(F.col("role") == r["role"]).orderBy("node").limit(MAX_SLOTS).collect()]
            used = F.array(*[F.col(c) for c in have]) if have else F.array().cast("array<string>")
            out = out.withColumn(r["role"], F.get(F.array_except(F.array(*[F.lit(x) for x in free]).cast("array<string>"), used), F.lit(0)))
            have.append(r["role"])
        required = [r["role"] for r in own if r["required"]]
        filled = sum((F.col(c).isNotNull().cast("int") for c in required if c in have), F.lit(0))
        share = filled / len(required) if required else F.lit(1.0)
        marked = any(r["min_out"] is not None or r["min_in"] is not None for r in own)
        ratio = met / len(lines) if lines else 1.0
        score = share * SLOT_SHARE + ratio * ARROW_SHARE + MARK_SHARE if marked else share * PLAIN_SLOT_SHARE + ratio * PLAIN_ARROW_SHARE
        binding = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c))) for c in roles if c in have])), ", ")
        rows = out.select(F.lit(template).alias("template"), binding.alias("bindings"), filled.alias("filled"), F.lit(met).alias("arrows_met"), F.round(score, 9).alias("score")).where("filled > 0 or arrows_met > 0")
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        return spark.createDataFrame([], "template string, bindings string, filled int, arrows_met int, score double, rank long")
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("score"), "bindings"))
    return every.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


_RULES = (
    (re.compile(r"\s*slot:(\w+)\s*!=\s*slot:(\w+)\s*"), "differs"),
    (re.compile(r"\s*slot:(\w+)\s+exists\s*"), "exists"),
    (re.compile(r"\s*ref:(\w+)\s*->\s*(\w+):(\w+)\s*"), "edge"),
)


def broken(bindings: DataFrame, invariants: DataFrame, edges: DataFrame) -> DataFrame:
    """(instance, template, rule, hard): the invariants that an instance breaks; one without hard ones can be compiled.

    bindings: instance, template, slots (map of role to node). invariants:
    template, rule, hard; rule is `slot:A != slot:B`, `slot:A exists` or
    `ref:A->B:kind`; any other rule holds. An empty slot equals no other, and
    makes the rules about its edges broken.
    """
    rules = []
    for r in invariants.distinct().collect():  # a small table
        for pattern, what in _RULES:
            if m := pattern.fullmatch(r["rule"]):
                rules.append((r["template"], r["rule"], bool(r["hard"]), what, *(list(m.groups()) + [None, None])[:3]))
    spark = bindings.sparkSession
    table = F.broadcast(spark.createDataFrame(rules, "template string, rule string, hard boolean, what string, a string, b string, kind string"))  # as small as invariants
    rows = bindings.join(table, "template").withColumn("x", F.try_element_at("slots", F.col("a"))).withColumn("y", F.try_element_at("slots", F.col("b")))
    fails = F.when(F.col("what") == "differs", F.coalesce(F.col("x") == F.col("y"), F.lit(False))).when(F.col("what") == "exists", F.col("x").isNull())
    plain = rows.where("what <> 'edge'").where(fails)
    e = edges.select(F.col("src").alias("x"), F.col("dst").alias("y"), "kind").distinct()
    lone = rows.where("what = 'edge'").join(e, ["x", "y", "kind"], "left_anti")
    return plain.select("instance", "template", "rule", "hard").unionByName(lone.select("instance", "template", "rule", "hard"))


def classify(texts: DataFrame, key: str, text: str, signatures: DataFrame) -> DataFrame:
    """(<key>, class, confidence, exact, fuzzy): the classes whose signatures a text shows.

    signatures: class, signature. A signature that occurs in the lower-case text
    counts two points, one of whose tokens half or more are tokens of the text
    counts one; confidence is the points by the most there can be. All
    signatures, of which there are MAX_SIGNATURES at most, are compared in one
    pass over the texts.
    """
    s = signatures.where(F.length("signature") > 0).select("class", F.lower("signature").alias("sig")).distinct()
    n = s.groupBy("class").agg(F.count("*").alias("n"))
    low = texts.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("low"), F.array_distinct(tx.tokens(F.col(text))).alias("words"))
    packed = s.select("class", "sig").limit(MAX_SIGNATURES + 1).collect()
    if len(packed) > MAX_SIGNATURES:
        raise ValueError(f"there are at most {MAX_SIGNATURES} signatures")
    sigs = F.array(*[F.struct(F.lit(r["class"]).alias("class"), F.lit(r["sig"]).alias("sig"), F.array_distinct(tx.tokens(F.lit(r["sig"]))).alias("tokens")) for r in sorted(packed)])
    if not packed:
        sigs = F.array().cast("array<struct<class:string,sig:string,tokens:array<string>>>")
    hit = F.transform(sigs, lambda x: F.struct(x["class"].alias("class"), F.col("low").contains(x["sig"]).alias("exact"), ((F.size(x["tokens"]) > 0) & (2 * F.size(F.array_intersect(x["tokens"], "words")) >= F.size(x["tokens"]))).alias("near")))
    found = low.select(key, F.explode(F.filter(hit, lambda h: h["exact"] | h["near"])).alias("h"))
    points = found.groupBy(key, "h.class").agg(F.count_if("h.exact").alias("exact"), F.count_if(~F.col("h.exact")).alias("fuzzy"))
    return points.join(n, "class").select(key, "class", F.round(F.least(F.lit(1.0), (2 * F.col("exact") + F.col("fuzzy")) / (2 * F.col("n"))), 9).alias("confidence"), "exact", "fuzzy")


def strategies_for(found: DataFrame, strategies: DataFrame) -> DataFrame:
    """The strategies (strategy, applicable_to array) of each row's class."""
    return found.join(strategies.select("strategy", F.explode("applicable_to").alias("class")).distinct(), "class")

