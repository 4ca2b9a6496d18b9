"""Rules at work: scores, explanation by backward chaining, mining, clustering, refutation, composition, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.facts import jaccard
from causeway.session import materialize
from causeway.skew import hot_keys, salted_join

# Weights of evidence kinds and of rule states.
EVIDENCE_WEIGHTS = {"intervention": 1.0, "quasi_experiment": 0.8, "observational": 0.5}
STATUS_WEIGHTS = {"confirmed": 1.0, "hypothesis": 0.85, "candidate": 0.65, "retired": 0.1}

#: Steps of a score by which best_by_preds and cosine_leaders tell apart what is out of reach.
_LEVELS = 50

#: Rows from which those of a member are told apart by level.
_OFTEN = 64

#: What a rule in an unknown state weighs.
OTHER_STATUS = 0.8


def _lookup(col: Column, weights: dict[str, float], other: float) -> Column:
    out = None
    for k, v in weights.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(other)


def reputation(s: Column, c: Column) -> Column:
    """Grows with support, falls steeply with counterexamples, never below 0.05."""
    return F.greatest(F.lit(0.05), F.greatest(F.lit(0.05), 1 - F.exp(-s / 5.0)) * F.exp(-c.cast("double")))


def specificity(pre: Column, eff: Column) -> Column:
    return F.least(F.lit(1.0), 0.4 + 0.05 * (F.size(pre) + F.size(eff)))


def rule_score(kind: Column, status: Column, s: Column, c: Column, pre: Column, eff: Column) -> Column:
    raw = _lookup(kind, EVIDENCE_WEIGHTS, 0.5) * reputation(s, c) * specificity(pre, eff) * _lookup(status, STATUS_WEIGHTS, OTHER_STATUS)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.01), raw))


def scored(rule_sets: DataFrame) -> DataFrame:
    return rule_sets.withColumn("score", rule_score(F.col("kind"), F.col("status"), F.col("s"), F.col("c"), F.col("pre"), F.col("eff")))


def unexplained(facts: DataFrame, rule_facts: DataFrame) -> DataFrame:
    """The facts whose signature is the effect of no rule."""
    effects = rule_facts.where("side = 'eff'").select("sig").distinct()
    return facts.join(effects, "sig", "left_anti")


def candidates(observations: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """(observation_id, regulation_id, confidence, missing): the rules that share a predicate with an observation.

    observations: observation_id, preds. items: regulation_id, side, pred, sig,
    the distinct facts of rules. confidence: the share of the preconditions
    whose predicate is known times the rule's credibility (0.3 without
    support), so 0 for a rule of which only effects are known; missing: the
    preconditions whose predicate is not known.
    """
    per = items.join(rules.select("regulation_id", "s", "c"), "regulation_id").groupBy("regulation_id", "s", "c", "pred").agg(F.count_if(F.col("side") == "pre").alias("k"))
    need = items.where("side = 'pre'").groupBy("regulation_id").agg(F.count("*").alias("need"))
    n = observations.select("observation_id", F.explode("preds").alias("pred")).join(per, "pred").groupBy("observation_id", "regulation_id", "s", "c").agg(F.sum("k").alias("k"))
    cred = F.when(F.col("s") > 0, F.col("s") / (F.col("s") + F.col("c") + 1)).otherwise(0.3)
    c = n.join(need, "regulation_id", "left").withColumn("need", F.coalesce("need", F.lit(0)))
    return c.select("observation_id", "regulation_id", F.round(F.col("k") / F.greatest("need", F.lit(1)) * cred, 9).alias("confidence"), (F.col("need") - F.col("k")).alias("missing"))


def best_by_preds(observations: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """(observation_id, regulation_id, total, score, rank): the n best rules of each observation, of equals the first by id.

    observations: observation_id, preds (distinct). parts: regulation_id, pred,
    part (0 or more), over, by; total is the sum of a rule's parts over the
    predicates that an observation knows, score = round(total / over * by, 9).
    Rules without a known predicate are none. A column `sure` may give what
    a rule earns at least where the predicate is known, part otherwise; one
    `late` is 1 for parts that are taken after all others, which alone
    are then told apart by the level of their bound.

    What a rule earns by one predicate alone is a lower bound of its score, so
    the best n by each of an observation's predicates give a score that its n
    best must reach. The parts of a rule are in a fixed order; if an
    observation does not know those before one, the rest is an upper bound. A
    rule meets an observation at the first part it knows, and only where that
    bound reaches the score asked for. Rules with the same parts have the same
    scores, so the first n of them stand for all.
    """
    score = lambda total: F.round(total / F.col("over") * F.col("by"), 9)
    rarity = parts.groupBy("pred").agg(F.count("*").alias("rarity"))
    sure = F.col("sure" if "sure" in parts.columns else "part").cast("double").alias("sure")
    late = F.col("late") if "late" in parts.columns else F.lit(0).alias("late")
    one = parts.join(rarity, "pred").groupBy("regulation_id", "over", "by").agg(F.array_sort(F.collect_list(F.struct(late, (-F.col("part")).alias("neg"), "rarity", "pred", sure))).alias("v"))
    one = one.select("regulation_id", "over", "by", F.transform("v", lambda x: F.struct(x["pred"].alias("pred"), (-x["neg"]).cast("double").alias("part"), x["sure"].alias("sure"))).alias("v"))
    alike = F.row_number().over(Window.partitionBy("v", "over", "by").orderBy("regulation_id"))
    one = one.withColumn("r", alike).where(F.col("r") <= n).drop("r")
    rest = lambda i: F.aggregate(F.slice("v", i + 1, F.size("v")), F.lit(0.0), lambda a, x: a + x["part"])
    # a rounding error must not put the bound below the score
    bounds = F.transform("v", lambda x, i: F.struct(x["pred"].alias("pred"), x["sure"].alias("sure"), (rest(i) + 1e-13).alias("rest")))
    index = one.select("regulation_id", "over", "by", "v", F.explode(bounds).alias("x")).select("x.pred", "regulation_id", "over", "by", "v", (-score(F.col("x.sure") - 1e-13)).alias("least"), (-score(F.col("x.rest"))).alias("most"))
    level = lambda c: F.greatest(F.lit(0), F.least(F.lit(_LEVELS), F.floor(-c * _LEVELS))).cast("int")
    finds = parts.select("pred", late).distinct()
    some = F.lit(1) if "late" not in parts.columns else F.col("late")
    index = materialize(index.join(finds, "pred").withColumn("level", F.when(some == 1, level(F.col("most"))).otherwise(0)), "rules-by-pred")
    first = index.select("pred", "least", "regulation_id").withColumn("r", F.row_number().over(Window.partitionBy("pred").orderBy("least", "regulation_id"))).where(F.col("r") <= n)
    first = first.groupBy("pred").agg(F.collect_list(F.struct("least", "regulation_id")).alias("firsts"))
    top = index.groupBy("pred").agg(F.max("level").alias("top"), F.max(some).alias("split"))
    known = observations.select("observation_id", F.explode("preds").alias("pred"))
    sure = known.join(first, "pred").select("observation_id", F.explode("firsts").alias("f")).groupBy("observation_id", "f.regulation_id").agg(F.min("f.least").alias("least"))
    asked = sure.groupBy("observation_id").agg(F.get(F.array_sort(F.collect_list(F.struct("least", "regulation_id"))), F.lit(n - 1)).alias("asked"))  # n rows per predicate
    asked = observations.select("observation_id", "preds").join(asked, "observation_id")
    own = asked.select("*", F.explode("preds").alias("pred")).join(top, "pred")
    from_ = F.when(F.col("asked").isNull() | (F.col("split") == 0), 0).otherwise(level(F.col("asked.least")))
    own = own.where(from_ <= F.col("top")).select("observation_id", "preds", "asked", "pred", F.explode(F.sequence(from_, F.col("top"))).alias("level"))
    reaches = lambda c: F.col("asked").isNull() | (F.col(c) < F.col("asked.least")) | ((F.col(c) == F.col("asked.least")) & (F.col("regulation_id") <= F.col("asked.regulation_id")))
    # few rows make many pairs here, so their partitions must not be merged by size
    cells = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = own.repartition(cells, "pred", "level").join(index, ["pred", "level"]).where(reaches("most"))
    mine = F.transform(F.array(F.filter("v", lambda x: F.array_contains("preds", x["pred"]))), lambda m: F.struct(F.get(m, F.lit(0))["pred"].alias("first"), F.aggregate(m, F.lit(0.0), lambda a, x: a + x["part"]).alias("total")))
    # a generator is not pushed into the join, so this is computed once, for what passed the bound
    met = met.select("observation_id", "regulation_id", "asked", "over", "by", F.inline(F.filter(mine, lambda x: x["first"] == F.col("pred"))))
    met = met.select("observation_id", "regulation_id", "asked", "total", (-score(F.col("total"))).alias("neg")).where(reaches("neg"))
    rank = F.row_number().over(Window.partitionBy("observation_id").orderBy("neg", "regulation_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= n).select("observation_id", "regulation_id", "total", (-F.col("neg")).alias("score"), "rank")


def best_candidates(observations: DataFrame, items: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """The n best of candidates() of each observation, with their rank: by confidence, of equals the first by id."""
    cred = F.when(F.col("s") > 0, F.col("s") / (F.col("s") + F.col("c") + 1)).otherwise(0.3)
    need = items.where("side = 'pre'").groupBy("regulation_id").agg(F.count("*").alias("need"))
    of = rules.select("regulation_id", cred.alias("by")).join(need, "regulation_id", "left").withColumn("need", F.coalesce("need", F.lit(0)))
    per = items.groupBy("regulation_id", "pred").agg(F.count_if(F.col("side") == "pre").alias("part"))
    parts = per.join(of, "regulation_id").select("regulation_id", "pred", "part", F.greatest("need", F.lit(1)).alias("over"), "by")
    best = best_by_preds(observations, parts, n).join(of, "regulation_id")
    return best.select("observation_id", "regulation_id", F.col("score").alias("confidence"), (F.col("need") - F.col("total")).cast("long").alias("missing"), "rank")


def similar_pairs(sets: DataFrame, key: str, members: str, least: float) -> DataFrame:
    """(a, b, similarity): pairs a < b of distinct member sets with Jaccard similarity of at least `least`.

    Equal sets are one class first. Candidates share one of their rarest
    members: two sets as alike as asked must share one among the first
    |x| - ceil(least |x|) + 1 in order of rarity (prefix filter), so frequent
    members never join. Sizes bound the similarity of different sets by
    smaller / larger, or (n - 1) / (n + 1) for equal sizes; pairs and sets that
    cannot reach `least` are left out before they meet. Sets with d members
    not in common have a similarity of (s - d) / (s + d) for sizes of s
    together. Where d = 2 is too many, a pair is a set and the same without one
    member, and found by equality.
    """
    classes = sets.where(F.size(members) > 0).groupBy(members).agg(F.min(key).alias(key))
    if 0 < least < 1:
        n = F.size(members)
        classes = classes.where(F.greatest(n / (n + 1), (n - 1) / n) >= least - 1e-12)
    classes = materialize(classes, "sets")
    # from this size together on, sets may differ by two members
    both = 2 * (1 + least) / (1 - least) - 1e-9 if least < 1 else float("inf")
    whole = F.array_sort(members)
    less = classes.select(F.col(key).alias("k"), F.size(members).alias("n"), F.inline(F.transform(whole, lambda x: F.struct(F.array_remove(whole, x).alias("set")))))
    less = less.where((2 * F.col("n") - 1 < both) & ((F.col("n") - 1) / F.col("n") >= least - 1e-12) & (F.size("set") > 0))
    near = less.join(classes.select(F.col(key).alias("l"), whole.alias("set")), "set").select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"), F.round((F.col("n") - 1) / F.col("n"), 9).alias("similarity"))
    # of sizes x and y together `both` or more, the smaller is at least this
    smallest = both * least / (1 + least) - 1e-6
    classes = classes.where(F.size(members) >= smallest)
    n = classes.select(F.explode(members).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    ranked = classes.select(key, F.explode(members).alias("m")).join(n, "m").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "m"))).alias("r"))
    size = F.size("r")
    prefix = F.slice("r", F.lit(1), (size - F.ceil(least * size - F.lit(1e-9)) + 1).cast("int"))
    p = ranked.select(key, size.alias("size"), F.transform("r", lambda x: x["m"]).alias("set"), F.explode(prefix).alias("x")).select(key, "size", "set", F.col("x.m").alias("m"))
    a, b = p.withColumnsRenamed({key: "a", "size": "na", "set": "sa"}), p.withColumnsRenamed({key: "b", "size": "nb", "set": "sb"})
    bound = F.when(F.col("na") == F.col("nb"), (F.col("na") - 1) / (F.col("na") + 1)).otherwise(F.least("na", "nb") / F.greatest("na", "nb"))
    # compared where they meet, so that only pairs that are alike are moved
    alike = (F.col("a") < F.col("b")) & (bound >= least - 1e-12) & (F.col("na") + F.col("nb") >= both)
    # few rows make many pairs here, so their partitions must not be merged by size
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = a.repartition(parts, "m", "a").join(b, "m").where(alike).withColumn("similarity", jaccard(F.col("sa"), F.col("sb")))
    return pairs.where(F.col("similarity") >= least - 1e-12).select("a", "b", F.round("similarity", 9).alias("similarity")).distinct().unionByName(near)


def _heads(vectors: DataFrame, key: str, member: str, weight: str, least: float) -> DataFrame:
    """(<key>, v, head): the unit vector of each key, without members that no other has, and those by which it can be alike to another.

    Members are in order of rarity. The rest of a unit vector, from where its
    length falls below `least`, cannot make a pair alone, so the first common
    member of two that are alike is in the head of both, and their cosine is at
    most the product of the lengths s from there on.
    """
    norm = vectors.groupBy(key).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))
    n = vectors.groupBy(member).agg(F.count("*").alias("n"))
    part = F.when(F.col("norm") > 0, F.col(weight) / F.col("norm")).otherwise(0.0)
    unit = vectors.join(norm, key).join(n, member).select(key, F.struct("n", F.col(member).alias("m"), part.alias("w")).alias("x"))
    v = unit.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("all"))  # a row's members
    rest = lambda i: F.aggregate(F.slice("all", i + 1, F.size("all")), F.lit(0.0), lambda a, x: a + x["w"] * x["w"])
    ends = F.transform("all", lambda x, i: F.struct(x["n"].alias("n"), x["m"].alias("m"), rest(i).alias("r")))
    head = F.transform(F.filter(ends, lambda x: (x["n"] > 1) & (x["r"] >= least * least - 1e-12)), lambda x: F.struct(x["m"].alias("m"), F.sqrt(x["r"]).alias("s")))
    return v.select(key, F.transform(F.filter("all", lambda x: x["n"] > 1), lambda x: F.struct(x["m"].alias("m"), x["w"].alias("w"))).alias("v"), head.alias("head"))


def _alike(left: DataFrame, right: DataFrame, key: str, least: float) -> DataFrame:
    """(a, b): pairs a < b of a row of left and one of right, both from _heads(), whose cosine is at least `least`; some twice.

    Where a member is frequent on the left, its rows lie by levels of s, and a
    row of the right meets only the levels at which the bound can be reached.
    """
    low = least - 1e-9
    a, b = (t.select(F.col(key).alias(k), F.col("v").alias(f"v{k}"), F.inline("head")).withColumnRenamed("s", f"s{k}") for t, k in ((left, "a"), (right, "b")))
    top = materialize(a.groupBy("m").agg(F.max("sa").alias("top"), F.count("*").alias("n")), "members")
    level = lambda s: F.when(F.col("n") >= _OFTEN, F.floor(s * _LEVELS)).otherwise(0).cast("int")
    a = a.join(top.where(F.col("n") >= _OFTEN), "m", "left").select("m", level(F.col("sa")).alias("level"), "a", "va", "sa")
    b = b.join(top, "m").where(F.col("sb") * F.col("top") >= low)
    b = materialize(b.select("m", F.explode(F.sequence(level(low / F.col("sb")), level(F.col("top")))).alias("level"), "b", "vb", "sb"), "members-by-level")
    dot = F.aggregate("va", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.get(F.filter("vb", lambda y: y["m"] == x["m"]), F.lit(0))["w"], F.lit(0.0)))
    met = salted_join(b, a, ["m", "level"], hot=hot_keys(b, ["m", "level"], least=1000)).where((F.col("a") < F.col("b")) & (F.col("sa") * F.col("sb") >= low))
    return met.where(F.round(dot, 9) >= low).select("a", "b")


def cosine_leaders(vectors: DataFrame, key: str, member: str, weight: str, least: float, block: int = 32_768) -> DataFrame:
    """(<key>, leader): greedy leader clusters, in order of keys, of vectors (rows of key, member, weight) whose cosine is at least `least` (above 0).

    Only leaders are compared with what comes after them: keys are taken in
    blocks in their order, each three times what was before. A block is
    clustered by its pairs; all later keys that are alike to one of its leaders
    join the smallest, which comes before the leaders of any later block, and
    are met no more. Whoever is alike to none leads.
    """
    heads = materialize(_heads(vectors, key, member, weight, least), "vectors")
    some = heads.where(F.size("head") > 0)
    out = heads.where(F.size("head") == 0).select(key, F.col(key).alias("leader"))
    parts = max(1, -(-some.count() // block))
    open_ = materialize(some.repartitionByRange(parts, key).withColumn("__part", F.spark_partition_id()), "open")
    end = 1
    while True:
        now, later = open_.where(F.col("__part") < end), open_.where(F.col("__part") >= end)
        mine = materialize(leader_clusters(_alike(now, now, key, least), now.select(key), key), "leaders")
        out = out.unionByName(mine)
        if end >= parts:
            return out
        leads = now.join(mine.where(F.col(key) == F.col("leader")).select(key), key, "leftsemi")
        found = materialize(_alike(leads, later, key, least).groupBy(F.col("b").alias(key)).agg(F.min("a").alias("leader")), "leaders")
        out = out.unionByName(found)
        open_ = materialize(later.join(found.select(key), key, "left_anti"), "open")
        end *= 4


def leader_clusters(pairs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(<key>, leader): greedy leader clustering over similar pairs, in order of keys.

    A key leads if no smaller key that leads is similar to it; all others join
    the smallest such leader. Decided in rounds: whoever has no undecided
    smaller neighbour is decided, the rounds being few since chains of
    undecided neighbours are short.
    """
    e = materialize(pairs.select(F.col("b").alias(key), F.col("a").alias("smaller")), "pairs")
    leads = keys.select(key).join(e.select(key), key, "left_anti").withColumn("leader", F.col(key))
    decided = materialize(leads, "leaders")
    open_ = materialize(e.select(key).distinct(), "open")
    while open_.limit(1).count():
        e_open = e.join(open_, key, "leftsemi")
        state = e_open.join(decided.withColumnsRenamed({key: "smaller", "leader": "l"}), "smaller", "left").groupBy(key).agg(
            F.min(F.when(F.col("l") == F.col("smaller"), F.col("smaller"))).alias("first"), F.min(F.when(F.col("l").isNull(), F.col("smaller"))).alias("wait")
        )
        # the smallest leading neighbour is final once no smaller one is undecided
        now = state.where("wait is null or first < wait").select(key, F.coalesce("first", F.col(key)).alias("leader"))
        decided = materialize(decided.unionByName(now), "leaders")
        open_ = materialize(open_.join(decided, key, "left_anti"), "open")
    return decided


def classes(sets: DataFrame, key: str, members: str) -> DataFrame:
    """(<key>, <members>, class_id): every row with members and the smallest key of those with equal members."""
    some = sets.where(F.size(members) > 0).select(key, members)
    return some.join(some.groupBy(members).agg(F.min(key).alias("class_id")), members)


def led(sets: DataFrame, key: str, members: str, least: float) -> DataFrame:
    """(<key>, leader): leader_clusters over the distinct member sets, given to every row."""
    mine = materialize(classes(sets, key, members), "classes")
    leaders = leader_clusters(similar_pairs(mine, key, members, least), mine.select(F.col("class_id").alias(key)).distinct(), key)
    return mine.join(leaders.withColumnRenamed(key, "class_id"), "class_id").select(key, "leader")


def chain_compositions(rule_sets: DataFrame) -> DataFrame:
    """(first, second, pre, eff, support): rule pairs in which an effect of the first is a precondition of the second.

    pre: the preconditions of both without the bridging effects; support: the smaller.
    """
    return _compositions(rule_sets, rule_sets)


def _compositions(firsts: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """chain_compositions() of the rules of firsts with those of rule_sets."""
    a = firsts.select(F.col("regulation_id").alias("first"), F.col("pre").alias("pre1"), F.col("eff").alias("eff1"), F.col("s").alias("s1"), F.explode("eff").alias("bridge"))
    b = rule_sets.select(F.col("regulation_id").alias("second"), F.col("pre").alias("pre2"), F.col("eff").alias("eff2"), F.col("s").alias("s2"), F.explode("pre").alias("bridge"))
    # a frequent signature makes many pairs: its rules are spread over tasks
    hot = hot_keys(a, ["bridge"], least=1000)
    j = salted_join(a, b, ["bridge"], hot=hot).where("first <> second").drop("bridge").distinct()
    pre = F.array_sort(F.array_union("pre1", F.array_except("pre2", "eff1")))
    return j.select("first", "second", F.array_join(pre, ";").alias("pre"), F.array_join("eff2", ";").alias("eff"), F.least("s1", "s2").alias("support"))


def first_compositions(rule_sets: DataFrame, n: int, block: int = 64) -> DataFrame:
    """(pre, eff, chain): the n first of chain_compositions() whose sets are those of no rule, repeats left out, by chain (first>second).

    Chains are in order of their first rules, so the compositions of the first
    rules alone hold the n first once there are n of them; until then eight
    times as many first rules are tried.
    """
    have = rule_sets.select(F.array_join("pre", ";").alias("pre"), F.array_join("eff", ";").alias("eff")).distinct()
    bridges = rule_sets.select(F.explode("pre").alias("bridge")).distinct()
    heads = rule_sets.select("regulation_id", F.explode("eff").alias("bridge")).join(bridges, "bridge", "leftsemi").select(F.concat("regulation_id", F.lit(">")).alias("head")).distinct()
    heads = materialize(heads, "heads")
    total = heads.count()
    while True:
        last = heads.orderBy("head").limit(block).agg(F.max("head").alias("h")).first()["h"]  # one value
        some = rule_sets.where(F.concat("regulation_id", F.lit(">")) <= F.lit(last))
        new = _compositions(some, rule_sets).join(have, ["pre", "eff"], "left_anti")
        found = materialize(new.groupBy("pre", "eff").agg(F.min(F.concat_ws(">", "first", "second")).alias("chain")).orderBy("chain", "pre", "eff").limit(n), "compositions")
        if block >= total or found.count() >= n:
            return found.orderBy("chain", "pre", "eff")
        block *= 8


def seeded_index(seed: int, n: Column, *cols: Column) -> Column:
    """A number in [0, n) drawn from seed and cols, the same in every run."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), n)
