"""Rules from unexplained observations: clusters, induction, validation, refutation, and the products of proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators import reasoning
from causeway.operators.explain import candidate_counts, fits
from causeway.operators.facts import containing, jaccard
from causeway.session import materialize
from causeway.skew import salted_join

# The sizes and shares of induction, and the rounds and shares of refutation.
LEAST_EVENTS, MOST_PRE, MOST_EFF, PRE_SUPPORT, PRE_RATIO = 3, 8, 3, 0.3, 0.8
ROUNDS, SUBSET_SHARE, KEPT_SHARE, DRIFT = 5, 7, 0.5, 0.3
EXACT_WEIGHT, LOOSE_WEIGHT = 0.7, 0.3


def hashed(*parts: Column) -> Column:
    """A number of 32 bits from md5 over the parts joined by `|`, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def unexplained_goals(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """(observation_id, pred, val, sig): the goals that no rule whose scope fits the observation has as an effect."""
    counts = candidate_counts(rules)
    g = observations.select("observation_id", "context", F.explode("goals").alias("g")).select("observation_id", "context", "g.pred", "g.val")
    g = salted_join(g.withColumn("c", F.col("context")), counts, ["pred", "val"], "left")
    some = F.exists(F.coalesce("scopes", F.array().cast("array<struct<scope:array<struct<k:string,v:string>>,n:bigint>>")), lambda s: fits(s["scope"], F.col("context")))
    return g.where(~some).select("observation_id", "pred", "val", F.concat_ws("|", "pred", "val").alias("sig")).distinct()


def event_clusters(goals: DataFrame, context: DataFrame, keys: list[str], least: int = LEAST_EVENTS) -> DataFrame:
    """(event_id, cluster_key): events with the same unexplained goals and the same values of the context keys, from `least` on."""
    sigs = goals.groupBy(F.col("observation_id").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_set("sig")), "&").alias("sigs"))
    own = context.where(F.col("key").isin(keys)).groupBy(F.col("observation_id").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "key", "value"))), "&").alias("ctx"))
    e = sigs.join(own, "event_id", "left").select("event_id", F.concat_ws("::", "sigs", F.coalesce("ctx", F.lit(""))).alias("cluster_key"))
    big = e.groupBy("cluster_key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return salted_join(e, big.drop("n"), ["cluster_key"], "leftsemi")


def induced(clusters: DataFrame, goals: DataFrame, items: DataFrame, most_pre: int = MOST_PRE, most_eff: int = MOST_EFF, support: float = PRE_SUPPORT) -> DataFrame:
    """(cluster_key, n, pre, eff): a candidate rule per cluster of events.

    items: (event_id, sig), the distinct facts and context entries of all
    events. eff: the goals that all events of the cluster share, the first by
    name. pre: the items in at least `support` of the cluster's events that are
    more frequent there than among all events, by support times lift; those
    that are effects are then left out.
    """
    size = clusters.groupBy("cluster_key").agg(F.count("*").alias("n"))
    total = items.select("event_id").distinct().count()
    mine = salted_join(goals.select(F.col("observation_id").alias("event_id"), "pred", "val", "sig").distinct(), clusters, ["event_id"])
    common = mine.groupBy("cluster_key", "pred", "val", "sig").agg(F.count("*").alias("k")).join(size, "cluster_key").where("k = n")
    eff = common.groupBy("cluster_key").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pred", "val", "sig"))), 1, most_eff), lambda x: x["sig"]).alias("eff"))  # a cluster's events share one set of goals
    everywhere = items.groupBy("sig").agg(F.count("*").alias("all_n"))
    here = salted_join(items, clusters, ["event_id"]).groupBy("cluster_key", "sig").agg(F.count("*").alias("k")).join(size, "cluster_key").where(F.col("k") / F.col("n") >= support)
    s = here.join(everywhere, "sig").withColumn("support", F.col("k") / F.col("n")).withColumn("lift", F.col("support") / (F.col("all_n") / F.lit(max(1, total)))).where("lift > 1")
    # at most 1 / support times an event's items pass for a cluster
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc(F.round(F.col("support") * F.col("lift"), 9)), "sig"))
    best = s.withColumn("rank", rank).where(F.col("rank") <= most_pre)
    pre = best.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sig"))), lambda x: x["sig"]).alias("pre"))
    out = size.join(eff, "cluster_key").join(pre, "cluster_key", "left")
    none = F.array().cast("array<string>")
    return out.select("cluster_key", "n", F.array_except(F.coalesce("pre", none), "eff").alias("pre"), "eff")


def validated(candidates: DataFrame, clusters: DataFrame, items: DataFrame, existing: DataFrame, ratio: float = PRE_RATIO) -> DataFrame:
    """(cluster_key, ratio, reasons): why a candidate is refused; no reason where it is valid.

    ratio: the share of the cluster's events that have all preconditions.
    existing: rules with sorted pre and eff; one with the same sets is a duplicate.
    """
    need = candidates.select("cluster_key", "n", F.explode("pre").alias("sig"))
    have = salted_join(items, clusters, ["event_id"])
    met = have.join(need, ["cluster_key", "sig"]).groupBy("cluster_key", "event_id").agg(F.count("*").alias("k"))
    all_ = met.join(candidates.select("cluster_key", F.size("pre").alias("need")), "cluster_key").where("k = need").groupBy("cluster_key").agg(F.count("*").alias("ok"))
    same = existing.groupBy("pre", "eff").agg(F.min("regulation_id").alias("twin"))
    c = candidates.select("cluster_key", "n", "pre", "eff", F.array_sort("pre").alias("p"), F.array_sort("eff").alias("e"))
    c = c.join(same.withColumnsRenamed({"pre": "p", "eff": "e"}), ["p", "e"], "left").join(all_, "cluster_key", "left")
    share = F.when(F.size("pre") == 0, 1.0).otherwise(F.coalesce("ok", F.lit(0)) / F.col("n"))
    reasons = F.array_compact(F.array(
        F.when(F.size("eff") == 0, F.lit("empty_eff")), F.when(F.size("pre") == 0, F.lit("empty_pre")), F.when(F.col("twin").isNotNull(), F.concat(F.lit("duplicate_of:"), F.col("twin"))), F.when(share < ratio, F.lit("pre_support_ratio_too_low")),
    ))
    return c.select("cluster_key", F.round(share, 9).alias("ratio"), F.array_join(reasons, ",").alias("reasons"))


def two_passes(sets: DataFrame, key: str, exact: str, loose: str, least: float) -> DataFrame:
    """(<key>, leader, pass): greedy leader clusters by Jaccard of the exact sets; those left alone once more by the weighted likeness.

    The second pass asks for a tenth more, 0.9 at most, of 0.7 times the
    likeness of the exact sets and 0.3 times that of the loose ones; whatever
    reaches it has an exact likeness of at least (that - 0.3) / 0.7, by which
    its pairs are found. pass is null for those that stay alone. Rows without
    exact members are in no cluster.
    """
    some = materialize(sets.where(F.size(exact) > 0).select(key, exact, loose), "cluster-sets")
    first = materialize(reasoning.led(some, key, exact, least), "first-pass")
    size = first.groupBy("leader").agg(F.count("*").alias("n"))
    sized = salted_join(first, size, ["leader"])
    rest = materialize(some.join(sized.where("n = 1").select(key), key, "leftsemi"), "left-alone")
    asked = min(least + 0.1, 0.9)
    pairs = reasoning.similar_pairs(rest, key, exact, max(0.01, (asked - LOOSE_WEIGHT) / EXACT_WEIGHT))
    side = lambda n: rest.select(F.col(key).alias(n), F.col(exact).alias(f"x{n}"), F.col(loose).alias(f"l{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    alike = EXACT_WEIGHT * jaccard(F.col("xa"), F.col("xb")) + LOOSE_WEIGHT * jaccard(F.col("la"), F.col("lb"))
    second = reasoning.leader_clusters(both.where(alike >= asked - 1e-12).select("a", "b"), rest, key)
    second = materialize(second, "second-pass")
    grown = second.groupBy("leader").agg(F.count("*").alias("n"))
    again = second.join(grown, "leader").select(key, "leader", F.when(F.col("n") > 1, 2).cast("int").alias("pass"))
    return sized.where("n > 1").select(key, "leader", F.lit(1).alias("pass")).unionByName(again)


# -- refutation


def value_ranks(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pred, val, idx), (pred, n)): the distinct values of each predicate, numbered from 0 in order of their md5.

    Ranked in two levels, by the first two digits of the md5 and within them,
    so that no task sorts all values of a predicate.
    """
    v = facts.select("pred", "val").distinct().withColumn("m", F.md5("val")).withColumn("b", F.substring("m", 1, 2))
    per = v.groupBy("pred", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("pred").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 256 rows per predicate
    place = F.row_number().over(Window.partitionBy("pred", "b").orderBy("m", "val")) - 1
    ranked = v.withColumn("place", place).join(per.withColumn("before", before).drop("n"), ["pred", "b"]).select("pred", "val", (F.col("before") + F.col("place")).cast("long").alias("idx"))
    return ranked, per.groupBy("pred").agg(F.sum("n").alias("n"))


def refuted(rules: DataFrame, observations: DataFrame, facts: DataFrame) -> DataFrame:
    """(regulation_id, support, placebo, subset, permuted, placebo_ok, subset_ok, permuted_ok, passed): three tests of each rule and their majority.

    rules: regulation_id, items (array of struct(pred, val, sig), the distinct
    preconditions in order of sig). support: the observations that have all
    preconditions. placebo: its mean over ROUNDS rounds in which each
    precondition takes another of its predicate's values; permuted: over ROUNDS
    rounds in which each fact does; both pass below KEPT_SHARE of the support.
    subset: the support among the observations whose hash is in SUBSET_SHARE
    tenths; passes if the shares differ by DRIFT at most. Values are drawn by
    hashes. Without preconditions all observations support a rule.
    """
    facts = materialize(facts.select("observation_id", "ord", "pred", "val", "sig").distinct(), "facts")
    observations = observations.select("observation_id")
    ranked, sizes = value_ranks(facts)
    ranked, sizes = materialize(ranked, "values"), materialize(sizes, "value-counts")
    rounds = F.explode(F.sequence(F.lit(1), F.lit(ROUNDS)))
    plain = rules.select("regulation_id", F.transform("items", lambda x: x["sig"]).alias("pre"))
    inside = hashed(F.col("observation_id"), F.lit("subset")) % 10 < SUBSET_SHARE
    all_ = observations.agg(F.count("*").alias("n"), F.count_if(inside).alias("n7")).first()  # one row
    members = facts.select(F.col("observation_id").alias("key"), "sig").distinct()
    held = containing(plain.select(F.col("pre").alias("need")), members, subset=hashed(F.col("key"), F.lit("subset")) % 10 < SUBSET_SHARE)
    real_n = plain.join(held, plain["pre"] == held["need"]).select("regulation_id", F.col("n").alias("support"), "subset")
    # placebo: another value for each precondition; a predicate with one value keeps it
    p = rules.select("regulation_id", F.explode("items").alias("p")).select("regulation_id", "p.*", rounds.alias("round"))
    p = p.join(sizes, "pred", "left").join(ranked.withColumnRenamed("idx", "own"), ["pred", "val"], "left")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("own").isNotNull(), 1).otherwise(0)
    drawn = hashed(F.col("regulation_id"), F.col("sig"), F.col("round")) % F.greatest(others, F.lit(1))
    p = p.withColumn("idx", F.when(others > 0, drawn + F.when(F.col("own").isNotNull() & (drawn >= F.col("own")), 1).otherwise(0)))
    p = p.join(ranked.select("pred", F.col("val").alias("other"), "idx"), ["pred", "idx"], "left").withColumn("sig", F.when(F.col("other").isNotNull(), F.concat_ws("|", "pred", "other")).otherwise(F.col("sig")))
    fake = materialize(p.groupBy("regulation_id", "round").agg(F.array_sort(F.collect_set("sig")).alias("need")), "placebos")
    placebo_n = fake.join(containing(fake, members), "need").groupBy("regulation_id").agg(F.sum("n").alias("placebo"))
    # permutation: another observation per round, with values drawn for its facts
    f = facts.select("observation_id", "ord", "pred", rounds.alias("round")).join(sizes, "pred").withColumn("idx", hashed(F.col("observation_id"), F.col("ord"), F.col("round")) % F.col("n"))
    # only what some rule asks for
    needed = rules.select(F.explode("items").alias("p")).select("p.sig").distinct()
    ranked = ranked.withColumn("sig", F.concat_ws("|", "pred", "val")).join(needed, "sig", "leftsemi").select("pred", "idx", "sig")
    f = f.join(ranked, ["pred", "idx"]).select(F.struct("observation_id", "round").alias("key"), "sig").distinct()
    moved = containing(plain.select(F.col("pre").alias("need")), f)
    permuted_n = plain.join(moved, plain["pre"] == moved["need"]).select("regulation_id", F.col("n").alias("permuted"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bare = F.size("pre") == 0
    n, n7 = F.lit(all_["n"]), F.lit(all_["n7"])
    out = plain.join(real_n, "regulation_id", "left").join(placebo_n, "regulation_id", "left").join(permuted_n, "regulation_id", "left").select(
        "regulation_id", F.when(bare, n).otherwise(zero("support")).alias("support"), F.when(bare, n7).otherwise(zero("subset")).alias("subset"),
        *[F.when(bare, n.cast("double")).otherwise(zero(c) / ROUNDS).alias(c) for c in ("placebo", "permuted")],
    )
    falls = lambda c: F.when(F.col("support") > 0, F.col(c) / F.col("support")).otherwise(0.0) < KEPT_SHARE
    steady = F.lit(all_["n"] < 3) | (F.abs(F.col("support") / F.greatest(n, F.lit(1)) - F.col("subset") / F.greatest(n7, F.lit(1))) <= DRIFT)
    out = out.select("*", falls("placebo").alias("placebo_ok"), steady.alias("subset_ok"), falls("permuted").alias("permuted_ok"))
    votes = sum((F.col(c).cast("int") for c in ("placebo_ok", "subset_ok", "permuted_ok")), F.lit(0))
    return out.withColumn("passed", votes >= 2)


# -- products of proofs


def proof_products(rule_items: DataFrame, weights: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """The semirings' products over a rule and its preconditions: (regulation_id, possible, likeliest) and (regulation_id, sig, proof, weight, rank).

    rule_items: regulation_id, side, sig. weights: regulation_id, w. A
    precondition's value is the sum over the rules that conclude it (or, or the
    greatest w), one that no rule concludes counts as given (true, 1). possible:
    the conjunction with w > 0; likeliest: the product with w. The k best proofs
    of a precondition that is concluded, each followed by the rule, are the
    product of the lists of proofs of both, cut to k.
    """
    items = rule_items.select("regulation_id", "side", "sig").distinct()
    concluded = items.where("side = 'eff'").join(weights, "regulation_id").select(F.col("regulation_id").alias("by"), "sig", "w")
    value = concluded.groupBy("sig").agg(F.max("w").alias("best"), F.bool_or(F.col("w") > 0).alias("some"))
    pre = items.where("side = 'pre'").join(value, "sig", "left")
    per = pre.groupBy("regulation_id").agg(F.product(F.coalesce("best", F.lit(1.0))).alias("product"), F.bool_and(F.coalesce("some", F.lit(True))).alias("all"))
    both = weights.join(per, "regulation_id", "left").select("regulation_id", ((F.col("w") > 0) & F.coalesce("all", F.lit(True))).alias("possible"), F.round(F.col("w") * F.coalesce("product", F.lit(1.0)), 9).alias("likeliest"))
    # only the k + 1 best proofs of a precondition can be among its k best without the rule itself; if that weighs nothing all are equal, and the first by name count
    salt = F.pmod(F.xxhash64("by"), F.lit(32))

    def first(t: DataFrame, *order: Column | str) -> DataFrame:
        for group in (["sig", salt], ["sig"]):
            t = t.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("r") <= k + 1).drop("r")
        return t

    top = first(concluded, F.desc("w"), "by").unionByName(first(concluded, "by")).distinct()
    chained = items.where("side = 'pre'").select("regulation_id", "sig").join(weights, "regulation_id").withColumnRenamed("w", "own").join(top, "sig").where("by <> regulation_id")
    chained = chained.select("regulation_id", "sig", F.concat_ws(">", "by", "regulation_id").alias("proof"), F.round(F.col("w") * F.col("own"), 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("regulation_id", "sig").orderBy(F.desc("weight"), "proof"))
    return both, chained.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
