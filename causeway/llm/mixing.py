"""Mixing sources to target shares of tokens by raking, with capped repetition."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.text import strip
from causeway.llm.encode import token_counts
from causeway.session import discard, materialize, materialize_counted

#: Cells (source, language, topic) up to this number are fitted on the driver, more on the cluster, by the same steps.
MAX_CELLS = 100_000
#: Raking stops when no marginal is off by more than this share, or after so many rounds.
TOLERANCE, ROUNDS = 1e-9, 500
#: Scales tried at once per source when the sampled sizes are calibrated, and how often the grid is refined.
GRID, REFINEMENTS = 32, 3
#: Steps in which a source's weights are brought to its goal although its cap cuts some off.
FILLS = 100
#: The fills of a round end when no weight moves by more than this share.
FILLED = 1e-12
#: Sources that can be targets; their table goes to the driver.
MAX_SOURCES = 10_000


def source_key(col):
    """A source without letter case and white space around it; null and blank are no source."""
    key = F.lower(strip(col))
    return F.when(key != "", key)


def language_key(col):
    """The primary language of a tag in lower case: en for en-US; und for none."""
    key = F.regexp_extract(F.lower(strip(F.coalesce(col, F.lit("")))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(key != "", key).otherwise("und")


def sized(docs: DataFrame, **vocabulary) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of every document; documents of no tokens have size 0."""
    counts = token_counts(docs, **vocabulary)
    keys = docs.select("doc_id", source_key(F.col("source")).alias("source"), language_key(F.col("lang")).alias("lang"), F.coalesce(strip(F.col("project")), F.lit("")).alias("topic")).distinct()
    return materialize(keys.join(counts, "doc_id"), "sized")


def target_table(targets: DataFrame) -> pd.DataFrame:
    """source, target_share (rescaled to sum 1) and max_repeats per source; repeated sources are added up and take the smaller cap. Raises ValueError beyond MAX_SOURCES."""
    rows = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0").distinct().groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).limit(MAX_SOURCES + 1).toPandas()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources can be targets")
    rows["max_repeats"] = rows.max_repeats.fillna(1).astype(int).clip(lower=0)
    if len(rows):
        rows["target_share"] = rows.target_share / rows.target_share.sum()
    return rows.sort_values("source", ignore_index=True)


def reachable_total(tokens: dict[str, int], targets: pd.DataFrame) -> float:
    """The greatest total at which every source that has tokens can give its share within its cap."""
    have = [(tokens[r.source] * r.max_repeats / r.target_share) for r in targets.itertuples() if tokens.get(r.source, 0) > 0 and r.max_repeats > 0]
    return min(have, default=0.0)


@dataclass(frozen=True)
class Fit:
    """weights (source, lang, topic, tokens, weight), how many rounds they took, and whether the last one changed none by more than the tolerance."""

    weights: pd.DataFrame | DataFrame
    rounds: int
    converged: bool


def rake(cells: pd.DataFrame, targets: pd.DataFrame, total: float, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> Fit:
    """cells (source, lang, topic, tokens) with `weight`: the expected copies of each document of the cell.

    Iterative proportional fitting: weights are scaled to the marginals of
    topic, language and source in turn. Those of topics and languages are the
    corpus's own shares of tokens among the targeted sources, to which they
    are soft: a weight never exceeds its source's cap, and sources come last,
    with what the cap cuts off spread over the source's other cells, so their
    marginals hold exactly wherever the cap allows.
    """
    t = targets.set_index("source")
    out = cells[cells.source.isin(t.index) & (cells.tokens > 0)].reset_index(drop=True)
    out["weight"] = 0.0
    if not len(out) or not total:
        return Fit(out, 0, True)
    cap = out.source.map(t.max_repeats).to_numpy(float)
    size = out.tokens.to_numpy(float)
    want = out.source.map(t.target_share).to_numpy(float)
    codes = {k: pd.factorize(out[k])[0] for k in ("source", "lang", "topic")}
    share = {k: np.bincount(codes[k], size) / size.sum() for k in ("lang", "topic")}
    goal = np.zeros(codes["source"].max() + 1)
    goal[codes["source"]] = want * total
    reach = goal.sum()
    own = np.bincount(codes["source"], size)
    w = np.minimum(cap, (goal / own)[codes["source"]])
    n, converged = 0, False
    while n < rounds and not converged:
        n, old = n + 1, w
        for k in ("topic", "lang"):
            now = np.bincount(codes[k], w * size)
            w = np.minimum(cap, w * (share[k] * reach / np.maximum(now, 1e-200))[codes[k]])
        for _ in range(FILLS):
            before, now = w, np.bincount(codes["source"], w * size)
            w = np.minimum(cap, w * (goal / np.maximum(now, 1e-200))[codes["source"]])
            if np.max(np.abs(w - before) / np.maximum(before, 1e-200)) < FILLED:  # there, or the caps allow no more
                break
        converged = bool(np.max(np.abs(w - old) / np.maximum(old, 1e-12)) < tolerance)
    out["weight"] = w
    return Fit(out, n, converged)


def rake_on_cluster(cells: DataFrame, targets: DataFrame, total: float, tolerance: float = TOLERANCE, rounds: int = ROUNDS, fills: int = FILLS) -> Fit:
    """rake() where the cells are too many for the driver: the same steps as aggregates and joins, each written to the shared folder.

    targets: source, target_share, max_repeats. Sums per marginal are combined
    before the shuffle; a marginal's table is joined by its size. Steps and
    stops are those of rake(), so the weights differ by the order of sums only;
    each step is a job.
    """
    rows = cells.where("tokens > 0").join(targets, "source")
    rows = rows.select("source", "lang", "topic", "tokens", F.col("max_repeats").cast("double").alias("cap"), (F.col("target_share") * total).alias("goal"))
    total_of = rows.groupBy("source").agg(F.sum("tokens").alias("own"))
    first = F.least("cap", F.col("goal") / F.col("own"))
    w, seen = materialize_counted(rows.join(total_of, "source").select(*rows.columns, first.alias("weight"), first.alias("old")), "weights", all=F.sum("tokens"), cells=F.count("*"))
    if not seen["cells"] or not total:
        return Fit(w.select("source", "lang", "topic", "tokens", "weight").withColumn("weight", F.lit(0.0)), 0, True)
    reach = w.groupBy("source").agg(F.first("goal").alias("g")).agg(F.sum("g")).first()[0]  # one value

    def scaled(w: DataFrame, key: str, want, **observed) -> tuple[DataFrame, dict]:
        sums = w.groupBy(key).agg(F.sum(F.col("weight") * F.col("tokens")).alias("__now"), F.sum("tokens").alias("__size"))
        factor = want / F.greatest(F.col("__now"), F.lit(1e-200))
        both = w.join(sums, key).withColumn("__old", F.col("weight")).withColumn("weight", F.least("cap", F.col("weight") * factor)).withColumn("__moved", F.abs(F.col("weight") - F.col("__old")) / F.greatest(F.col("__old"), F.lit(1e-200)))
        out, seen = materialize_counted(both.select(*w.columns, "__moved"), "weights", moved=F.max("__moved"))
        discard(w)
        return _kept(out, w.columns), seen

    n, converged = 0, False
    while n < rounds and not converged:
        n += 1
        for k in ("topic", "lang"):
            w, _ = scaled(w, k, F.col("__size") / seen["all"] * reach)
        for _ in range(fills):
            w, off = scaled(w, "source", F.col("goal"))
            if off["moved"] < FILLED:  # there, or the caps allow no more
                break
        nxt, off = materialize_counted(w.withColumn("__c", F.abs(F.col("weight") - F.col("old")) / F.greatest("old", F.lit(1e-12))).withColumn("old", F.col("weight")), "weights", change=F.max("__c"))
        discard(w)
        w, converged = _kept(nxt, w.columns), off["change"] < tolerance
    return Fit(w.select("source", "lang", "topic", "tokens", "weight"), n, converged)


def _kept(df: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns of a frame from materialize(), which discard() still knows."""
    out = df.select(*columns)
    out._causeway_path = df._causeway_path
    return out


def fitted(docs: DataFrame, targets: DataFrame, total: float | None = None, most_cells: int = MAX_CELLS, **vocabulary) -> tuple[DataFrame, Fit, DataFrame, pd.DataFrame]:
    """(sizes, fit, weights as a frame, target table): the sized documents and the raked weights of their cells."""
    spark = docs.sparkSession
    sizes = sized(docs, **vocabulary)
    table = target_table(targets)
    wanted = F.broadcast(_frame(spark, table, "source string, target_share double, max_repeats int"))  # at most MAX_SOURCES rows
    cells = sizes.join(wanted, "source").groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    cells, seen = materialize_counted(cells, "cells", n=F.count("*"))
    tokens = {r["source"]: r["t"] for r in cells.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # at most MAX_SOURCES rows
    size = reachable_total(tokens, table) if total is None else total
    table["goal"] = table.target_share * size
    if seen["n"] <= most_cells:
        fit = rake(cells.toPandas(), table, size)  # at most most_cells rows
        weights = F.broadcast(_frame(spark, fit.weights, "source string, lang string, topic string, tokens long, weight double"))
    else:
        fit = rake_on_cluster(cells, wanted, size)
        weights = fit.weights
    return sizes, fit, weights, table


def _frame(spark, pdf: pd.DataFrame, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in pdf[names].itertuples(index=False)]
    return spark.createDataFrame(rows, schema)


def draw(docs: DataFrame, targets: DataFrame, total: float | None = None, most_cells: int = MAX_CELLS, **vocabulary) -> tuple[DataFrame, Fit]:
    """(doc_id, source, lang, topic, n_tokens, weight, copies) of every document of a targeted source with tokens, and the fit behind it; see mixture."""
    spark = docs.sparkSession
    sizes, fit, weights, table = fitted(docs, targets, total, most_cells, **vocabulary)
    u = (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("mixture")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    caps = F.broadcast(_frame(spark, table, "source string, max_repeats int, goal double").withColumnRenamed("max_repeats", "cap"))  # at most MAX_SOURCES rows
    drawn = materialize(sizes.where("n_tokens > 0").join(weights.drop("tokens"), ["source", "lang", "topic"]).join(caps, "source").withColumn("u", u), "drawn")
    copies = lambda scale: F.least(F.col("cap"), F.floor(F.col("weight") * scale + F.col("u"))).cast("long")
    sources = list(table.source)
    lo, hi = {s: 0.5 for s in sources}, {s: 2.0 for s in sources}
    best = {s: (float("inf"), 1.0) for s in sources}
    for _ in range(REFINEMENTS if sources else 0):
        grids = {s: np.linspace(lo[s], hi[s], GRID).tolist() for s in sources}
        grid = F.broadcast(spark.createDataFrame(list(grids.items()), "source string, grid array<double>"))
        sums = drawn.join(grid, "source").groupBy("source").agg(F.first("goal").alias("goal"), *[F.sum(copies(F.col("grid")[i]) * F.col("n_tokens")).alias(f"g{i}") for i in range(GRID)]).collect()  # a row per source
        for r in sums:
            s = r["source"]
            off = [abs(r[f"g{i}"] - r["goal"]) for i in range(GRID)]
            i = int(np.argmin(off))
            if off[i] < best[s][0]:
                best[s] = (off[i], grids[s][i])
            step = (hi[s] - lo[s]) / (GRID - 1)
            lo[s], hi[s] = max(0.0, best[s][1] - step), best[s][1] + step
    scales = spark.createDataFrame([(s, b[1]) for s, b in best.items()], "source string, scale double")
    return drawn.join(F.broadcast(scales), "source").select("doc_id", "source", "lang", "topic", "n_tokens", "weight", copies(F.col("scale")).alias("copies")), fit


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, most_cells: int = MAX_CELLS, **vocabulary) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document is used, for those used at all.

    The size of the mixture is `total` tokens, or the most at which every
    source that exists can give its share; either way a source never exceeds
    its cap, and one that cannot give its share gives all it may. Targeted
    sources without documents give nothing; documents of other or of no source
    are not used.

    Token weights are raked to the marginals of source, language and topic (see
    rake), on the driver up to `most_cells` cells and on the cluster beyond. A
    document's copies are its scaled weight rounded up or down by a number
    drawn from its id, so a repeated run gives the same mixture. The scale of
    each source is then calibrated: all documents are summed for a grid of
    scales at once, and the grid refined around the scale whose sampled size
    comes nearest to the goal.
    """
    drawn, _ = draw(docs, targets, total, most_cells, **vocabulary)
    return drawn.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def marginals(docs: DataFrame, targets: DataFrame, **vocabulary) -> DataFrame:
    """(marginal, value, goal_share, expected_share, actual_share, rounds, converged): how near the mixture comes to each marginal.

    goal_share: of a source its target among the sources that have documents,
    of a language or topic its share of the corpus; expected_share: by the
    raked weights; actual_share: by the copies drawn. rounds and converged tell
    how the raking ended.
    """
    drawn, fit = draw(docs, targets, **vocabulary)
    drawn = materialize(drawn, "drawn-copies")
    spark = docs.sparkSession
    share = _frame(spark, target_table(targets), "source string, target_share double")
    cells = drawn.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("weight") * F.col("n_tokens")).alias("expected"), F.sum(F.col("copies") * F.col("n_tokens")).alias("actual"))
    kinds = F.array(*[F.struct(F.lit(k).alias("marginal"), F.col(k).alias("value")) for k in ("source", "lang", "topic")])
    sums = cells.select(F.explode(kinds).alias("k"), "tokens", "expected", "actual").groupBy("k.marginal", "k.value").agg(*[F.sum(c).alias(c) for c in ("tokens", "expected", "actual")])
    sums = sums.join(F.broadcast(share.select(F.lit("source").alias("marginal"), F.col("source").alias("value"), "target_share")), ["marginal", "value"], "left")  # at most MAX_SOURCES rows
    sums = sums.withColumn("goal", F.when(F.col("marginal") == "source", F.col("target_share")).otherwise(F.col("tokens")))
    whole = sums.groupBy("marginal").agg(*[F.sum(c).alias(f"all_{c}") for c in ("goal", "expected", "actual")])  # three rows
    part = lambda c: F.coalesce(F.col(c) / F.nullif(F.col(f"all_{c}"), F.lit(0)), F.lit(0.0)).alias(f"{c}_share")
    return sums.join(F.broadcast(whole), "marginal").select("marginal", "value", part("goal"), part("expected"), part("actual"), F.lit(fit.rounds).alias("rounds"), F.lit(fit.converged).alias("converged"))


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, max_copies, max_repeats): what the mixture reached, per targeted source."""
    spark = mix.sparkSession
    table = _frame(spark, target_table(targets), "source string, target_share double, max_repeats int")
    got = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("max_copies"))
    got = got.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # a row per source
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return table.join(got, "source", "left").select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens"), zero("documents"), zero("max_copies"), "max_repeats"
    )
