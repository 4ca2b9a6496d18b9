"""Column-level quality profile of loads, kept as value-count tables under signed deltas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.text import strip
from causeway.session import discard, materialize, scratch_path

#: What a column may hold: the pattern of its text form and the closed range of its numbers.
Domain = dict  # {"pattern": regex or None, "low": number or None, "high": number or None}


def _as_text(col: Column, kind: str) -> Column:
    return col if kind == "string" else col.cast("string")


def fingerprinted(df: DataFrame, feed: str, load_no: str, columns: list[str], arrival: list[str] = []) -> DataFrame:
    """(feed, load_no, h1, h2, then the text forms of columns): the distinct rows of df, each named by 128 bits over all its columns but those in `arrival`."""
    kinds = dict(df.dtypes)
    own = [F.col(f"`{c}`") for c in sorted(df.columns) if c not in arrival]
    own = [c if not kinds[n].startswith(("map", "variant")) else F.to_json(c) for c, n in zip(own, (n for n in sorted(df.columns) if n not in arrival), strict=True)]
    marked = [x for c in own for x in (c.isNull(), c)]  # a hash passes over nulls, so their places are hashed too
    texts = [_as_text(F.col(f"`{c}`"), kinds[c]).alias(f"v{i}") for i, c in enumerate(columns)]
    rows = df.select(F.col(feed).alias("feed"), F.col(load_no).cast("long").alias("load_no"), F.xxhash64(*marked).alias("h1"), F.xxhash64(F.lit("second"), *marked).alias("h2"), *texts)
    return rows.dropDuplicates(["feed", "load_no", "h1", "h2"])


def counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feed, load_no, column_name, value, n): how often each value of each column comes in each load of fingerprinted() rows.

    value is the text form, null for null and blank. The columns are unfolded
    in the map stage and counted before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("value")) for i, c in enumerate(columns)])
    value = F.col("cell.value")
    return (
        rows.select("feed", "load_no", F.explode(cells).alias("cell"))
        .groupBy("feed", "load_no", F.col("cell.column_name").alias("column_name"), F.when(strip(value) != "", value).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def value_deltas(df: DataFrame, feed: str, load_no: str, columns: list[str]) -> DataFrame:
    """counted() of the distinct rows of df."""
    return counted(fingerprinted(df, feed, load_no, columns), columns)


_STORE = "feed string, load_no long, column_name string, value string, n long"
_ROWS = "feed string, load_no long, h1 long, h2 long, sign int"


class ValueCounts:
    """Persistent tables of value counts per feed, load and column, maintained by signed deltas.

    load() takes the rows of any number of loads, leaves out those that came
    before (in this batch or an earlier one), and appends for each load what it
    adds to the counts; retract() takes rows out again by negative counts. So a
    late row, a repeated one or a correction changes the counts of its load
    without any load being read again. Beside the counts the store keeps the
    128-bit names of the rows that are in. A batch is one folder, found by its
    name, so a batch that is run again takes the place of its first run.
    compact() folds everything into one generation; the older one is deleted
    only once the new one is complete, and until then stays the one that is
    read. One writer at a time.
    """

    def __init__(self, spark, path: str | None = None, arrival: list[str] = []) -> None:
        self.spark, self.path, self.arrival = spark, path or scratch_path(spark, "value-counts"), arrival

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self, path: str) -> list[str]:
        """The complete batches below path: those whose last file, _SUCCESS, is there."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if fs.exists(self._fs(f"{path}/{n}/_SUCCESS")[1]))

    def _generation(self) -> str:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [int(n[1:]) for n in names if n.startswith("g") and (n == "g0" or "base" in self._folders(f"{self.path}/{n}/counts"))]
        return f"{self.path}/g{max(done, default=0)}"

    def _read(self, what: str, schema: str, but: str | None = None) -> DataFrame | None:
        root = f"{self._generation()}/{what}"
        parts = [f"{root}/{n}" for n in self._folders(root) if n != but]
        return self.spark.read.schema(schema).parquet(*parts) if parts else None

    def _put(self, df: DataFrame, what: str, batch: str) -> DataFrame:
        path = f"{self._generation()}/{what}/{batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _inside(self, batch: str) -> DataFrame | None:
        """The names of the rows that are in, as the batches other than this one left them."""
        rows = self._read("rows", _ROWS, but=batch)
        return None if rows is None else rows.groupBy("feed", "load_no", "h1", "h2").agg(F.sum("sign").alias("s")).where("s > 0").drop("s")

    def load(self, df: DataFrame, feed: str, load_no: str, columns: list[str], batch: str | None = None, sign: int = 1) -> None:
        """Add the rows of df that are not in yet, load by load. batch: a name under which the same batch is known if it is run again."""
        batch = batch or uuid.uuid4().hex
        rows = fingerprinted(df, feed, load_no, columns, self.arrival)
        inside = self._inside(batch)
        key = ["feed", "load_no", "h1", "h2"]
        if inside is not None:
            same = [rows[c].eqNullSafe(inside[c]) for c in key]
            rows = rows.join(inside, same, "left_anti" if sign > 0 else "left_semi")
        elif sign < 0:
            return
        texts = [f"v{i}" for i in range(len(columns))]
        rows = materialize(rows.select(*key, *texts), "rows")
        # the counts first: a batch without its rows is not complete and is run again under its name
        self._put(counted(rows, columns).withColumn("n", F.col("n") * sign).select("feed", "load_no", "column_name", "value", "n"), "counts", batch)
        self._put(rows.select(*key, F.lit(sign).alias("sign")), "rows", batch)
        discard(rows)

    def retract(self, df: DataFrame, feed: str, load_no: str, columns: list[str], batch: str | None = None) -> None:
        """Take the rows of df that are in out again."""
        self.load(df, feed, load_no, columns, batch, -1)

    def deltas(self) -> DataFrame:
        """The signed counts as they were applied; whoever sums them needs no counts() first."""
        out = self._read("counts", _STORE)
        return self.spark.createDataFrame([], _STORE) if out is None else out

    def counts(self) -> DataFrame:
        return self.deltas().groupBy("feed", "load_no", "column_name", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def compact(self) -> None:
        old, inside, counts = self._generation(), self._inside(""), self.counts()
        new = f"{self.path}/g{int(old.rpartition('g')[2]) + 1}"
        rows = self.spark.createDataFrame([], _ROWS) if inside is None else inside.withColumn("sign", F.lit(1))
        rows.write.mode("overwrite").parquet(f"{new}/rows/base")
        counts.write.mode("overwrite").parquet(f"{new}/counts/base")  # with its last file the generation takes over
        fs, p = self._fs(old)
        fs.delete(p, True)


#: A text that is read as a number, beside the names doubles have for values that are none.
_NUMBER = r"\A(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|NaN|-?Infinity)\z"


def _judged(counts: DataFrame, domains: dict[str, Domain]) -> DataFrame:
    """counts with number (null where the text is none), bad_pattern, bad_range and status: null, bad or ok."""
    text = strip(F.col("value"))
    x = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    bad_pattern, bad_range = F.lit(False), F.lit(False)
    for name, d in domains.items():
        here = F.col("column_name") == name
        if d.get("pattern"):
            bad_pattern |= here & ~F.col("value").rlike(d["pattern"])
        out = F.isnan(x)
        out |= (x < d["low"]) if d.get("low") is not None else F.lit(False)
        out |= (x > d["high"]) if d.get("high") is not None else F.lit(False)
        bad_range |= here & out
    yes = lambda c: F.coalesce(c, F.lit(False))
    return counts.select("*", x.alias("number"), yes(bad_pattern).alias("bad_pattern"), yes(bad_range).alias("bad_range")).withColumn(
        "status", F.when(F.col("value").isNull(), "null").when(F.col("bad_pattern") | F.col("bad_range"), "bad").otherwise("ok")
    )


def _windowed(judged: DataFrame) -> DataFrame:
    """One row per (feed, load_no, column_name, status, flags, number) with the counts now and in the load before.

    Each count enters the window of its own load and, with the opposite sign,
    that of the load after, where it leaves: the deltas whose sum is the change
    between loads.
    """
    both = F.array(F.struct(F.col("load_no").alias("at"), F.col("n").alias("now"), F.lit(0).cast("long").alias("before")), F.struct((F.col("load_no") + 1).alias("at"), F.lit(0).cast("long").alias("now"), F.col("n").alias("before")))
    return (
        judged.select("feed", "column_name", "status", "bad_pattern", "bad_range", F.when(F.col("status") == "ok", F.col("number")).alias("number"), F.explode(both).alias("d"))
        .groupBy("feed", F.col("d.at").alias("load_no"), "column_name", "status", "bad_pattern", "bad_range", "number")
        .agg(F.sum("d.now").alias("now"), F.sum("d.before").alias("before"))
        .where("now <> 0 or before <> 0")
    )


def profile(counts: DataFrame, domains: dict[str, Domain]) -> DataFrame:
    """One row per (feed, load_no, column_name): rows, nulls, valid, distinct_valid, pattern_violations,
    range_violations, low, high, mean, entropy (bits, over the valid values), all exact and all read off the counts.

    Values are distinct as numbers where they are numbers. Empty input: no row.
    """
    ok = F.col("status") == "ok"
    per_value = _judged(counts, domains).groupBy("feed", "load_no", "column_name", "status", "bad_pattern", "bad_range", F.coalesce(F.col("number").cast("string"), F.col("value")).alias("v"), "number").agg(F.sum("n").alias("n"))
    agg = per_value.groupBy("feed", "load_no", "column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("status") == "null", F.col("n")).otherwise(0)).alias("nulls"),
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("valid"),
        F.sum(F.when(ok, 1).otherwise(0)).alias("distinct_valid"),
        F.sum(F.when(F.col("bad_pattern"), F.col("n")).otherwise(0)).alias("pattern_violations"),
        F.sum(F.when(F.col("bad_range"), F.col("n")).otherwise(0)).alias("range_violations"),
        F.min(F.when(ok, F.col("number"))).alias("low"),
        F.max(F.when(ok, F.col("number"))).alias("high"),
        F.sum(F.when(ok, F.col("number") * F.col("n"))).alias("__total"),
        F.sum(F.when(ok, F.col("n") * F.log2("n"))).alias("__nlogn"),
    )
    valid = F.when(F.col("valid") > 0, F.col("valid"))
    return agg.withColumn("mean", F.col("__total") / valid).withColumn("entropy", F.greatest(F.lit(0.0), F.log2(valid) - F.col("__nlogn") / valid)).drop("__total", "__nlogn")


#: Distinct values of two neighbouring loads that are sorted in one task at most, about.
BIN_ROWS = 50_000


def _largest_gap(windowed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(feed, load_no, column_name, gap, t_now, t_before): the largest difference, over x, of the numbers of valid values <= x, cross-multiplied.

    sizes: the same key, t_now, t_before and values, the number of distinct
    values. The running sums are taken in two levels: within bins of
    neighbouring numbers and over the bins of a key. The bins follow the
    leading bits of the number, ever finer with the key's size, so that no task
    sorts all values of a large load; a key of up to BIN_ROWS values is one bin.
    """
    key = ["feed", "load_no", "column_name"]
    x, fine = F.col("number"), F.ceil(F.col("values") / BIN_ROWS) * 64
    octave = F.floor(F.log2(F.abs(x)))
    # ordered like x: the octave, and inside it `fine` equal steps
    place = octave * fine + F.floor((F.abs(x) / F.pow(F.lit(2.0), octave) - 1) * fine) + 1100 * fine
    rows = windowed.where("status = 'ok'").select(*key, "number", "now", "before").join(sizes, key)
    binned = rows.withColumn("bin", F.when((F.col("values") <= BIN_ROWS) | (x == 0), 0.0).otherwise(F.signum(x) * place))
    per_bin = binned.groupBy(*key, "bin").agg(F.sum("now").alias("bin_now"), F.sum("before").alias("bin_before"))
    over_bins = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bin.select(*key, "bin", *[F.coalesce(F.sum(f"bin_{c}").over(over_bins), F.lit(0)).alias(f"s_{c}") for c in ("now", "before")])
    within = Window.partitionBy(*key, "bin").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    run = binned.select(*key, "bin", "t_now", "t_before", F.sum("now").over(within).alias("r_now"), F.sum("before").over(within).alias("r_before"))
    # within a bin the gap is largest at its largest or smallest running difference, so a bin gives one row
    diff = F.col("r_now") * F.col("t_before") - F.col("r_before") * F.col("t_now")
    ends = run.groupBy(*key, "bin", "t_now", "t_before").agg(F.max(diff).alias("up"), F.min(diff).alias("down"))
    start = F.col("s_now") * F.col("t_before") - F.col("s_before") * F.col("t_now")
    # whole counts are compared, so a threshold is met exactly where it is met
    gap = F.greatest(F.abs(start + F.col("up")), F.abs(start + F.col("down")))
    return ends.join(starts, [*key, "bin"]).groupBy(*key, "t_now", "t_before").agg(F.max(gap).alias("gap"))


def load_issues(
    counts: DataFrame, domains: dict[str, Domain], null_rate: float = 0.2, distinct: float = 0.5, shift: float = 0.35, least: int = 20
) -> DataFrame:
    """(feed, load_no, column_name, issue): loads whose column breaks its domain or differs from the load before.

    pattern, range: the load has a value outside the column's domain. Against
    the feed's load_no - 1, where it exists: null_rate (the shares of nulls
    differ by `null_rate` or more), distinct (distinct valid / valid is less
    than `distinct` times what it was; 0 without valid values), shift (both
    have `least` valid values and the shares of valid values <= x differ by
    `shift` or more for some x). Values are distinct as numbers. Empty input:
    no row. Rows with a null feed or load_no belong to no load and are left out.
    """
    key = ["feed", "load_no", "column_name"]
    judged = _judged(counts.where("feed is not null and load_no is not null"), domains)
    win = materialize(_windowed(judged), "load-windows")  # read for the sums and for the gaps
    of = lambda status, side: F.sum(F.when(F.col("status") == status, F.col(side)).otherwise(0))
    some = lambda side: F.sum(F.when((F.col("status") == "ok") & (F.col(side) > 0), 1).otherwise(0))
    sums = materialize(win.groupBy(*key).agg(
        F.sum("now").alias("rows_now"), F.sum("before").alias("rows_before"),
        of("null", "now").alias("null_now"), of("null", "before").alias("null_before"),
        of("ok", "now").alias("ok_now"), of("ok", "before").alias("ok_before"),
        some("now").alias("d_now"), some("before").alias("d_before"),
        F.sum(F.when(F.col("bad_pattern"), F.col("now")).otherwise(0)).alias("pattern_n"), F.sum(F.when(F.col("bad_range"), F.col("now")).otherwise(0)).alias("range_n"),
        F.count_if(F.col("status") == "ok").alias("values"),
    ).where("rows_now > 0"), "load-sums")
    sizes = sums.where((F.col("ok_now") >= least) & (F.col("ok_before") >= least)).select(*key, F.col("ok_now").alias("t_now"), F.col("ok_before").alias("t_before"), "values")
    gaps = _largest_gap(win, sizes).where(F.col("gap") >= F.lit(shift) * F.col("t_now") * F.col("t_before") - 1e-6)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    had = F.col("rows_before") > 0
    flags = {
        "pattern": F.col("pattern_n") > 0,
        "range": F.col("range_n") > 0,
        "null_rate": had & (F.abs(share("null_now", "rows_now") - share("null_before", "rows_before")) >= null_rate - 1e-12),
        "distinct": had & (share("d_now", "ok_now") < distinct * share("d_before", "ok_before") - 1e-12),
    }
    found = sums.select(*key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))).alias("issue"))
    return found.unionByName(gaps.select(*key, F.lit("shift").alias("issue")))


#: The domains of the profiled columns of metrics.
METRICS_DOMAINS = {
    "solve_rate": {"low": 0, "high": 1},
    "atom_count": {"pattern": r"\A[+-]?[0-9]+\z", "low": 0},
    "regulations_confirmed": {"low": 0},
}
