"""Edge cases of the operators of the general problems: nulls, empties, ties, repeats, clashing columns, hot keys."""

import datetime as dt
import json
import random
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from causeway.operators import drift, flatten, hierarchy, orphans, pivot, profile, timestamps
from causeway.skew import hot_keys, salted_join
from conftest import DATA
from pyspark.sql import functions as F

T0 = dt.datetime(2025, 1, 1)


def as_set(df):
    return {tuple(r) for r in df.collect()}


# -- 1


def chain(spark, rows):
    return spark.createDataFrame([(i, p, T0 + dt.timedelta(days=n), T0) for n, (i, p) in enumerate(rows)], "id string, up string, v timestamp, arrived_at timestamp")


def found(df):
    return as_set(hierarchy.hierarchy_found(df, "id", "up", "v", "arrived_at").select("id", "root_id", "depth"))


def test_hierarchy_cases(spark):
    df = chain(spark, [("a", "b"), ("b", " B/c.json "), ("c", "null"), ("d", "gone"), ("x", "y"), ("y", "x"), ("t", "x"), ("s", "s"), (None, "a"), ("e", ""), ("f", None), ("a", "b")])
    assert found(df) == {("a", "c", 2), ("b", "c", 1), ("x", "x", -1), ("y", "x", -1), ("t", "x", -1), ("s", "s", -1)}


def test_hierarchy_empty_and_latest(spark):
    assert found(chain(spark, [])) == set()
    assert found(chain(spark, [("a", "b"), ("b", None), ("a", None)])) == set()  # the latest row of a has no parent


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_walk(spark, seed):
    rng = random.Random(seed)
    n = 120
    up = {f"n{i:03d}": (f"n{rng.randrange(n):03d}" if rng.random() < 0.9 else None) for i in range(n)}
    want = set()
    for i, p in up.items():
        if p is None:
            continue
        seen, x = [], i
        while x is not None and x not in seen:
            seen.append(x)
            x = up[x]
        want.add((i, seen[-1], len(seen) - 1) if x is None else (i, min(seen[seen.index(x):]), -1))
    assert found(chain(spark, list(up.items()))) == want


def test_long_chain(spark):
    n = 300
    df = chain(spark, [(f"k{i:03d}", f"k{i + 1:03d}" if i < n - 1 else None) for i in range(n)])
    edge = hierarchy.edges(df, "id", "up")
    out = {r["id"]: r for r in hierarchy.roots_and_depths(edge, with_path=True).collect()}
    assert out["k000"]["depth"] == n - 1 and out["k000"]["path"] == [f"k{i:03d}" for i in range(n)]
    assert hierarchy.descendants(edge).count() == n * (n - 1) // 2


# -- 2


def test_profile_cases(spark):
    rows = [("f", 1, None if i < 5 else i / 100, str(i)) for i in range(40)] + [("f", 2, float("nan") if i == 0 else (None if i < 20 else 1.5), " " if i < 3 else "x1") for i in range(40)] + [(None, 1, 0.5, "1"), ("f", None, 0.5, "1")]
    df = spark.createDataFrame(rows, "feed string, load_no int, solve_rate double, atom_count string")
    store = profile.ValueCounts(spark)
    store.load(df, "feed", "load_no", ["solve_rate", "atom_count"])
    domains = {k: profile.METRICS_DOMAINS[k] for k in ("solve_rate", "atom_count")}
    got = as_set(profile.load_issues(store.counts(), domains))
    assert ("f", 2, "solve_rate", "range") in got and ("f", 2, "atom_count", "pattern") in got and ("f", 2, "solve_rate", "null_rate") in got
    assert ("f", 2, "solve_rate", "distinct") in got
    assert not [r for r in got if r[1] == 1]


def test_counts_are_kept_over_loads(spark, tmp_path):
    """Loads, late and repeated rows and a correction reach the same counts as one reading of what is left."""
    shape = "feed string, load_no int, x double, note string, arrived_at timestamp"
    row = lambda n, x, note=None, day=0: ("f", n, x, note, T0 + dt.timedelta(days=day))
    batches = [[row(1, 0.5), row(1, 0.5), row(1, 0.5, "b"), row(1, None)], [row(2, 0.7), row(1, 0.5), row(1, 0.9)], [row(2, 0.7, "late")]]
    store = lambda: profile.ValueCounts(spark, str(tmp_path / "s"))  # a new object finds what is there
    load = lambda rows, **kw: store().load(spark.createDataFrame(rows, shape), "feed", "load_no", ["x", "note"], **kw)
    for i, b in enumerate(batches):
        load(b, batch=f"b{i}")
    load(batches[1], batch="b1")  # run again
    whole = lambda rows: as_set(profile.value_deltas(spark.createDataFrame(rows, shape), "feed", "load_no", ["x", "note"]))
    flat = [r for b in batches for r in b]
    assert as_set(store().counts()) == whole(flat)
    wrong = [row(1, 0.9), row(1, 7.0), row(2, 0.7)]  # the second was never in
    store().retract(spark.createDataFrame(wrong, shape), "feed", "load_no", ["x", "note"])
    left = [r for r in flat if r not in wrong]
    assert as_set(store().counts()) == whole(left) and store().deltas().where("n < 0").count() > 0
    store().compact()
    load([row(2, 0.7, "late"), row(1, 0.9)])
    assert as_set(store().counts()) == whole([*left, row(1, 0.9)])
    assert profile.ValueCounts(spark).counts().count() == 0
    spark.createDataFrame([("f", 1, "x", "9", 1)], profile._STORE).write.parquet(f"{store().path}/g2/half")  # a compaction that broke off
    assert as_set(store().counts()) == whole([*left, row(1, 0.9)])


def test_nulls_in_rows_do_not_run_together(spark):
    df = spark.createDataFrame([("f", 1, None, "a"), ("f", 1, "a", None), ("f", 1, "a", None)], "feed string, load_no int, x string, y string")
    assert profile.fingerprinted(df, "feed", "load_no", ["x"]).count() == 2
    late = profile.ValueCounts(spark, arrival=["y"])
    late.load(df, "feed", "load_no", ["x"])
    assert late.counts().agg(F.sum("n")).first()[0] == 2


def test_shift_in_bins_equals_one_bin(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("f", 1, rng.gauss(0, 1)) for _ in range(300)] + [("f", 2, rng.gauss(0.9, 1)) for _ in range(300)] + [("f", 2, 0.0), ("f", 1, -0.0)]
    df = spark.createDataFrame(rows, "feed string, load_no int, x double")
    win = profile._windowed(profile._judged(profile.value_deltas(df, "feed", "load_no", ["x"]), {"x": {}}))
    sizes = spark.createDataFrame([("f", 2, "x", 301, 301, 602)], "feed string, load_no long, column_name string, t_now long, t_before long, values long")
    one = profile._largest_gap(win, sizes).first()["gap"]
    monkeypatch.setattr(profile, "BIN_ROWS", 10)
    assert profile._largest_gap(win, sizes).first()["gap"] == one
    a, b = sorted(r[2] for r in rows if r[1] == 2), sorted(r[2] for r in rows if r[1] == 1)
    assert one == max(abs(sum(v <= x for v in a) * len(b) - sum(v <= x for v in b) * len(a)) for x in a + b)


# -- 3

TYPES = [(" Num ", "number"), ("flag", "boolean"), ("txt", "text")]


def cells_of(spark, facts):
    df = spark.createDataFrame([(o, [None if f is None else (f[0], f[1], None) for f in fs] if fs is not None else None) for o, fs in facts], "observation_id string, facts array<struct<pred:string,value:string,args:map<string,string>>>")
    types = pivot.type_list(spark.createDataFrame(TYPES, "pred string, value_type string"), "pred", "value_type")
    return pivot.cells(pivot.long_facts(df, "observation_id", "facts"), types), types, df


def facts_of(df):
    return pivot.long_facts(df, "observation_id", "facts")


@pytest.mark.parametrize(
    "pred,value,fits",
    [("num", "49", True), ("num", '" +1,234.5e1 "', True), ("num", '"1,23"', False), ("num", "true", False), ("num", '"nan"', False), ("num", '"5%"', False), ("num", '""', False), ("num", '"1234,567"', False),
     ("flag", '" YES "', True), ("flag", "1", True), ("flag", "1.0", True), ("flag", "2", False), ("flag", '"-1"', False), ("flag", '"truee"', False),
     ("txt", "3", True), ("txt", '"a\\"b"', True), ("txt", "{broken", False), ("unlisted", "true", True)],
)
def test_typing(spark, pred, value, fits):
    cell, _, _ = cells_of(spark, [("o", [(pred, value)])])
    assert cell.first()["fits"] == int(fits) and cell.first()["misfits"] == int(not fits)


def test_pivot_conflicts_and_gaps(spark):
    cell, types, df = cells_of(spark, [
        ("a", [("NUM", "49"), (" num", '"4.9e1"'), ("flag", "true"), ("flag", '"no"'), None, ("txt", "null"), (None, "1")]), ("b", []), ("c", None), (None, [("num", "1")]), ("d", [("num", '"x"'), ("num", "7"), ("new one", '"v"')]), ("d", [("num", '"x"')]),
    ])
    attrs = pivot.discover(facts_of(df), types)
    assert as_set(pivot.issues(pivot.wide(cell, attrs))) == as_set(pivot.issues(pivot.wide(cell, attrs[:1]))) == {("a", "flag", "conflict"), ("d", "num", "untyped")}
    assert attrs == [("flag", "boolean"), ("num", "number"), ("txt", "text"), ("new one", "text")]
    wide = {r["entity"]: r for r in pivot.wide(cell, attrs, df.select(F.col("observation_id").alias("entity"))).collect()}
    assert set(wide) == {"a", "b", "c", "d"} and wide["a"]["num"] == 49.0 and wide["a"]["flag"] is None and wide["d"]["new_one"] == "v" and wide["d"]["untyped"] == ["num"] and wide["d"]["num"] == 7.0 and wide["a"]["conflict"] == ["flag"]
    assert as_set(pivot.long_again(pivot.wide(cell, attrs), attrs)) == as_set(pivot.long_again(pivot.wide(cell, attrs[:1]), attrs[:1])) == {("a", "num", "49.0"), ("d", "num", "7.0"), ("d", "new one", "v")}
    few = {r["entity"]: r for r in pivot.wide(cell, attrs[:1]).collect()}
    assert few["d"]["other"] == {"num": "7.0", "new one": "v"}


def test_pivot_empty(spark):
    cell, types, df = cells_of(spark, [])
    assert cell.count() == 0 and pivot.wide(cell, pivot.discover(facts_of(df), types)).count() == 0


# -- 4

CLOCK = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("no", None, "ymd")]


def micros(text, client="no"):
    zone, order = next((z, o) for c, z, o in CLOCK if c == client)
    r = timestamps.to_micros(pd.Series([text]), pd.Series([zone]), pd.Series([order]))
    return None if pd.isna(r[0]) else int(r[0])


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1e6)


@pytest.mark.parametrize(
    "text,client,want",
    [("2025-01-01T00:00:00z", "no", utc(2025, 1, 1)), ("2025-01-01 02:00:00 Europe/Berlin", "ny", utc(2025, 1, 1, 1)), ("1735689600", "ny", utc(2025, 1, 1)), ("1735689600.250", "ny", utc(2025, 1, 1) + 250_000),
     ("1735689600123", "ny", utc(2025, 1, 1) + 123_000), ("1735689600123456", "ny", utc(2025, 1, 1) + 123_456), ("20250101000000", "be", utc(2024, 12, 31, 23)), ("01/02/2025 1:00:00 PM", "ny", utc(2025, 1, 2, 18)),
     ("01.02.2025 13:00:00", "be", utc(2025, 2, 1, 12)), ("Wed, 01 Jan 2025 02:00:00 +0200", "ny", utc(2025, 1, 1)), ("Jan 1, 2025 12:30:00 AM", "no", utc(2025, 1, 1, 0, 30)), ("2025-01-01T05:30+05:30[Asia/Kolkata]", "ny", utc(2025, 1, 1)),
     ("2025/01/01 09:15", "no", utc(2025, 1, 1, 9, 15)), ("2025-11-02 01:30:00", "ny", utc(2025, 11, 2, 5, 30)), ("2025-03-09 02:30:00", "ny", utc(2025, 3, 9, 7, 30)), ("2025-01-01T00:00:00.1234567", "no", utc(2025, 1, 1) + 123_456),
     (" " * 250 + "2025-01-01 00:00:00\n", "no", utc(2025, 1, 1)), ("2025-01-01T00:00:00." + "5" * 300, "no", utc(2025, 1, 1) + 555_555), ("2150-07-01 10:00", "be", utc(2150, 7, 1, 8)), ("9150-01-01 10:00:00", "be", utc(9150, 1, 1, 9)),
     ("2025-02-30 00:00:00", "no", None), ("2025-13-01T00:00:00", "no", None), ("2025-01-01 00:32:34 GMT", "ny", utc(2025, 1, 1, 0, 32, 34)), ("2025-01-01 00:32:34 UTC", "be", utc(2025, 1, 1, 0, 32, 34)), ("2025-01-01 1:32:34 PM Z", "be", utc(2025, 1, 1, 13, 32, 34)), ("n/a", "no", None), ("", "no", None), (None, "no", None), ("x" * 100_000, "no", None), ("123456789", "no", None), ("2025-01-01 00:00:00 Mars/Base", "no", None), ("13/01/2025 10:00:00", "be", utc(2025, 1, 13, 9))],
)
def test_notations(text, client, want):
    assert micros(text, client) == want


def test_zone_tables_against_zoneinfo():
    rng, zero = random.Random(5), dt.datetime(1970, 1, 1)
    tables = timestamps.zone_tables()
    for name in ("America/St_Johns", "Asia/Kathmandu", "Australia/Sydney", "America/Sao_Paulo", "Pacific/Apia", "Europe/London", "America/Nuuk", "Africa/Casablanca", "Europe/Dublin", "Etc/GMT+5"):
        zone = ZoneInfo(name)
        walls = [dt.datetime(1890, 1, 1) + dt.timedelta(seconds=rng.randrange(0, span * 365 * 86400)) for span in (150, 600, 8000) for _ in range(200)]
        got = tables.offsets(name.lower(), np.array([int((w - zero).total_seconds()) for w in walls]))
        assert [int(w.replace(tzinfo=zone, fold=0).utcoffset().total_seconds()) for w in walls] == got.tolist()


def test_zone_tables_keep_their_version(spark, tmp_path):
    tables = timestamps.zone_tables()
    tables.save(spark, str(tmp_path / "z"))
    back = timestamps.ZoneTables.load(spark, str(tmp_path / "z"), tables.version)
    assert back.version == tables.version and back.zones.keys() == tables.zones.keys()
    # a version with another rule converts by that rule
    other = timestamps.ZoneTables("own", {"own/zone": (np.array([-(2**62)]), np.array([3600]))})
    df = spark.createDataFrame([("a", "2025-01-01 00:00:00", None)], "client string, t string, zone_data string")
    clients = spark.createDataFrame([("a", "Own/Zone", "ymd")], "client string, zone string, date_order string")
    r = timestamps.normalised(df, ["t"], clients, other).first()
    assert r["t_utc_micros"] == utc(2024, 12, 31, 23) and r["zone_data"] == "own"


def test_uncanonical_frame(spark):
    df = spark.createDataFrame([("a", "ny", "2025-01-01 00:00:00", "extra"), ("a", "ny", "2025-01-01 00:00:00", "extra"), ("b", "zz", "1735689600", None), ("c", None, "2025-01-01T00:00:00Z", None), (None, "ny", "1735689600", None), ("d", "ny", None, None)], "id string, client string, t string, zone string")
    clients = spark.createDataFrame(CLOCK, "client string, zone string, date_order string")
    got = as_set(timestamps.uncanonical_instants(df, "s", "id", ["t"], clients))
    assert got == {("s", "a", "t", utc(2025, 1, 1, 5)), ("s", "b", "t", utc(2025, 1, 1))}


# -- 5


def test_orphan_cases(spark):
    ref = (orphans.Reference("child", "p", "parent"),)
    day = lambda n: T0 + dt.timedelta(days=n)
    parent = spark.createDataFrame([("P1", day(0), None), ("P2", day(0), day(5)), ("P3", day(9), None), ("P3", day(12), None), (None, day(0), None)], "id string, arrived_at timestamp, deleted_at timestamp")
    child = spark.createDataFrame([(k, p, day(n)) for k, p, n in [("a", " x/p1.JSON ", 1), ("b", "P2", 5), ("c", "P2", 4), ("d", "P3", 8), ("e", "nope", 40), ("f", "null", 1), ("g", "", 1), ("h", None, 1), ("e", "nope", 1), (None, "nope", 1)]], "id string, p string, arrived_at timestamp")
    assert as_set(orphans.orphans({"parent": parent, "child": child}, ref)) == {("child", "b", "p", "deleted", "2025-01"), ("child", "d", "p", "late", "2025-01"), ("child", "e", "p", "missing", "2025-01")}
    assert orphans.orphans({"parent": parent.limit(0), "child": child.limit(0)}, ref).count() == 0


def test_salted_join_equals_join(spark, monkeypatch):
    left = spark.range(4000).select(F.when(F.col("id") < 2000, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).cast("long").alias("k"), F.col("id").alias("v"))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = hot_keys(left, ["k"], least=100)
    assert hot.count() == 1
    for how in ("inner", "left", "leftsemi"):
        assert sorted(map(tuple, salted_join(left, right, ["k"], how, hot=hot).fillna(-1).collect())) == sorted(map(tuple, left.join(right, "k", how).select(*left.columns, *(["w"] if how != "leftsemi" else [])).fillna(-1).collect()))


# -- 6

CONTRACT = [("m", "run_id", "runId", "string"), ("m", "n_items", "items_total", "number"), ("m", "parts", "parts", "array")]


def files_of(spark, bodies):
    return spark.createDataFrame([(f"f{i}", line, "m", b, T0, body) for i, (line, b, body) in enumerate(bodies)], "file_name string, export_line string, artifact_kind string, batch_no int, captured_at timestamp, body string")


def test_schema_changes(spark):
    contract = spark.createDataFrame(CONTRACT, "artifact_kind string, canonical_field string, accepted_name string, json_type string")
    files = files_of(spark, [
        ("l", 1, '{"runId": "a", "n_items": 1, "parts": [{"Name": 1}], "old": null}'), ("l", 2, '{"run_id": "a", "items-total": "1", "parts": [{"Name": 1, "new": [[{"x": 1}]]}]}'), ("l", 3, "{damaged"), ("l", 5, "{}"), (None, 1, "{}"), ("q", 1, None), ("q", 2, '{"a": 1}'), ("q", 2, '{"a": 1}'),
    ])
    got = as_set(drift.schema_changes(files, contract))
    assert got == {("l", "m", 2, "run_id", "renamed"), ("l", "m", 2, "n_items", "renamed"), ("l", "m", 2, "n_items", "retyped"), ("l", "m", 2, "old", "removed"), ("l", "m", 2, "parts.new", "added"), ("l", "m", 2, "parts.new.x", "added"),
                   ("l", "m", 3, "run_id", "removed"), ("l", "m", 3, "n_items", "removed"), ("l", "m", 3, "parts", "removed"), ("l", "m", 3, "parts.name", "removed"), ("l", "m", 3, "parts.new", "removed"), ("l", "m", 3, "parts.new.x", "removed"), ("q", "m", 2, "a", "added")}
    assert drift.schema_changes(files.limit(0), contract).count() == 0
    table = {r["file_name"]: r for r in drift.conform(files, contract, "m").collect()}
    assert table["f1"]["run_id"] == "a" and table["f1"]["n_items"] == 1.0 and "n_items: cast string to number" in table["f1"]["steps"] and table["f2"]["steps"] == ["damaged"]
    assert "run_id, batch 2: rename runId to run_id" in table["f0"]["steps"] and table["f0"]["run_id"] == "a" and table["f0"]["n_items"] == 1.0


@pytest.mark.parametrize("value,kind,want", [("1_000", "number", None), ("1,2", "number", None), ("1,200", "number", 1200), ("9007199254740993", "number", 9007199254740993), (" 1e3 ", "number", 1000.0), ("inf", "number", None), (True, "number", 1), ("Yes", "boolean", True), (2, "boolean", None), (5, "string", "5"), (True, "string", "true"), (None, "number", None), ("x", "array", ["x"]), ("x", "object", None)])
def test_casts(value, kind, want):
    got = drift._cast(value, kind)
    assert (None if got is drift._LOST else got) == want


def test_chain_of_steps(spark):
    """A field that is renamed twice and changes its type to and fro; what cannot be undone is kept."""
    contract = spark.createDataFrame([("m", "size", "sizeTotal", "number"), ("m", "size", "SIZE", "number"), ("m", "tag", "tag", "string")], "artifact_kind string, canonical_field string, accepted_name string, json_type string")
    files = files_of(spark, [("l", 1, '{"sizeTotal": 7, "tag": "yes"}'), ("l", 2, '{"SIZE": "8", "tag": true}'), ("l", 3, '{"size": 9007199254740993, "tag": "no", "x": 1}'), ("l", 3, '{"size": "many"}'), (None, 1, '{"SIZE": "4"}')])
    rows = {r["file_name"]: r for r in drift.conform(files, contract, "m").collect()}
    assert [rows[f"f{i}"]["size"] for i in range(5)] == [7.0, 8.0, 9007199254740992.0, None, 4.0]
    assert rows["f0"]["tag"] == "yes" and "tag, batch 2: kept string" in rows["f0"]["steps"] and [x for x in rows["f0"]["steps"] if "size, batch" in x] == ["size, batch 2: rename sizeTotal to SIZE", "size, batch 2: cast number to string", "size, batch 3: rename SIZE to size"]
    assert rows["f2"]["extra"] == {"x": "1", "size": "9007199254740993"} and rows["f3"]["extra"] == {"size": '"many"'} and "size: lost string" in rows["f3"]["steps"]


def test_schema_store_grows_by_batches(spark, tmp_path):
    contract = spark.createDataFrame(CONTRACT, "artifact_kind string, canonical_field string, accepted_name string, json_type string")
    files = files_of(spark, [("l", 1, '{"runId": "a"}'), ("l", 2, '{"run_id": "a"}'), ("l", 2, '{"run_id": "b"}')])
    store = drift.SchemaStore(spark, str(tmp_path / "s"))
    assert drift.schema_changes(files.where("batch_no = 1"), contract, store).count() == 0
    assert as_set(drift.schema_changes(files.where("batch_no = 2"), contract, store)) == {("l", "m", 2, "run_id", "renamed")}
    assert store.versions().count() == 2


def brute_changes(files, names):
    def paths(x, prefix=""):
        if isinstance(x, dict):
            for k, v in x.items():
                s = drift.stripped(k)
                p = prefix + names.get(s, s)
                yield p, k, {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object", type(None): None}[type(v)]
                yield from paths(v, p + ".")
        elif isinstance(x, list):
            for v in x:
                yield from paths(v, prefix)

    by = {}
    for r in files:
        by.setdefault((r.export_line, r.artifact_kind, r.batch_no), set()).update((r.artifact_kind, *p) for p in paths(json.loads(r.body)))
    out = set()
    for (line, kind, b), now in by.items():
        if (line, kind, b - 1) not in by:
            continue
        before = by[line, kind, b - 1]
        f = lambda s, i: {p: {x[i] for x in s if x[1] == p} - {None} for p in {x[1] for x in s}}
        k1, k0, t1, t0 = f(now, 2), f(before, 2), f(now, 3), f(before, 3)
        for p in k1.keys() | k0.keys():
            if p not in k0:
                out.add((line, kind, b, p, "added"))
            elif p not in k1:
                out.add((line, kind, b, p, "removed"))
            else:
                out |= {(line, kind, b, p, "renamed")} if k1[p] != k0[p] else set()
                out |= {(line, kind, b, p, "retyped")} if t1[p] != t0[p] and t1[p] and t0[p] else set()
    return out


def test_schema_changes_brute(spark):
    files, contract = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("raw_artifacts", "contract_fields"))
    names, _ = drift.contract_map(contract)
    want = set()
    for kind in names:
        want |= brute_changes(files.where(F.col("artifact_kind") == kind).collect(), names[kind])
    assert as_set(drift.schema_changes(files, contract)) == want


# -- 7


def test_flatten_typed(spark):
    df = spark.createDataFrame([("a", [("p", {"x": "1"}), None, ("q", None)], ("z", ("w", 3))), ("b", None, None), ("c", [], (None, None)), (None, [("p", None)], None)], "id string, fs array<struct<pred:string,args:map<string,string>>>, ctx struct<s:string,r:struct<n:string,l:int>>")
    got = {(r.tag, r.pk, r.parent_pk, r.ord, r.payload) for r in flatten.tagged_rows(df, "id").collect()}
    assert ("fs", "a/fs/2", "a", 2, '{"pred":"q"}') in got and ("fs.args", "a/fs/0/args/0", "a/fs/0", 0, '{"key":"x","value":"1"}') in got
    assert ("ctx.r", "a/ctx/r", "a/ctx", 0, '{"n":"w","l":3}') in got and not [r for r in got if r[1].startswith("b") or r[1].startswith("a/fs/1")]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [("p", {"x": "1"}), ("q", None)])], "id string, fs array<struct<pred:string,args:map<string,string>>>")
    flatten.write_tables(flatten.tagged_rows(df, "id"), str(tmp_path / "t"))
    assert as_set(flatten.read_table(spark, str(tmp_path / "t"), "fs", "pred string").select("parent_pk", "ord", "pred")) == {("a", 0, "p"), ("a", 1, "q")}


def test_keys_with_slashes(spark):
    """Paths that would run together stay apart, and a root array is the parent of its elements."""
    data = spark.createDataFrame([("k/1", '{"p/q": {"a": 1}, "p": {"q": {"a": 2}}}'), ("k", '[[1], {"b": 2}]'), ("e", "[]"), ("s", '"x"')], "id string, data string")
    rows = flatten.tagged_json(data, "id", "data").collect()
    assert len({r["pk"] for r in rows}) == len(rows)
    own = {r["pk"] for r in rows}
    assert all(r["parent_pk"] in own or r["parent_pk"] in ("k~11", "k", "e", "s") for r in rows) and ("data", "k/data", "k") in {(r["tag"], r["pk"], r["parent_pk"]) for r in rows}
    df = spark.createDataFrame([("a/fs/0", [("p",)]), ("a", [("q",), ("r",)]), ("~1", [("s",)])], "id string, fs array<struct<pred:string>>")
    got = flatten.tagged_rows(df, "id")
    assert got.select("pk").distinct().count() == 4 and {r[0] for r in got.select(flatten.unescaped(F.col("parent_pk"))).collect()} == {"a/fs/0", "a", "~1"}


def test_leaves_keep_odd_keys(spark):
    obs = spark.createDataFrame([("a/context", [("p", None), None], (("x", None), None)), ("~0", None, (None, {"env.os": "y"}))], "observation_id string, facts array<struct<pred:string,args:map<string,string>>>, context struct<env:struct<os:string,arch:string>,extra:map<string,string>>")
    reg = spark.createDataFrame([("r/1", T0, T0, '{"pattern": {"pre": [{"pred": "z"}]}}')], "regulation_id string, updated_at timestamp, arrived_at timestamp, data string")
    assert as_set(flatten.flat_leaves(obs, reg)) == {("observations", "a/context", "facts", 0, "p"), ("observations", "a/context", "context.env.os", 0, "x"), ("observations", "~0", "context.env.os", 0, "y"), ("regulations", "r/1", "pattern.pre", 0, "z")}


def test_preconditions(spark):
    deep = '{"pred":"d"}'
    for _ in range(300):
        deep = "[" + deep + "]"
    data = ['{"pattern":{"pre":{"all":[{"pred":"a"},{"pred":1},{"x":{"pred":"b","pred2":[{"pred":"c"}]}}]}}}', '{"pattern":"{\\"pre\\":\\"[{\\\\\\"pred\\\\\\":\\\\\\"s\\\\\\"}]\\"}"}', "{broken", None, "[]", '{"pattern":{"pre":' + deep + "}}", '{"pattern":{"pre":NaN}}']
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(data)], "id string, data string")
    got = flatten.tagged_json(df, "id", "data", ("pattern", "pre")).where("tag = 'pattern.pre'").select("parent_pk", "ord", F.get_json_object("payload", "$.pred"))
    assert as_set(got) == {("0", 0, "a"), ("0", 1, "b"), ("0", 2, "c"), ("1", 0, "s"), ("5", 0, "d")}


def test_leaves_of_copies_and_forms(spark):
    obs = spark.read.parquet(f"{DATA}/observations.parquet")
    reg = spark.read.parquet(f"{DATA}/regulations.parquet")
    once = as_set(flatten.flat_leaves(obs, reg))
    assert once == as_set(flatten.flat_leaves(obs.unionByName(obs), reg.unionByName(reg)))
    assert flatten.flat_leaves(obs.limit(0), reg.limit(0)).count() == 0
