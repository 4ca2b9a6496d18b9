"""Files and streams."""

import datetime as dt

from causeway.operators import profile
from causeway.sources import files
from causeway.streaming import ingest
from conftest import DATA
from pyspark.sql import functions as F


def test_export_import(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, seq int, v string")
    files.export_tables({"t": spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], base.schema)}, str(tmp_path))
    got = {tuple(r) for r in files.import_table(base, str(tmp_path / "t"), "id", "seq").select("id", "v").collect()}
    assert got == {("a", "z"), ("b", "y"), ("c", "w")}


def test_append_once(spark, tmp_path):
    log = str(tmp_path / "log")
    files.append_once(spark.createDataFrame([("a",), ("a",), ("b",)], "id string"), log, "id")
    files.append_once(spark.createDataFrame([("b",), ("c",)], "id string"), log, "id")
    assert sorted(r.id for r in spark.read.parquet(log).collect()) == ["a", "b", "c"]


def test_observations_from_json(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"observation_id":"a","facts":[{"pred":"p","value":"1"}]}\n{"observation_id":"","facts":[{"pred":" "}]}\n{"facts":[]}\n')
    t = files.valid_observations(files.read_json(spark, str(tmp_path), files.OBSERVATION))
    assert sorted(len(r.errors) for r in t.collect()) == [0, 2, 2]


def test_stream_counts(spark, tmp_path):
    src = spark.read.parquet(f"{DATA}/observations.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), src.schema)
    q = ingest.fact_counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("fc").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select sum(n) n from fc").first()["n"]
    want = src.where("observation_id is not null").dropDuplicates(["observation_id"]).select(F.explode("facts").alias("f")).where("f.pred is not null").count()
    assert got == want


def test_stream_profile(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, 0.5), ("f", 1, 0.6)], "feed string, load_no int, x double")
    df.write.parquet(str(tmp_path / "in"))
    store = profile.ValueCounts(spark, str(tmp_path / "store"))
    ingest.maintain_profile(ingest.read_stream(spark, str(tmp_path / "in"), df.schema), store, ["x"], str(tmp_path / "cp")).awaitTermination()
    assert store.counts().agg(F.sum("n")).first()[0] == 2


def test_stream_latest(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", t0, "x"), ("a", t0 + dt.timedelta(1), "y"), (None, t0, "z")], "id string, seq timestamp, v string")
    df.write.parquet(str(tmp_path / "in"))
    ingest.running_latest(spark, ingest.read_stream(spark, str(tmp_path / "in"), df.schema), "id", "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.id, r.v) for r in ingest.latest(spark, str(tmp_path / "out"), "id", "seq").collect()] == [("a", "y")]
