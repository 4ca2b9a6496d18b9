"""Session defaults and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

_own_dirs: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}


def get_session(cores: int | str = "*", app: str = "causeway") -> SparkSession:
    """A local session with the settings the engine is written for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode an own one where it is unset.

    On a cluster without the setting this raises: a folder of the driver's
    machine would be invisible to the executors.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="causeway-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dirs[app] = path
        spark.sparkContext.setCheckpointDir(path)
    return _own_dirs[app]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is gone; the cluster's own clean-up takes over
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/causeway-{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = []
        atexit.register(release, spark)
    _scratch[app].append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove all scratch tables written so far: to be called between queries, once the results of those before are read, by a session that lives long."""
    try:
        paths = _scratch.get(spark.sparkContext.applicationId, [])
    except Exception:  # the session is gone
        return
    while paths:
        _delete(spark, paths.pop())


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and return a scan of it.

    Unlike a cached or locally checkpointed frame the result needs no executor
    to stay alive, is computed once, and its file sizes let the planner decide
    on broadcasts. The files are removed when the session ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._causeway_path = path
    return out


def materialize_counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict]:
    """materialize(df), with the values of aggregate columns that were observed while it was written."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return out, seen.get


def discard(df: DataFrame) -> None:
    """Remove the files behind a frame from materialize() that no later plan reads."""
    path = getattr(df, "_causeway_path", None)
    if path:
        _delete(df.sparkSession, path)
        own = _scratch.get(df.sparkSession.sparkContext.applicationId, [])
        if path in own:
            own.remove(path)
