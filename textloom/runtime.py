"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []
_planning = threading.Lock()


def session(app: str = "textloom", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings the library expects; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table (a file or a folder of parts) of a data directory."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session, whose executors are this machine, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs a re-read instead of a recomputation. The table stays until clear() or the end of the program."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_clear_active)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that materialise() has written; frames that read them can no longer be used."""
    context = spark.sparkContext
    while _written:
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _clear_active() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            clear(spark)
        except Exception:  # the JVM has gone already
            pass


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: unlike materialise it keeps the partitioning, so that later groupings by it need no shuffle.
    A plan that adapts while it runs does not tell its partitioning, so this one is fixed before."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with _planning:  # the setting is the session's
        before = spark.conf.get(key)
        spark.conf.set(key, "false")
        try:
            return df.checkpoint()
        finally:
            spark.conf.set(key, before)
