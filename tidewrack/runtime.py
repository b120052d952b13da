"""Session, table and lineage helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of their values, up to which a side may be broadcast after it has been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidewrack")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the session's own setting, or a temporary folder where none is set (local runs)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewrack-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, with no lineage behind it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def together(*calls: Callable[[], object]) -> list:
    """The results of calls that don't depend on each other, made at the same time, so that the jobs of one use the cores that those of another leave idle."""
    if not calls:
        return []
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(call) for call in calls]]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder, for tables an operator writes and reads again.

    Tables there are read lazily, so they stay until the session's user calls :func:`tidy`; a local session's temporary folder goes when Python ends.
    """
    return os.path.join(checkpoint_dir(spark), f"{name}-{os.urandom(6).hex()}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted; none where its folder is missing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(f.getPath().toString() for f in found or [])


def put(spark: SparkSession, path: str, text: str = "") -> None:
    """A small file, which appears whole: it is written beside its place and renamed."""
    jvm = spark.sparkContext._jvm
    where, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{os.urandom(4).hex()}")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(where, False)
    if not files.rename(beside, where):
        raise OSError(f"can't write {path}")


def get(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    source = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with what it holds, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Deletes what operators of this session have left in its checkpoint folder. Results that still depend on it can't be read afterwards."""
    for path in listed(spark, f"{checkpoint_dir(spark)}/*"):
        remove(spark, path)


def _bytes(df: DataFrame):
    """About how many bytes the values of a row take."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind in ("array", "map"):
            size = size + 8 * F.greatest(F.lit(0), F.coalesce(F.size(f"`{f.name}`"), F.lit(0)))
    return size.cast("bigint")


def bounded(df: DataFrame, bound: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``bound`` rows of ``size`` bytes in all, seen by counting no more than one row beyond that."""
    n, total = df.limit(bound + 1).agg(F.count("*"), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return n <= bound and total <= size


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed side, with a broadcast hint only if counting has shown it to be within :func:`bounded`."""
    return F.broadcast(df) if bounded(df, bound) else df
