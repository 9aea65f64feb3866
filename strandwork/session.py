"""Session and table helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandwork")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which executors and driver share; a local session without one gets its own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    kept = context._jsc.sc().getCheckpointDir()
    found = found or (kept.get() if kept.isDefined() else None)
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="strandwork-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Paths of the stored tables of this process that haven't been dropped.
_made: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage; lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, at = _files(spark, path)
    system.deleteOnExit(at)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    system, at = _files(spark, path)
    system.delete(at, True)
    if path in _made:
        _made.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Drops at its end what was stored within it, but for the stored tables that the function it gives is called with."""
    before, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stored_at)
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _made[before:] if p not in kept]:
            _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
