"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall
    back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="docloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _SCRATCH.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> bool:
    """Remove one staged path that nothing reads any more."""
    if path in _SCRATCH:
        _SCRATCH.remove(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_scratch(spark: SparkSession) -> int:
    """Remove what this driver has staged so far; call it once the results are written.

    Results that were not written yet read staged tables and must not be used after it.
    """
    dropped = 0
    while _SCRATCH:
        dropped += drop_path(spark, _SCRATCH[-1])
    return dropped


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, object]) -> Iterator[None]:
    """Session settings that hold inside a block."""
    held = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Several consumers of an expensive table then scan the written files, and a
    lost executor costs a re-read instead of a recomputation of the lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input at least one partition per core before heavy row-local work.

    Inputs that already have enough splits, as any large one has, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows and bytes of one Arrow batch sent to Python; the row that reaches the bytes ends it.
BATCH_ROWS = 2000
BATCH_BYTES = 16 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session: a Python worker holds whole batches, however long their rows are."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        # Bytes may end with b; a size with another unit is the caller's own choice.
        if (size := re.fullmatch(r"(-?\d+)b?", held)) and not 0 < int(size[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="docloom-zip-"), "docloom")
    archive = shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
