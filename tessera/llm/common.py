"""What the operators share: tables, scratch tables in the shared folder, skew-safe joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable
from types import ModuleType
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; every word is a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than 1/HEAVY of the rows is heavy, so there are fewer than HEAVY such keys.
HEAVY = 1000

#: Most rows of a table of sums that is broadcast, some tens of MB.
SMALL = 1 << 18

_scratch: list[tuple[SparkSession, str]] = []


#: Bytes of a batch of rows that goes to a Python worker, where the session does not set them; Spark's own default is 64 MB, for which buffers of 128 MB a task are made.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands rows to Python workers in batches of bounded bytes, however long the texts."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, "1") == "1":  # what is given here comes back if it is not set
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all runs in one process, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(folder)
    _scratch.append((spark, folder))
    return folder


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{kind}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, computes once, outlives executors."""
    spark = bounded(df).sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it is read in fewer parts than there are cores, as a small table in one file is."""
    cores = bounded(df).sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drop(*tables: DataFrame) -> None:
    """Removes scratch tables that nothing reads any more."""
    for df in tables:
        spark, files = df.sparkSession, df.inputFiles()
        if files:
            remove(spark, files[0].rsplit("/", 1)[0])


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 the JVM may be gone already
            return


def per_worker(key: tuple, make: Callable):
    """What ``make`` returns, kept by the Python worker for its next task that asks for the same; one thing at a time."""
    kept = sys.modules.setdefault("_tessera_worker", ModuleType("_tessera_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def forget() -> None:
    """Drops what per_worker() keeps: for tasks of other operators, which have no use for it."""
    if "_tessera_worker" in sys.modules:
        sys.modules["_tessera_worker"].__dict__.clear()
        tidy()


def tidy() -> None:
    """Gives memory that is free in this Python worker back, so that the next task's stage has it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def filesystem(path: str):
    """(pyarrow file system, path in it) of a path in the shared folder, on driver or executor."""
    from pyarrow import fs

    url = urlparse(path)
    if url.scheme in ("", "file"):
        return fs.LocalFileSystem(), url.path
    return fs.FileSystem.from_uri(path)


def join_heavy(left: DataFrame, right: DataFrame, key: str, spread: Column, total: int) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``key``, safe against hot keys.

    ``right`` has unique keys and a column ``n``: the rows that ``left`` has of that key.
    Keys with over total/HEAVY rows number under HEAVY by arithmetic, so that part of
    ``right`` is broadcast; their rows are then dealt out by ``spread``. All other keys
    are joined by shuffle, with total/HEAVY rows a key at most. ``right`` is read twice
    and so should be a written table.
    """
    limit = max(1, total // HEAVY)
    payload = F.struct(*[F.col(c) for c in right.columns if c not in (key, "n")])
    heavy = right.where(F.col("n") > limit).select(key, payload.alias("_heavy"))
    light = right.where(F.col("n") <= limit).select(key, F.lit(0).alias("_deal"), payload.alias("_light"))
    alone = F.col("_heavy").isNotNull() | F.col(key).isNull()
    out = (
        left.join(F.broadcast(heavy), key, "left")
        .withColumn("_deal", F.when(alone, 1 + F.pmod(F.xxhash64(spread), F.lit(4096)).cast("int")).otherwise(0))
        .join(light, [key, "_deal"], "left")
    )
    got = F.coalesce("_heavy", "_light")
    kept = [c for c in left.columns]
    return out.select(*kept, *[got[c].alias(c) for c in right.columns if c not in (key, "n")])


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Column, total: int) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on ``key``: ``right`` is broadcast if it has SMALL rows at most, else joined as join_heavy() does."""
    if right.count() <= SMALL:
        return left.join(F.broadcast(right.drop("n")), key, "left")
    return join_heavy(left, right, key, spread, total)
