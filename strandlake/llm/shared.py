"""What several operators of this subpackage use: the shared folder and its tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset in local
    mode, as in tests, where all processes share one disk, a folder is made here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What runs here leaves no shuffle files: each action drops its own when it ends,
    instead of when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and a lost
    executor costs no more than the tasks that ran on it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed() -> None:
    """Gives memory that earlier tasks of a reused Python worker left unused back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task whose worker is left without unused memory, whatever ran in it before: workers
    that wait for their next task share an executor's memory with those at work."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed()
        yield from task(batches)
        freed()

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def residue(doc_id: int, mod: int) -> int:
    """crc32 of the id as text, modulo ``mod``: the folds of the contracts."""
    return zlib.crc32(str(doc_id).encode()) % mod


def least_hashed(df: DataFrame, hashed: Column, rows: int, name: str = "_u") -> DataFrame:
    """About ``rows`` rows of least hash (all, if there are fewer), with it as ``name``.

    The number of rows tells how small a hash must be to be among twice as many as
    asked for; only those are ordered, so no task gathers a share of every partition."""
    df = df.withColumn(name, hashed)
    total = df.count()
    if total > 2 * rows:
        df = df.filter(F.col(name) < F.lit(int(-(2**63) + 2**64 * (2 * rows / total))))
    return df.orderBy(name).limit(rows)
