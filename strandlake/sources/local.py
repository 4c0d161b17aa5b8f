"""Files beside the driver: a stream in, one text file out.

Executors only write to folders that they share with the driver."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where all processes share one
    disk, a temporary one if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="strandlake-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its plan ends there, and what reads it several
    times does not compute it again."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The path, and the file system that it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def spooled(spark: SparkSession, stream: BinaryIO) -> str:
    """A stream as a file that all executors can read; the driver holds one piece at a time."""
    with tempfile.NamedTemporaryFile(suffix=".sam", delete=False) as out:
        shutil.copyfileobj(stream, out, 1 << 20)
    target, fs = hadoop(spark, f"{shared_folder(spark)}/spooled-{uuid.uuid4().hex}.sam")
    source, _ = hadoop(spark, f"file://{out.name}")
    fs.copyFromLocalFile(True, True, source, target)
    return target.toString()


def write_text(lines: DataFrame, path: str, header: list[str]) -> None:
    """One file beside the driver: the header, then the parts of ``value`` in their order."""
    spark = lines.sparkSession
    folder = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    lines.write.text(folder)
    where, fs = hadoop(spark, folder)
    try:
        parts = sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
        with open(path, "wb") as out, tempfile.TemporaryDirectory() as held:
            out.write("".join(h + "\n" for h in header).encode())
            for k, part in enumerate(parts):
                here = os.path.join(held, str(k))
                fs.copyToLocalFile(False, hadoop(spark, part)[0], hadoop(spark, f"file://{here}")[0], True)
                with open(here, "rb") as f:
                    shutil.copyfileobj(f, out)
                os.remove(here)
    finally:
        fs.delete(where, True)


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated, with the columns' names first; rows stay in their order."""
    text = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    write_text(df.select(text.alias("value")), path, ["\t".join(df.columns)] * header)
