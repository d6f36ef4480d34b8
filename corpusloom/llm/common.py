"""Shared helpers: table paths, the shared scratch folder, null-safe columns."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"

_SCRATCH: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode, where there is one machine, and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom/{what}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(_sweep)
    _SCRATCH.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that holds it."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _SCRATCH:
        try:
            drop(spark, path)
        except Exception:  # the session may have ended before the interpreter
            pass


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Rows, and about as many bytes, of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 25


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches cut to BATCH_ROWS rows and BATCH_BYTES: texts are long, and a Python worker holds a batch several times.

    The settings are the session's, as Spark has them for a session alone, and smaller ones are left as they are.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = conf.get(key, None)  # in bytes, or with a unit
        if held is None or not held.lstrip("-").isdigit() or not 0 < int(held) <= most:
            conf.set(key, str(most))
    return df


def lean(batches: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same over batches, and at the end give freed memory back: a worker that waits for its next task keeps its heap."""

    @wraps(batches)
    def run(given: Iterator) -> Iterator:
        try:
            yield from batches(given)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
