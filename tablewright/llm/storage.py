"""Cutting lineage with files that every executor can reach."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Bytes of text that an operator works on at once, unless a single text is longer; bytes of an Arrow batch.
PIECE, BATCH = 1 << 19, "8m"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of this machine under a local master where none is set (tests).

    Raises ValueError on a cluster without the setting: a folder of one machine would lose data there.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tablewright-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: later jobs start from the files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` gave; whatever was planned from them must have run."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """Partitions for an explicit exchange: the session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lean(run: Callable) -> Callable:
    """A batch function that gives unused memory back when its partition ends: workers are kept for later tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, which carry whole texts, where the session doesn't say otherwise.

    All operators want the same bound, so that frames planned earlier run under it, too. Rows of a batch stay as they
    are set; :func:`pieces` cuts batches for the work itself.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches cut into at most ``rows`` rows whose texts have about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        block = ((np.cumsum(size) - size) // most) + (np.arange(batch.num_rows) // rows)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e > s:
                yield batch.slice(s, e - s)


def as_rows(docs: DataFrame, kept: list[str]) -> Column:
    """The columns ``kept`` as one struct named row, so that a batch function may have columns of any name; text is a string."""
    return F.struct(*((quoted(c).cast("string") if c == "text" else quoted(c)).alias(c) for c in kept)).alias("row")


def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of the fields of the struct column row."""
    for batch in batches:
        yield pa.RecordBatch.from_struct_array(batch.column("row"))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")
