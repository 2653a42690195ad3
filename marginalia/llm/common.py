"""What the operators of this package share: tables, the shared folder, staged tables, bounded batches, freed memory."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_folder

#: Lets Spark delete a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a worker turns into Python objects or arrays at once, about; a longer text stands alone.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5, is 0; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fresh(name: str, columns: list[str]) -> str:
    """A column name that no column has, whatever its case."""
    while name in {c.lower() for c in columns}:
        name += "_"
    return name


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives a lost executor.

    The shuffle files behind it go at once, as nothing will read them again; `dropped` deletes the table itself.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/marginalia/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again: only what later staged tables have replaced."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about `most` bytes of text in a column, so that memory follows neither batches nor rows."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    cuts = np.nonzero(np.diff(np.cumsum(sizes) // most, prepend=-1))[0].tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def freeing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, but what it has freed goes back to the system when its task ends: Python workers live on and take up other stages."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            free_memory()

    return wrapped


def free_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
