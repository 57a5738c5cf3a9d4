"""Intermediate tables in the shared folder, Arrow batches of bounded size, and small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citetrust.session import remove, scratch_folder

SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",  # shuffle files go when the table is written
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),  # for a worker, whatever the length of texts
}
SLICE_BYTES = 1 << 20
SMALL_SLICE_BYTES = 1 << 18  # where texts are judged one by one, so that slices save nothing but calls
FOLDERS: ContextVar[list[str] | None] = ContextVar("FOLDERS", default=None)  # of tables stored inside ``removed``


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """SETTINGS hold for what runs inside; afterwards the session is as before."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    try:
        for key, value in SETTINGS.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again.

    This cuts the lineage, survives lost executors, and lets Spark delete the shuffle files of the write. What the
    write sends to Python workers goes in batches of a few MB.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    if (folders := FOLDERS.get()) is not None:
        folders.append(folder)
    with small_batches(spark):
        df.write.parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


@contextmanager
def removed(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are ``stored`` inside are removed at the end; those whose folders were taken from the list stay."""
    folders: list[str] = []
    token = FOLDERS.set(folders)
    try:
        yield folders
    finally:
        FOLDERS.reset(token)
        for folder in folders:
            remove(spark, folder)


def stored_alone(spark: SparkSession, made: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``made`` returns, ``stored``. Tables that it stores on the way are removed: only the result reads them."""
    with removed(spark) as folders:
        df = stored(made(), name)
        last = folders.pop()
    if (folders := FOLDERS.get()) is not None:
        folders.append(last)
    return df


def table(spark, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one entry more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32) if ends else np.zeros(1, np.int64)
    ends = ends[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first, last = (int(ends[0]), int(ends[-1])) if len(ends) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - first if len(ends) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text, or one row if that row alone is longer."""
    _, at = utf8(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def by_slices(
    column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE_BYTES
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that applies ``work`` to parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield work(part)

    return run


def binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())
