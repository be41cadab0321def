"""Shared helpers: table access, row keys, written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession

from riskspark.functions.staging import staging_root

WORD = r"[^\x20\x09-\x0D]+"  # the word rule shared by several operators


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the folder that driver and executors share, and read it back.

    It cuts the lineage, survives lost executors, and lets several passes read only their columns.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SLICE_BYTES = 4 << 20  # of text that a Python task works on at once


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes in a string or binary column, without copies.

    What a task builds for a run is freed before the next one, so its memory does not follow the batch.
    """
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    runs = np.cumsum(sizes, dtype=np.int64) // most
    bounds = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), batch.num_rows]
    for start, end in zip(bounds, bounds[1:]):
        yield batch.slice(start, end - start)


def row_key(doc_id: int | None, text: str | None) -> bytes:
    """128-bit key of one record; equal records share it, and then also share every result."""
    h = xxhash.xxh3_128(b"\x00" if doc_id is None else b"%d:" % doc_id)
    h.update(b"\x00" if text is None else b"\x01" + text.encode())
    return h.digest()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep
