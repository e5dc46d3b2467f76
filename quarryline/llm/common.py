"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, table  # noqa: F401

#: Rows that a Python task works on at once: bounds its memory whatever the Arrow batch holds.
SLICE_ROWS = 512
#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 200_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that df does not have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A checkpointed table of a few numbers a row, broadcast if its counted rows are few, so that no join key is hot."""
    return F.broadcast(df) if df.count() <= most else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def keyed_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """The rows of each value of a sorted integer column, whole across batches; in parts of most rows where there are more."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        keys = batch.column(key).to_numpy()
        ends = np.r_[np.nonzero(np.diff(keys))[0] + 1, len(keys)]
        begin = 0
        for end in ends[ends > 0].tolist():
            if held and held[-1].column(key)[0].as_py() != keys[begin]:
                yield pa.Table.from_batches(held).combine_chunks()
                held, count = [], 0
            while begin < end:
                part = batch.slice(begin, min(end - begin, most - count))
                held.append(part)
                begin, count = begin + part.num_rows, count + part.num_rows
                if count == most:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def utf8(column: pa.Array) -> list[bytes | None]:
    """The bytes of each string, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n: the folds of the labelled operators; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)
