"""Sharding by Hilbert-curve order.

Metadata dimensions are quantised to ``bits`` bits each, the curve index of the cell orders the rows, and the order is
cut into ``shards`` runs of equal row counts (counts at most one apart). Rows near each other in every dimension share
a shard, so a file's min/max of each dimension is narrow and readers can prune files on any of them.

Quantising. A string dimension takes the rank of its value among the distinct values, spread evenly over the cells
(values beyond ``2**bits`` share cells, in order); a number takes its place among the quantiles of the whole column.
Both come from aggregates of all rows. Null is cell 0.

The global row number needs no single task: rows are range-partitioned by (index, text hash, id), each partition is
sorted and materialised, and a row's number is its position in its partition plus the sizes of those before. Only one
size per partition reaches the driver.

Ties: rows of one cell follow their text hash, so equal texts of a cell are neighbours, then doc_id; identical rows are
interchangeable. Null ids and texts are rows like others (null text: no bytes, null hash). No rows give none. Extra
columns are ignored by ``assign`` and kept by ``write_shards``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import free_name

DIMENSIONS = ("source", "lang", "n_chars", "doc_id")
BITS = 5
SHARDS = 40


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of cells (n x dims, each below 2**bits): Gray-code walk of the axes, high bit first."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations from the coarsest level on
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(on, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def boundaries(docs: DataFrame, dimensions: tuple[str, ...], bits: int = BITS) -> dict[str, list]:
    """Lower bounds of the cells 1, 2, ... of each dimension: at most 2**bits - 1 values each."""
    cells, kinds = 1 << bits, dict(docs.dtypes)
    out: dict[str, list] = {}
    numbers = [c for c in dimensions if kinds[c] != "string"]
    if numbers:
        at = [k / cells for k in range(1, cells)]
        row = docs.agg(*(F.percentile_approx(c, at, 10_000).alias(f"q{i}") for i, c in enumerate(numbers))).first()
        out |= {c: sorted(set(row[i] or [])) for i, c in enumerate(numbers)}
    for c in dimensions:
        if kinds[c] == "string":
            values = docs.filter(F.col(c).isNotNull()).groupBy(c).count().select(F.col(c).alias("v"))
            n = values.count()
            # every step-th distinct value in order; the rank comes from counting smaller values, range by range
            ranked = _ranks(values)
            step = max(1, -(-n // (cells - 1)))
            out[c] = [r[0] for r in ranked.filter(F.col("rank") % step == 0).orderBy("v").select("v").collect()]
    return out


def _ranks(values: DataFrame) -> DataFrame:
    """v and its rank from 0, without a single task."""
    return numbered(values, ["v"], "rank")


def _cells(bounds: dict[str, list], dimensions: tuple[str, ...], bits: int):
    most = (1 << bits) - 1

    @F.pandas_udf("long")
    def index(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            cells = np.zeros((len(columns[0]), len(dimensions)), dtype=np.int64)
            for i, (c, column) in enumerate(zip(dimensions, columns, strict=True)):
                known = column.notna().to_numpy()
                cells[known, i] = [min(most, bisect.bisect_right(bounds[c], v)) for v in column[known]]
            yield pd.Series(curve_index(cells, bits))

    return index


def equal_runs(number: Column, n: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a row number when n rows are cut into runs whose sizes differ by one at most."""
    small, larger = divmod(n, shards)
    cut = larger * (small + 1)
    first = number < cut
    shard = F.when(first, F.floor(number / (small + 1))).otherwise(larger + F.floor((number - cut) / max(small, 1)))
    slot = F.when(first, number % (small + 1)).otherwise((number - cut) % max(small, 1))
    return shard.cast("int"), slot.cast("long")


def assign(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, hilbert, shard and slot of every row."""
    bounds = boundaries(docs, dimensions, bits)
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        *(c for c in dimensions if c != "doc_id"),
        _cells(bounds, dimensions, bits)(*dimensions).alias("hilbert"),
    )
    placed = numbered(keyed, ["hilbert", "text_crc32", "doc_id", "size"], "_number")
    shard, slot = equal_runs(F.col("_number"), placed.count(), shards)
    return placed.withColumns({"shard": shard, "slot": slot}).drop("_number")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **how) -> None:
    """Write the whole rows as one Parquet folder (_shard=n, or a longer name if docs has that column) per shard, in slot order.

    Assignments meet their rows by doc_id and text hash; rows equal in both share the assigned slots in any order.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "crc")
    slots = assign(docs, shards, **how).select("doc_id", F.col("text_crc32").alias("crc"), "shard", "slot").withColumn("copy", F.row_number().over(w.orderBy("slot"))).alias("s")
    rows = docs.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), F.struct("*").alias("row")).withColumn("copy", F.row_number().over(w.orderBy(*(f"row.{c}" for c in DIMENSIONS)))).alias("r")
    joined = rows.join(slots, F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & F.col("r.crc").eqNullSafe(F.col("s.crc")) & (F.col("r.copy") == F.col("s.copy")))
    placed = joined.select("row", "s.shard", "s.slot").repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot")
    name = free_name(docs, "_shard")
    placed.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
