"""Shards cut from a Hilbert curve through several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (column, "category" or "amount") of each dimension.
DIMENSIONS = (("lang", "category"), ("source", "category"), ("n_chars", "amount"))
BITS = 5
#: Parts by a hash of the id into which the rows of one cell of the curve are dealt.
PARTS = 64


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Position on the Hilbert curve through the grid of 2**bits cells on each axis.

    After Skilling (2004): undo the excess work of the inverse, Gray-encode,
    then interleave the bits, the first axis highest.
    """
    x = [np.asarray(a, np.int64).copy() for a in axes]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ turn) >> level) & 1)
    return out


def quantised(name: str, kind: str, bits: int = BITS) -> Column:
    """The cell of a column's value on its axis, 0 for null.

    A category takes the cell that its hash names; an amount (0 up to 2**32)
    takes even steps of its logarithm.
    """
    cells = 1 << bits
    if kind == "category":
        return F.when(F.col(name).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(cells))).cast("int")
    steps = F.log2(F.greatest(F.col(name).cast("double"), F.lit(0.0)) + 1) * (cells / 32)
    return F.coalesce(F.least(steps.cast("int"), F.lit(cells - 1)), F.lit(0))


def curve(dimensions=DIMENSIONS, bits: int = BITS) -> Column:
    """A row's place on the curve, as a long."""

    @F.pandas_udf("long")
    def placed(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    return placed(*[quantised(name, kind, bits) for name, kind in dimensions])


def hilbert_shards(rows: DataFrame, shards: int, id_col: str = "doc_id", dimensions=DIMENSIONS, bits: int = BITS, parts: int = PARTS) -> DataFrame:
    """rows with curve (long), shard (int, 0 to shards - 1) and slot (long, 0 up in each shard).

    Rows are ordered by the curve, then by a hash of the id, the id and a hash
    of the row; runs of that order are the shards, whose counts differ by one at
    most. Null dimensions take the first cell, null ids their own part; repeated
    rows each get a slot; with fewer rows than shards some stay empty. A column
    of rows named curve, shard or slot is replaced. No sort is global: counts of
    the cells (at most 2**(bits * dimensions)) and their parts are summed
    instead, and a hot cell is dealt into parts.
    """
    ties = F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")])
    # the row's own columns go along in a struct, so their names clash with nothing
    keyed = rows.select(F.struct("*").alias("row"), curve(dimensions, bits).alias("curve"), F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("part"), F.col(id_col).alias("key"), ties.alias("ties"))
    counts = keyed.groupBy("curve", "part").agg(F.count("*").alias("n"))
    cells = counts.groupBy("curve").agg(F.sum("n").alias("cell"))
    upto = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("curve", F.coalesce(F.sum("cell").over(upto), F.lit(0)).alias("before"), F.sum("cell").over(whole).alias("all_rows"))
    within = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("curve", "part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inside")).join(cells, "curve")
    starts = starts.select("curve", "part", (F.col("before") + F.col("inside")).alias("start"), "all_rows")
    nth = F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "ties")) - 1
    placed = keyed.withColumn("nth", nth).join(starts, ["curve", "part"]).withColumn("at", F.col("start") + F.col("nth"))
    placed = placed.withColumn("shard", F.expr(f"at * {shards} div all_rows").cast("int"))
    first = F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
    kept = [F.col(f"row.`{c}`") for c in rows.columns if c not in ("curve", "shard", "slot")]
    return placed.select(*kept, "curve", "shard", (F.col("at") - first).alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int, rows_per_file: int = 1 << 20, **settings) -> None:
    """Writes path/shard=N/ Parquet files along the curve, so their statistics prune on every dimension.

    Of the columns of hilbert_shards, all are kept. An empty table writes no
    shard; texts of any length go whole into their row.
    """
    placed = hilbert_shards(rows, shards, **settings)
    placed.repartition("shard", F.expr(f"slot div {rows_per_file}")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
