"""Dense positions over unordered rows without a single-task window.

Rows are range-partitioned on (group, order) so that a hot group spans several tasks, sorted
inside each partition, and numbered locally. A small table of per-partition counts (one row per
partition and group present in it) yields the offsets, which are joined back. The offsets table
is broadcast only when its row count is below a bound that is checked first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Offsets tables up to this many rows are broadcast; larger ones are shuffle-joined.
OFFSETS_BROADCAST_ROWS = 200_000


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _local_cumsum(keys: list[str], value: str, dtype: str = "int64"):
    """Exclusive running sum of ``value`` within each group, per partition (rows arrive sorted)."""

    def changes(pdf):
        """Does row i + 1 start another group than row i (null equals null)?"""
        out = np.zeros(max(0, len(pdf) - 1), dtype=bool)
        for k in keys:
            v, na = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
            out |= (na[1:] != na[:-1]) | (~na[1:] & ~na[:-1] & (v[1:] != v[:-1]))
        return out

    def run(batches):
        last_key, carry = None, 0
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(_lcum=pd.Series([], dtype=dtype))
                continue
            v = pdf[value].fillna(0).astype(dtype).to_numpy()
            ends = [tuple(None if pd.isna(pdf[k].iloc[i]) else pdf[k].iloc[i] for k in keys) for i in (0, -1)]
            new = np.r_[ends[0] != last_key, changes(pdf)]
            gid = np.cumsum(new)
            cs = np.cumsum(v) - v
            base = np.concatenate([[-carry], cs[np.flatnonzero(new)]])
            cum = cs - base[gid]
            carry, last_key = cum[-1] + v[-1], ends[1]
            yield pdf.assign(_lcum=cum.astype(dtype))

    return run


def with_row_index(
    df: DataFrame,
    order_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    out: str = "row_idx",
    cum_of: str | None = None,
    cum_out: str = "cum_before",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = 0-based dense position by ``order_cols`` within ``group_cols``.

    ``order_cols`` must be a total order (unique within a group) for the result to be
    deterministic. With ``cum_of``, also add ``cum_out`` = sum of ``cum_of`` over the earlier
    rows of the same group (exclusive running sum).
    """
    group_cols, order_cols = list(group_cols), list(order_cols)
    keys = group_cols + order_cols
    n = _partitions(df, num_partitions)
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_lpos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    integral = True
    if cum_of is not None:
        integral = isinstance(df.schema[cum_of].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        cum_type = T.LongType() if integral else T.DoubleType()
        schema = T.StructType(ranged.schema.fields + [T.StructField("_lcum", cum_type)])
        ranged = ranged.mapInPandas(_local_cumsum(group_cols, cum_of, "int64" if integral else "float64"), schema)
    # Pin the range bounds: the stats pass and the final pass must see the same partitions.
    ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)

    aggs = [F.count(F.lit(1)).alias("_cnt"), F.min("_lpos").alias("_first")]
    if cum_of is not None:
        v = F.col(cum_of).cast("long" if integral else "double")
        aggs.append(F.sum(F.coalesce(v, F.lit(0).cast("long" if integral else "double"))).alias("_sum"))
    stats = ranged.groupBy("_pid", *group_cols).agg(*aggs)
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    if cum_of is not None:
        zero = F.lit(0).cast("long" if integral else "double")
        offsets = offsets.withColumn("_soff", F.coalesce(F.sum("_sum").over(w), zero))
    offsets = offsets.drop("_cnt", "_sum")

    # Without groups the table has at most n rows; with groups its size is counted first.
    small = not group_cols or stats.count() <= OFFSETS_BROADCAST_ROWS
    right = F.broadcast(offsets) if small else offsets
    o = right.alias("_o")
    cond = F.col("_l._pid") == F.col("_o._pid")
    for g in group_cols:
        cond = cond & F.col(f"_l.{g}").eqNullSafe(F.col(f"_o.{g}"))
    joined = ranged.alias("_l").join(o, cond, "inner")
    result = joined.select(
        *[F.col(f"_l.{c}") for c in df.columns],
        (F.col("_o._off") + F.col("_l._lpos") - F.col("_o._first")).alias(out),
        *([(F.col("_o._soff") + F.col("_l._lcum")).alias(cum_out)] if cum_of is not None else []),
    )
    return result
