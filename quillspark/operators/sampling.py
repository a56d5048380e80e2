"""Splitting, sampling and sharding (L1-L8) on top of the partitioned row index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.indexing import with_row_index


def hash_key(id_col: str, seed: str, *extra) -> F.Column:
    """Order key md5('<seed>:' [|| extra ':'] || id): stable under any partitioning."""
    parts = [F.lit(f"{seed}:")]
    for e in extra:
        parts += [F.col(e).cast("string") if isinstance(e, str) else F.lit(str(e)), F.lit(":")]
    return F.md5(F.concat(*parts, F.col(id_col).cast("string")))


# Hex digits of the order key that one histogram round looks at (4096 buckets), and rounds before the rest is listed.
HISTOGRAM_DIGITS, HISTOGRAM_ROUNDS = 3, 2


def row_at(keyed: DataFrame, key_col: str, id_col: str, position: int):
    """(key, id) of the row at ``position`` in (key, id) order, for a hash key in hex; None past the end.

    Selection instead of a sort: a histogram over the first digits of the key names the bucket that holds the position, a second one
    looks into that bucket, and only the distinct (key, id) left there (a 16-millionth of all) are listed with their counts. Each
    round is one map-side combined aggregation; nothing is range-partitioned or sorted as a whole.
    """
    digits = 0
    for _ in range(HISTOGRAM_ROUNDS):
        digits += HISTOGRAM_DIGITS
        head = F.substring(key_col, 1, digits)
        found = None
        for bucket, n in sorted((r[0], r[1]) for r in keyed.groupBy(head.alias("_b")).count().collect()):
            if position < n:
                found = bucket
                break
            position -= n
        if found is None:
            return None
        keyed = keyed.filter(head == found)
    for r in keyed.groupBy(key_col, id_col).count().orderBy(key_col, id_col).collect():
        if position < r["count"]:
            return r
        position -= r["count"]
    return None


def shuffle_split(df: DataFrame, id_col: str, frac: float = 0.9, seed: str = "42",
                  names: tuple[str, str] = ("train", "valid")) -> DataFrame:
    """L1: random permutation by hash key; the first floor(frac*n) rows train, the rest valid.

    Only the row at the cut is looked for (by histograms of the ids' keys); the flag is a comparison with it on the
    scan, so no other column moves. Rows that repeat an id stay together; null ids come first.
    """
    key = F.coalesce(hash_key(id_col, seed), F.lit(""))
    ids = df.select(id_col, key.alias("_k"))
    bound = row_at(ids, "_k", id_col, int(frac * ids.count()))
    if bound is None:
        return df.withColumn("split", F.lit(names[0]))
    before = (key < bound["_k"]) | ((key == bound["_k"]) & (F.col(id_col) < F.lit(bound[id_col])))
    return df.withColumn("split", F.when(before, F.lit(names[0])).otherwise(F.lit(names[1])))


def sample_n(df: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """L2: shuffle by hash key and keep the first n rows (a bounded top-n, TakeOrderedAndProject)."""
    return df.withColumn("_k", hash_key(id_col, seed)).orderBy("_k", id_col).limit(n).drop("_k")


def position_split(df: DataFrame, order_cols: Sequence[str], bounds: Sequence[int],
                   names: Sequence[str] = ("train", "valid", "test"), group_cols: Sequence[str] = (),
                   rest: str = "unused") -> DataFrame:
    """L3: rows [0,b1) -> names[0], [b1,b2) -> names[1], ... ; rows past the last bound are kept as ``rest``."""
    idx = with_row_index(df, order_cols, group_cols)
    expr = None
    lo = 0
    for b, name in zip(bounds, names):
        cond = (F.col("row_idx") >= lo) & (F.col("row_idx") < b)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        lo = b
    return idx.withColumn("split", expr.otherwise(F.lit(rest)))


def range_shard(df: DataFrame, idx_col: str = "row_idx", start: int | None = None, end: int | None = None,
                shard_size: int = 10_000) -> DataFrame:
    """L4: keep [start, end) only when both bounds are given; shard id = idx div shard_size."""
    if start is not None and end is not None:
        df = df.filter((F.col(idx_col) >= start) & (F.col(idx_col) < end))
    return df.withColumn("shard", F.floor(F.col(idx_col) / shard_size).cast("long"))


def mini_batch(df: DataFrame, k: int, idx_col: str = "row_idx") -> DataFrame:
    """Consecutive batches of k by position; the last one may be short."""
    return df.withColumn("batch_id", F.floor(F.col(idx_col) / k).cast("long")).withColumn(
        "batch_pos", (F.col(idx_col) % k).cast("long")
    )


def epoch_order(df: DataFrame, id_col: str, epochs: int, shuffle: bool, seed: str = "42") -> DataFrame:
    """Position of each row in each epoch; a fresh hash order per epoch when shuffling.

    Epochs are generated per row (explode), and positions are dense within each epoch.
    """
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    if not shuffle:
        return with_row_index(e, [id_col], ["epoch"], out="pos")
    e = e.withColumn("_k", hash_key(id_col, seed, "epoch"))
    return with_row_index(e, ["_k", id_col], ["epoch"], out="pos").drop("_k")


def replica_shard(df: DataFrame, id_col: str, replicas: int, shuffle: bool, seed: str = "42") -> DataFrame:
    """Split rows over ``replicas`` equal shares; the list is padded by repeating its first rows.

    Padded position i (0-based) goes to replica i % R at slot i div R.
    """
    n = df.count()
    total = -(-n // replicas) * replicas
    pad = total - n
    if shuffle:
        idx = with_row_index(df.withColumn("_k", hash_key(id_col, seed)), ["_k", id_col], out="_i").drop("_k")
    else:
        idx = with_row_index(df, [id_col], out="_i")
    padded = idx.unionByName(idx.filter(F.col("_i") < pad).withColumn("_i", F.col("_i") + n))
    return padded.withColumn("replica", (F.col("_i") % replicas).cast("long")).withColumn(
        "slot", F.floor(F.col("_i") / replicas).cast("long")
    ).drop("_i")


def sorted_groups(df: DataFrame, key: str) -> DataFrame:
    """Group results in key order, with the order made explicit as a 0-based ``pos`` column."""
    return with_row_index(df.filter(F.col(key).isNotNull()), [key], out="pos")
