"""Joins, ranks and broadcasts that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side with at most this many rows, and bytes of its rows as JSON, is broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if counts prove that it has at most max_rows rows and max_bytes bytes, else df as it is.

    Counting stops after max_rows + 1 rows. Callers pass narrow tables that are cheap to compute or materialised.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, b = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and b <= max_bytes else df


def hot_values(df: DataFrame, key: str, share: float = 0.02) -> list:
    """Values of key that hold more than the given share of all rows: at most 1 / share of them.

    The counts are combined before the shuffle. Null is never hot: it joins with nothing.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__tf_n"))
    total = df.count()
    rows = counts.where(F.col("__tf_n") > max(1.0, share * total)).select(key).collect() if total else []
    return [r[0] for r in rows]


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: float = 0.02) -> DataFrame:
    """left joined to right, which has at most one row a key, without one task getting a hot key.

    Rows of hot keys, of which there can be at most 1 / share, meet their few right rows by broadcast; all other rows
    are shuffled. Rows with a null key find nothing and are kept by a left join.
    """
    hot = hot_values(left, key, share)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.where(~is_hot).join(right, key, how).unionByName(
        left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how)
    )


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal to each other."""
    renamed = right.withColumnsRenamed({k: f"__tf_key{i}" for i, k in enumerate(keys)})
    same = [left[k].eqNullSafe(renamed[f"__tf_key{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, same).drop(*[f"__tf_key{i}" for i in range(len(keys))])


def hash_rank(df: DataFrame, group: list[str], order: Column, rank: str, buckets: int = 256) -> DataFrame:
    """Number the rows of each group from 1 by a 64-bit hash, splitting every group over buckets of the hash.

    order is a BIGINT that is unique within its group. Its top bits are the bucket, so ranks within buckets plus the
    sizes of the buckets before give the rank in the whole group; no task sorts a whole group.
    """
    bits = buckets.bit_length() - 1
    split = df.withColumn("__tf_o", order).withColumn("__tf_b", F.shiftright("__tf_o", 64 - bits))
    sizes = split.groupBy(*group, "__tf_b").agg(F.count("*").alias("__tf_n"))
    before = Window.partitionBy(*group).orderBy("__tf_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__tf_before", F.coalesce(F.sum("__tf_n").over(before), F.lit(0))).drop("__tf_n")
    within = split.withColumn("__tf_r", F.row_number().over(Window.partitionBy(*group, "__tf_b").orderBy("__tf_o")))
    return _meet(within, offsets, [*group, "__tf_b"]).withColumn(rank, F.col("__tf_before") + F.col("__tf_r")).drop("__tf_o", "__tf_b", "__tf_r", "__tf_before")


def bucketed_sequence(df: DataFrame, group: str, bucket: str, order: list[str], number: str) -> DataFrame:
    """Number the rows of each group from 0 by (bucket, *order), where bucket is a coarse part of the order.

    The same split as hash_rank for orders that are not hashes, for example days of a timestamp.
    """
    sizes = df.groupBy(group, bucket).agg(F.count("*").alias("__tf_n"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__tf_before", F.coalesce(F.sum("__tf_n").over(before), F.lit(0))).drop("__tf_n")
    within = df.withColumn("__tf_r", F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order)) - 1)
    return _meet(within, offsets, [group, bucket]).withColumn(number, F.col("__tf_before") + F.col("__tf_r")).drop("__tf_r", "__tf_before")


def first_rows(df: DataFrame, group: str, order: list[str], k: int, parts: int = 32) -> DataFrame:
    """The first k rows of each group by order, which must be unique within it, with their place from 1 in column place.

    Every part of a group (by hash of the order) keeps its own first k before the parts meet, so k x parts rows a group are
    all that one task ranks.
    """
    split = df.withColumn("__tf_p", F.pmod(F.xxhash64(*order), F.lit(parts)))
    own = F.row_number().over(Window.partitionBy(group, "__tf_p").orderBy(*order))
    few = split.withColumn("__tf_r", own).where(F.col("__tf_r") <= k).drop("__tf_r", "__tf_p")
    return few.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= k)
