"""Latest states, histories and daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.skew import bucketed_sequence


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by order; ties by content. An aggregate, so a hot key costs one row a task.

    Rows with a null key are left out; nulls in the order come first.
    """
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_row")).select(key, "_row.*")


def with_neighbour(df: DataFrame, group: str, bucket: Column, order: Sequence[str], columns: dict[str, str], step: int) -> DataFrame:
    """df with columns of the row that is step places later (negative: earlier) in its group, null at the ends.

    order must be unique within a group, and bucket a coarse part of it. Rows without a group have no neighbour. Rows are numbered bucket by bucket and joined on
    (group, number), so even one huge group is spread over all tasks.
    """
    numbered = bucketed_sequence(df.withColumn("__tf_k", bucket), group, "__tf_k", list(order), "__tf_i").drop("__tf_k")
    other = numbered.select(group, (F.col("__tf_i") - step).alias("__tf_i"), *[F.col(c).alias(a) for c, a in columns.items()])
    return numbered.join(other, [group, "__tf_i"], "left").drop("__tf_i")


def daily_series(daily: DataFrame) -> DataFrame:
    """date, added, total for every day from the first to the last: gaps are filled with 0 and the total carried on.

    daily: date, added. The window runs over days, of which there are few; events were added up before.
    """
    days = daily.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    filled = days.join(daily, "date", "left").fillna(0, ["added"])
    return filled.select("date", "added", F.sum("added").over(run).alias("total"))


def continuity(previous: DataFrame, current: DataFrame) -> DataFrame:
    """date, problem where a new series does not continue a published one (both: date, total).

    Completed days must stay (`changed` or `missing`); the last published day is provisional and may change; the new
    series has no gap (`gap`: its day before is missing).
    """
    last = previous.agg(F.max("date").alias("_last"))
    held = previous.join(F.broadcast(last)).join(current.select("date", F.col("total").alias("_new")), "date", "left")
    broken = held.where("_new is null or (date < _last and _new <> total)").select("date", F.when(F.col("_new").isNull(), "missing").otherwise("changed").alias("problem"))
    first = current.agg(F.min("date").alias("_first"))
    nexts = current.select(F.date_add("date", 1).alias("date"), F.lit(True).alias("_has"))
    gaps = current.join(F.broadcast(first)).join(nexts, "date", "left").where("_has is null and date > _first").select("date", F.lit("gap").alias("problem"))
    return broken.unionByName(gaps)


def ambiguous_moments(df: DataFrame, group: str, ts: str, seconds: int = 1) -> DataFrame:
    """group, ts, n of moments at which more than one event of the group lies within the given seconds up to it.

    Events are counted by whole second first; each second then meets the few before it by equi-joins.
    """
    counts = df.groupBy(group, F.date_trunc("second", ts).alias("ts")).agg(F.count("*").alias("n"))
    spread = counts.select(group, F.explode(F.sequence(F.col("ts"), F.col("ts") + F.expr(f"interval {seconds} seconds"), F.expr("interval 1 second"))).alias("ts"), "n", F.col("ts").alias("_from"))
    near = spread.groupBy(group, "ts").agg(F.sum("n").alias("n"), F.max(F.when(F.col("_from") == F.col("ts"), 1)).alias("_own"))
    return near.where("_own = 1 and n > 1").select(group, "ts", "n")


def since_change(df: DataFrame, group: str, ts: str, id: str, value: str, bucket: Column) -> DataFrame:
    """df with changed_at: the time of the row since which value has been the same in its group, by (ts, id).

    Nulls are a value of their own. bucket is a coarse part of ts; running values stay within a bucket, and one row a
    bucket carries on what was before, so no task holds a whole group.
    """
    b = "__tf_bucket"
    before = with_neighbour(df, group, bucket, [ts, id], {value: "__tf_old", id: "__tf_old_id"}, -1).withColumn(b, bucket)
    moved = F.when(F.col("__tf_old_id").isNull() | ~F.col("__tf_old").eqNullSafe(F.col(value)), F.col(ts))
    rows = before.withColumn("__tf_moved", moved)
    within = Window.partitionBy(group, b).orderBy(ts, id).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(group, b).agg(F.max("__tf_moved").alias("__tf_last")).withColumn("__tf_far", F.max("__tf_last").over(earlier)).drop("__tf_last")
    near = rows.withColumn("__tf_near", F.max("__tf_moved").over(within))
    return near.join(carried, [group, b]).withColumn("changed_at", F.coalesce("__tf_near", "__tf_far")).select(*df.columns, "changed_at")


def first_differences(totals: DataFrame, day: str, total: str) -> DataFrame:
    """totals, one row a day, with change (the first row's is its total) and follows (the day before is there, or it is the first)."""
    order = Window.orderBy(day)
    last = F.lag(day).over(order)
    return totals.withColumns({"change": F.col(total) - F.coalesce(F.lag(total).over(order), F.lit(0)), "follows": F.coalesce(F.date_diff(F.col(day), last) == 1, F.lit(True))})


def last_before(events: DataFrame, group: str, order: str, asks: Column, known: Column, bucket: Column) -> DataFrame:
    """group, order, before for every row where asks holds: the order of the last earlier row of its group where known holds.

    order is unique within a group and bucket a coarse part of it: windows run within a bucket, one row a bucket carries on.
    """
    rows = events.select(group, order, asks.alias("_ask"), F.when(known, F.col(order)).alias("_known"), bucket.alias("_b"))
    near = rows.withColumn("_near", F.max("_known").over(Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))).where("_ask")
    lasts = rows.groupBy(group, "_b").agg(F.max("_known").alias("_last"))
    far = lasts.withColumn("_far", F.max("_last").over(Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    return near.join(far, [group, "_b"]).select(group, order, F.coalesce("_near", "_far").alias("before"))
