"""Data-quality checks; each gives the rows that break it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str, ignoring: Sequence[str] = ()) -> DataFrame:
    """key, n_rows, n_versions of keys with several rows; versions differ in a column that is not ignored. Null keys count as a key."""
    content = F.xxhash64(*[F.to_json(F.struct(F.col(c))) if "map" in t else F.col(c) for c, t in df.dtypes if c not in ignoring])
    return df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n_rows"), F.count_distinct(content).alias("n_versions")).where("n_rows > 1")


def one_sided_edges(forward: DataFrame, backward: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """a, b, side of links that only one side tells: `forward` or `backward`. Both sides have columns a and b; repeats count once.

    Links of several kinds, told apart by the columns of kinds, which come first in the result, share one shuffle.
    """
    both = forward.select(*kinds, "a", "b", F.lit(1).alias("f"), F.lit(0).alias("r")).unionByName(backward.select(*kinds, "a", "b", F.lit(0).alias("f"), F.lit(1).alias("r")))
    sides = both.where("a is not null and b is not null").groupBy(*kinds, "a", "b").agg(F.max("f").alias("f"), F.max("r").alias("r"))
    return sides.where("f + r = 1").select(*kinds, "a", "b", F.when(F.col("f") == 1, "forward").otherwise("backward").alias("side"))


def several_parents(edges: DataFrame) -> DataFrame:
    """Children b that more than one parent a names: b, n_parents."""
    return edges.where("a is not null and b is not null").groupBy("b").agg(F.count_distinct("a").alias("n_parents")).where("n_parents > 1")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """value, side of distinct values in only one of two one-column tables: `left` or `right`. Null is no value."""
    l, r = left.toDF("value").withColumn("s", F.lit(1)), right.toDF("value").withColumn("s", F.lit(2))
    sides = l.unionByName(r).where("value is not null").groupBy("value").agg(F.bit_or("s").alias("s"))
    return sides.where("s <> 3").select("value", F.when(F.col("s") == 1, "left").otherwise("right").alias("side"))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, change of every key in two snapshots with one row a key: `added`, `removed`, `changed` or `same`.

    Rows are compared by a 64-bit hash of their other columns, so only keys and hashes are shuffled. Null keys are left out.
    """
    def hashed(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in sorted(df.columns) if c != key]
        return df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(*rest).alias(name))

    both = hashed(old, "_o").join(hashed(new, "_n"), "key", "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "same").otherwise("changed")
    return both.select("key", change.alias("change"))


def violations(df: DataFrame, table: str, key: Column, checks: dict[str, Column]) -> DataFrame:
    """table_name, key, check of every row that breaks a check. checks: name to a condition that must hold; null breaks it."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return df.select(F.lit(table).alias("table_name"), key.alias("key"), F.explode(failed).alias("check"))


def not_bijective(df: DataFrame, a: str, b: str) -> DataFrame:
    """side, value, n of values of a with several b (`a`) and of b with several a (`b`). Rows with a null on either side count for neither."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()
    def several(x: str, side: str) -> DataFrame:
        return pairs.groupBy(F.col(x).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(side).alias("side"), "value", "n")

    return several(a, "a").unionByName(several(b, "b"))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """field, n_changed, n_rows: field by field, how many rows of old differ from the row of new with their key. Nulls are equal to each other."""
    renamed = new.select(key, *[F.col(f).alias(f"_new_{i}") for i, f in enumerate(fields) if f != key])
    changed = [F.struct(F.lit(f).alias("field"), (F.lit(False) if f == key else ~F.col(f).eqNullSafe(F.col(f"_new_{i}"))).alias("c")) for i, f in enumerate(fields)]
    rows = old.join(renamed, key).select(F.inline(F.array(*changed)))
    return rows.groupBy("field").agg(F.count_if("c").alias("n_changed"), F.count("*").alias("n_rows"))


def configured_order(df: DataFrame, name: str, order: Sequence[str], place: str) -> DataFrame:
    """df, a short list of distinct names, with their place: names in the configured order first, all others by name as a dictionary sorts them."""
    known = F.array(*[F.lit(x) for x in order])
    rank = F.coalesce(F.nullif(F.array_position(known, F.col(name)), F.lit(0)), F.lit(len(order) + 1))
    return df.withColumn(place, F.row_number().over(Window.orderBy(rank, F.collate(F.col(name), "UNICODE"))) - 1)
