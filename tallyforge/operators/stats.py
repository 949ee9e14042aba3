"""Counts for release statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def domain_counts(df: DataFrame, value: Column, domain: Sequence[str]) -> DataFrame:
    """value, n for every member of a closed domain, 0 where none; all other values, null included, count as `(other)`.

    One aggregation with as many cells as the domain; an empty table gives zeros.
    """
    known = F.when(value.isin(list(domain)), value).otherwise("(other)")
    counts = df.groupBy(known.alias("value")).agg(F.count("*").alias("n"))
    fixed = df.sparkSession.createDataFrame([(v,) for v in [*domain, "(other)"]], "value string")
    return F.broadcast(fixed).join(counts, "value", "left").fillna(0, ["n"])


def tri_state(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """name, n_true, n_false, n_null of boolean columns, in one pass over the rows."""
    cells = [
        F.struct(
            F.lit(name).alias("name"),
            F.count_if(c).alias("n_true"),
            F.count_if(~c).alias("n_false"),
            F.count_if(c.isNull()).alias("n_null"),
        )
        for name, c in columns.items()
    ]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def share_of_total(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group and their part of all rows. The total comes from the groups, not from a second scan."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("_whole"))
    return counts.join(F.broadcast(whole)).withColumn("share", F.col("n") / F.col("_whole")).drop("_whole")


def instances_and_entities(df: DataFrame, by: Sequence[str], entity: str) -> DataFrame:
    """Rows and distinct entities per group; null entities count as rows only. Distinct pairs are combined first."""
    pairs = df.groupBy(*by, entity).agg(F.count("*").alias("_n"))
    return pairs.groupBy(*by).agg(F.sum("_n").alias("n_instances"), F.count(entity).alias("n_entities"))


def claims_report(spark: SparkSession, statistics: DataFrame, claims: Sequence[tuple[str, int]]) -> DataFrame:
    """name, claimed, actual, holds for claimed values of the statistics in a one-row table.

    A claim about a statistic that does not exist does not hold and has no actual value.
    """
    rows = statistics.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("actual")) for c in statistics.columns])))
    wanted = spark.createDataFrame(list(claims), "name string, claimed bigint")
    return F.broadcast(wanted).join(rows, "name", "left").withColumn("holds", F.coalesce(F.col("claimed") == F.col("actual"), F.lit(False)))


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values with their counts; ties by value. Only k rows leave each task."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def ranked(df: DataFrame, order: Sequence[Column], place: str) -> DataFrame:
    """A short report with the place of each row from 1. All rows meet in one task: only for results of few rows."""
    return df.withColumn(place, F.row_number().over(Window.orderBy(*order)))
