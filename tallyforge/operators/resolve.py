"""Matching texts to their origin, and events to the first answer after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_match(left: DataFrame, right: DataFrame, on: list[str], key: str) -> DataFrame:
    """left with the key of the one right row that matches on the given columns; null if there is none or a tie.

    Right rows are folded to one a match before the join, so ties and hot values cost one row.
    """
    folded = right.groupBy(*on).agg(F.count_distinct(key).alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")
    return left.join(folded, on, "left")


def first_after(events: DataFrame, group: str, ts: str, id: str, asks: Column, answers: Column, bucket: Column) -> DataFrame:
    """id, answer_ts for every row where asks holds: the time of the first later row of its group where answers holds.

    Rows with equal times are ordered by id. bucket is a coarse part of the time: within a bucket a window looks ahead,
    across buckets one row a bucket does, so no task holds a whole group.
    """
    rows = events.select(group, ts, id, asks.alias("_ask"), answers.alias("_answer"), bucket.alias("_b"))
    ahead = Window.partitionBy(group, "_b").orderBy(ts, id).rowsBetween(1, Window.unboundedFollowing)
    near = rows.withColumn("_near", F.min(F.when(F.col("_answer"), F.col(ts))).over(ahead)).where("_ask")
    firsts = rows.groupBy(group, "_b").agg(F.min(F.when(F.col("_answer"), F.col(ts))).alias("_first"))
    later = Window.partitionBy(group).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    nexts = firsts.withColumn("_far", F.min("_first").over(later)).drop("_first")
    return near.join(nexts, [group, "_b"]).select(group, id, F.coalesce("_near", "_far").alias("answer_ts"))


def overlap(a: Column, b: Column) -> Column:
    """How many distinct words of at least four characters two texts share."""
    return F.size(F.array_intersect(significant_words(a), significant_words(b)))


def significant_words(text: Column) -> Column:
    """Distinct lower-case words of at least four letters or digits; null text has none."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 4))


def best_match(pairs: DataFrame, item: str, candidate: str, score: str, least: int) -> DataFrame:
    """item, candidate, score of the best candidate of each item that scores at least `least`; items with a tie for the best get none."""
    top = pairs.where(F.col(score) >= least).groupBy(item, score).agg(F.count_distinct(candidate).alias("_n"), F.min(candidate).alias(candidate))
    return top.groupBy(item).agg(F.max_by(F.struct(candidate, "_n", score), score).alias("_t")).where("_t._n = 1").select(item, f"_t.{candidate}", f"_t.{score}")


def best_overlap(asked: DataFrame, heard: DataFrame, group: str, ids: list[str], candidate: str, least: int) -> DataFrame:
    """group, ids, candidate, score of the candidate of the same group that shares most words with each asked row, at least `least`;
    ties are rejected.

    asked: group, ids, w (distinct words); heard: group, candidate, word, distinct. A candidate that shares least words has
    one of all but the least - 1 words that are most frequent in the group, so only those look for candidates. Both are
    materialised by the caller.
    """
    words = asked.select(group, *ids, F.explode("w").alias("word"), F.size("w").alias("_n")).where(F.col("_n") >= least)
    often = heard.groupBy(group, "word").agg(F.count("*").alias("_df"))
    place = F.row_number().over(Window.partitionBy(group, *ids).orderBy("_df", "word"))
    rare = words.join(often, [group, "word"]).withColumn("_k", place)
    most = Window.partitionBy(group, *ids)
    rare = rare.withColumn("_m", F.count("*").over(most)).where(F.col("_k") <= F.col("_m") - (least - 1)).select(group, *ids, "word")
    near = rare.join(heard, [group, "word"]).select(group, *ids, candidate).distinct()
    scored = near.join(words.select(group, *ids, "word"), [group, *ids]).join(heard, [group, candidate, "word"]).groupBy(group, *ids, candidate).agg(F.count("*").alias("score"))
    top = scored.where(F.col("score") >= least).groupBy(group, *ids, "score").agg(F.count("*").alias("_n"), F.min(candidate).alias(candidate))
    best = top.groupBy(group, *ids).agg(F.max_by(F.struct(candidate, "_n", "score"), "score").alias("_t"))
    return best.where("_t._n = 1").select(group, *ids, f"_t.{candidate}", "_t.score")
