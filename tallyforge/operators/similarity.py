"""Nearest neighbours of short texts by TF-IDF, and what follows from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.nearest import nearest, weighted
from tallyforge.operators.skew import broadcast_if_small
from tallyforge.session import materialize


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-case tokens of more than two characters that keep + # . and -, without edge dots and dashes or stop words."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9+#.\-]+", " "), " ")
    bare = F.transform(parts, lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
    return F.filter(bare, lambda t: (F.length(t) > 2) & ~t.isin(list(stop_words)) if stop_words else F.length(t) > 2)


def vectors(docs: DataFrame, key: str, tokens_column: str) -> DataFrame:
    """key, token, w: weights (1 + ln tf) ln((N + 1) / (df + 1)), divided by the norm of the text; weights of 0 are left out.

    docs has one row a key; its texts are shuffled once, before their tokens are rows. Weights are rounded to 12 places, so
    that the order in which tasks add does not show.
    """
    df = materialize(docs.select(F.explode(F.array_distinct(tokens_column)).alias("token")).groupBy("token").agg(F.count("*").alias("df")))
    n = docs.agg(F.count("*").alias("_n"))
    tf = docs.select(key, tokens_column).repartition(F.col(key)).select(key, F.explode(tokens_column).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    raw = tf.join(broadcast_if_small(df), "token").join(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * F.log((F.col("_n") + 1) / (F.col("df") + 1)))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.withColumn("_norm", norm).where("w > 0").select(key, "token", F.round(F.col("w") / F.col("_norm"), 12).alias("w"))


#: Rows of vectors of the texts and of the queries that a task holds, on average.
TEXT_ROWS, QUERY_ROWS = 400_000, 100_000


def neighbours(vec: DataFrame, key: str, queries: DataFrame, k: int = 4, least: float = 0.075, clusters: DataFrame | None = None, bonus: float = 0.0) -> DataFrame:
    """query, match, sim, place: the k most similar texts of each query text; equal similarities by key.

    vec: key, token, w, written once by the caller. queries: the keys that are asked, one column; they are searched against
    all. They must be classes of equal texts or a stated part of all keys. clusters (key, cluster) adds `bonus` to pairs of one
    cluster; pairs without a common token are never similar enough.

    Queries and texts are cut into blocks by hashes of their keys. A task holds one block of each and gives the k best texts
    of every query, so pairs are neither shuffled nor written, and no task gets all texts that hold a token.
    """
    rows = vec.select(F.col(key).alias("key"), "token", "w")
    if clusters is not None:
        rows = rows.unionByName(clusters.select(F.col(key).alias("key"), F.col("cluster").alias("token"), F.lit(None).cast("double").alias("w")))
    asked = materialize(rows.join(broadcast_if_small(queries.select(F.col(key).alias("key")).distinct()), "key", "left_semi"))
    across, down = (max(1, math.ceil(x.count() / most)) for x, most in ((rows, TEXT_ROWS), (asked, QUERY_ROWS)))
    own = F.xxhash64("key")
    left, right = (x.select("key", "token", "w", F.pmod(own, F.lit(n)).cast("int").alias(block)) for x, n, block in ((asked, down, "_q"), (rows, across, "_t")))
    return _best(left, right, down, across, lambda q, t: nearest(q, t, k, least, bonus), k)


def similar_texts(docs: DataFrame, key: str, tokens_column: str, asked: str, k: int = 4, least: float = 0.075, cluster: Column | None = None, bonus: float = 0.0) -> DataFrame:
    """As neighbours over vectors(docs) with the rows of docs as queries for which asked is true, and `cluster` of each row.

    docs has one row a key and is written once by the caller. Texts are shuffled whole, once a block of queries, and with every
    block a row for each of its tokens, with the number of texts that hold it; weights are made where texts are compared, so
    neither vectors nor pairs are shuffled or written.
    """
    distinct = F.array_distinct(tokens_column)
    size = F.coalesce(F.size(distinct), F.lit(0))
    n, most_texts, most_asked = docs.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col(asked), size)), F.lit(0))).first()
    across, down = (max(1, math.ceil(x / most)) for x, most in ((most_texts, TEXT_ROWS), (most_asked, QUERY_ROWS)))
    own, none = F.xxhash64(key), F.lit(None)
    counts = materialize(docs.select(F.pmod(own, F.lit(across)).cast("int").alias("_t"), F.explode(distinct).alias("text")).groupBy("_t", "text").agg(F.count("*").alias("df")))
    df = broadcast_if_small(materialize(counts.groupBy("text").agg(F.sum("df").alias("df"))))
    kind = dict(docs.dtypes)[key]

    def block(rows: DataFrame, held: DataFrame, at: str, n: int) -> DataFrame:
        words = held.join(df, "text").select(none.cast(kind).alias("key"), "text", "df", none.cast("string").alias("cluster"), at)
        texts = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.array_join(tokens_column, " ").alias("text"), none.cast("bigint").alias("df"), (none.cast("string") if cluster is None else cluster).alias("cluster"), F.pmod(own, F.lit(n)).cast("int").alias(at))
        return texts.unionByName(words)

    queries = docs.where(F.col(asked))
    left = block(queries, queries.select(F.pmod(own, F.lit(down)).cast("int").alias("_q"), F.explode(distinct).alias("text")).distinct(), "_q", down)
    right = block(docs, counts.select("_t", "text"), "_t", across)
    return _best(left, right, down, across, lambda q, t: nearest(weighted(q, n), weighted(t, n), k, least, bonus), k)


def _best(asked: DataFrame, texts: DataFrame, down: int, across: int, search: Callable[[pa.Table, pa.Table], pa.Table], k: int) -> DataFrame:
    """Each block _q of asked, of which there are `down`, meets each block _t of texts, of which there are `across`, in search; of what it finds the k best of each query."""
    left, right = (x.withColumn(block, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) for x, block, n in ((asked, "_t", across), (texts, "_q", down)))
    cells = 4 * across * down  # more partitions than blocks, so that few blocks share a task
    left, right = (x.repartition(cells, "_q", "_t").groupBy("_q", "_t") for x in (left, right))
    kind = dict(texts.dtypes)["key"]
    found = left.cogroup(right).applyInArrow(search, f"`query` {kind}, `match` {kind}, sim double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "match"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("query", "match", F.round("sim", 6).alias("sim"), "place")


def rounded(number: Column, places: int) -> Column:
    """A number that is not negative, rounded as SQL does it on doubles: multiplied first, so that 0.76055 gives 0.7605."""
    return F.floor(number * 10.0**places + 0.5) / 10.0**places


def undirected(edges: DataFrame) -> DataFrame:
    """a, b, weight of each pair once, a before b; weight rounded to 4 places, as SQL does it."""
    return (
        edges.select(F.least("query", "match").alias("a"), F.greatest("query", "match").alias("b"), rounded(F.col("sim"), 4).alias("weight"))
        .groupBy("a", "b").agg(F.max("weight").alias("weight"))
    )


def weighted_degree(edges: DataFrame) -> DataFrame:
    """node, degree: the sum of the weights of a node's edges."""
    ends = edges.select(F.col("a").alias("node"), "weight").unionByName(edges.select(F.col("b").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.round(F.sum("weight"), 4).alias("degree"))


def best_cluster(text: Column, name: Column, clusters: dict[str, Sequence[str]]) -> Column:
    """The cluster with the highest keyword score: 1 for a keyword in text, 2.5 more if it is in name; the first one wins ties.

    Keywords match anywhere in lower-case text that is padded with spaces. No match gives `other`.
    """
    padded, title = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), F.lower(F.coalesce(name, F.lit("")))
    scores = []
    for i, (cluster, words) in enumerate(clusters.items()):
        score = sum((padded.contains(w).cast("int") + title.contains(w).cast("int") * 2.5 for w in words), F.lit(0.0))
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(cluster).alias("cluster")))
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] > 0, best["cluster"]).otherwise("other")


def influence_of(degree: Column, stars: Column) -> Column:
    """4 x weighted degree + 2.4 x log2(stars + 1); null degrees and stars count 0."""
    return F.round(4 * F.coalesce(degree, F.lit(0.0)) + 2.4 * F.log2(F.coalesce(stars, F.lit(0)) + 1), 4)


def influence(degrees: DataFrame, nodes: DataFrame, node: str, stars: str) -> DataFrame:
    """node, influence of each node; nodes without an edge have degree 0."""
    return nodes.join(degrees.withColumnRenamed("node", node), node, "left").select(F.col(node).alias("node"), influence_of(F.col("degree"), F.col(stars)).alias("influence"))
