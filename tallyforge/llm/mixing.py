"""Mixing sources to target shares of a total in tokens.

Documents are counted by source and exact token length. For every source a budget is filled from that histogram: whole
repeats first, then a proportional draw from every length, then a bounded-knapsack program that closes the rest to the
token. Which documents of a length are drawn follows a seeded hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.skew import broadcast_if_small, hash_rank
from tallyforge.session import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern that belongs to the vocabulary; a fixed value of its public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sums up to this many tokens are searched first when a budget is closed; the window grows until nothing better can exist.
WINDOW = 1 << 16


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text by a public byte-pair vocabulary; 0 for null."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(x)) if x else 0 for x in batch], dtype="int64")

    return F.pandas_udf(each, "bigint")(text)


def close_budget(available: dict[int, int], taken: dict[int, int], rest: int, window: int = WINDOW) -> int:
    """Change taken, counts by length within available, so that the rest that stays uncovered is as small as it gets.

    Lengths fill greedily from the longest; then documents are put back until a window is open, and a bounded-knapsack
    program over all free lengths, as a bit set of reachable sums, finds the largest sum that fits. Returns the rest.
    """
    for n in sorted(available, reverse=True):
        k = min(available[n] - taken.get(n, 0), rest // n)
        if k > 0:
            taken[n] = taken.get(n, 0) + k
            rest -= k * n
    if not rest:
        return 0
    for n in sorted((n for n in taken if n <= window), reverse=True):
        back = min(taken[n], max(0, window - rest) // n)
        taken[n] -= back
        rest += back * n
    mask, sums, steps = (1 << (rest + 1)) - 1, 1, []
    for n in sorted(available):
        free, chunk = min(available[n] - taken.get(n, 0), rest // n), 1
        while free > 0:
            k = min(chunk, free)
            steps.append((n, k, sums))
            sums |= (sums << (k * n)) & mask
            free, chunk = free - k, chunk * 2
        if sums >> rest & 1:
            break
    at = best = sums.bit_length() - 1
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n] = taken.get(n, 0) + k
            at -= k * n
    return rest - best


def fit_source(lengths: dict[int, int], budget: int, max_repeats: int) -> tuple[int, dict[int, int]]:
    """Whole repeats of a source, and documents by length to take once more, for a budget in tokens."""
    total = sum(n * c for n, c in lengths.items())
    whole = min(budget // total, max_repeats)
    rest = budget - whole * total
    if whole == max_repeats or not rest:
        return whole, {}
    drawn = {n: c * rest // total for n, c in lengths.items()}
    step, window = gcd(*lengths), WINDOW
    while True:
        taken = dict(drawn)
        left = close_budget(lengths, taken, rest - sum(n * k for n, k in taken.items()), window)
        # every sum is a multiple of step; a window as large as the budget searches all of it
        if left < step or window >= rest:
            return whole, {n: k for n, k in taken.items() if k}
        window *= 8


def source_name(source: Column) -> Column:
    """A source for comparison: without white space of any script at either end, in lower case."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def counted(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (trimmed, lower case) and tokens of every document with a source and at least one token."""
    return materialize(
        documents.select("doc_id", source_name(F.col("source")).alias("source"), token_count(F.col("text"), vocabulary).alias("n_tokens"))
        .where("n_tokens > 0 and source is not null")
    )


def budgets(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: share, tokens there are, and its budget in tokens.

    Shares are weights over the sum of positive weights of sources that have documents; other sources get none. Without
    total_tokens the total is the largest at which every source reaches its share within its repeats.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_weight", F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    wanted = wanted.groupBy("source").agg(F.sum("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("available_documents"))
    joined = wanted.join(have, "source", "left").fillna(0, ["available_tokens", "available_documents"])
    usable = (F.col("target_weight") > 0) & (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0)
    joined = materialize(joined.withColumn("_w", F.when(usable, F.col("target_weight"))))
    whole = joined.agg(F.sum("_w")).first()[0] or 1.0
    joined = joined.withColumn("target_share", F.col("_w") / F.lit(whole)).drop("_w")
    if total_tokens is None:
        most = joined.agg(F.min(F.col("max_repeats") * F.col("available_tokens") / F.col("target_share"))).first()[0]
        total_tokens = int(most or 0)
    return joined.withColumn("budget", F.floor(F.coalesce("target_share", F.lit(0.0)) * F.lit(total_tokens)).cast("bigint"))


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares). mixture: doc_id, source, n_tokens, copies of every chosen document. shares: per target source
    what was wanted and what was reached.

    A source's histogram has at most sqrt(2 x its tokens) lengths, so one task can fit it: 14 million for 100 TB.
    """
    plan = budgets(docs, targets, total_tokens)
    counts = docs.groupBy("source", "n_tokens").agg(F.count("*").alias("n_documents"))
    fitted = materialize(
        counts.join(plan.where("budget > 0").select("source", "budget", "max_repeats"), "source")
        .groupBy("source").applyInPandas(_fit, "source string, n_tokens bigint, n_documents bigint, whole int, extra bigint")
    )
    small = broadcast_if_small(fitted)
    joined = docs.join(small, ["source", "n_tokens"]).withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(seed)))
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("n_documents"))
    drawn = hash_rank(joined.where(split), ["source", "n_tokens"], F.col("_h"), "_rank")
    chosen = joined.where(~split).withColumn("copies", F.col("whole") + (F.col("extra") > 0).cast("int")).unionByName(
        drawn.withColumn("copies", F.col("whole") + (F.col("_rank") <= F.col("extra")).cast("int")).drop("_rank")
    )
    mixed = chosen.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    got = fitted.groupBy("source").agg(
        F.sum(F.col("n_tokens") * (F.col("n_documents") * F.col("whole") + F.col("extra"))).alias("tokens"), F.max("whole").alias("whole_repeats")
    )
    everything = fitted.agg(F.sum(F.col("n_tokens") * (F.col("n_documents") * F.col("whole") + F.col("extra")))).first()[0] or 1
    shares = plan.join(got, "source", "left").fillna(0, ["tokens", "whole_repeats"]).withColumn("share", F.col("tokens") / F.lit(everything))
    return mixed, shares


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    lengths = dict(zip(rows.n_tokens.tolist(), rows.n_documents.tolist(), strict=True))
    whole, extra = fit_source(lengths, int(rows.budget.iloc[0]), int(rows.max_repeats.iloc[0]))
    return rows[["source", "n_tokens", "n_documents"]].assign(whole=whole, extra=[extra.get(n, 0) for n in rows.n_tokens.tolist()])
