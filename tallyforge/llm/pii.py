"""Personal details in free text, by weak supervision.

Regular expressions, gazetteers and contexts vote on candidate spans. Expectation-maximisation over the counts of all vote
patterns estimates how reliable each labeler is, without labels. Its probabilities teach a logistic classifier on the
spans' votes, neighbours and shapes, which decides, also between overlapping candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import pii_spans as ps
from tallyforge.session import materialize, spread

#: Candidates of which the classifier is fitted, about, and slots of its hashed features. Smaller inputs are taken whole.
TRAIN_CANDIDATES = 20_000
SLOTS = 1 << 13
#: How sure prior knowledge of the labelers is, as a part of all candidates of a kind.
PRIOR = 0.1
THRESHOLD = 0.5

_SPAN = "array<struct<kind:string, start:int, stop:int, value:string, votes:string, feats:array<int>>>"


def candidate_spans(body: Column) -> Column:
    """All candidates of a text with their votes and features."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_candidates(x) if x else [] for x in batch], dtype=object)

    return F.pandas_udf(each, _SPAN)(body)


def _candidates(text: str) -> list[tuple]:
    found = ps.candidates(text)
    out = []
    for kind, start, end in found:
        vote = ps.votes(text, kind, start, end, found)
        out.append((kind, start, end, text[start:end], ",".join(map(str, vote)), ps.features(text, kind, start, end, vote, SLOTS)))
    return out


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """The probability of a detail for each vote pattern, by expectation-maximisation over the patterns' counts.

    Labelers are taken as independent given the truth. Priors say that positive votes come more from details and negative
    ones from others; they keep the two sides from changing places.
    """
    votes = np.array(list(patterns), dtype=int) + 1  # 0: against, 1: can't say, 2: for
    n = np.array(list(patterns.values()), dtype=float)
    mass = PRIOR * n.sum()
    yes, no = np.array([0.05, 0.35, 0.6]) * mass, np.array([0.6, 0.35, 0.05]) * mass
    p = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float)))
    for _ in range(rounds):
        share = (p @ n + mass) / (n.sum() + 2 * mass)
        odds = np.full(len(n), np.log(share / (1 - share)))
        for j in range(votes.shape[1]):
            for_yes, for_no = yes.copy(), no.copy()
            np.add.at(for_yes, votes[:, j], p * n)
            np.add.at(for_no, votes[:, j], (1 - p) * n)
            odds += np.log(for_yes / for_yes.sum())[votes[:, j]] - np.log(for_no / for_no.sum())[votes[:, j]]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(patterns, p.tolist(), strict=True))


def fit_classifier(features: list[list[int]], target: np.ndarray, epochs: int = 30, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model on hashed features for soft targets; full gradients with a step size per slot."""
    width = max(map(len, features))
    index = np.array([f + [SLOTS] * (width - len(f)) for f in features])
    weight, squares = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-8)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(weight[index].sum(axis=1), -30, 30)))
        gradient = decay * weight
        np.add.at(gradient, index.ravel(), np.repeat((p - target) / len(target), width))
        gradient[SLOTS] = 0
        squares += gradient * gradient
        weight -= rate * gradient / np.sqrt(squares)
    return weight


@dataclass
class Model:
    """The span classifier; patterns keeps the probabilities that taught it."""

    weight: np.ndarray
    patterns: dict[str, dict[tuple[int, ...], float]]


def train(spans: DataFrame, ids: list[str]) -> Model:
    """A model from ids and a column spans of candidates. Vote patterns count over all candidates, at most 3^7 a kind.

    The classifier's sample is drawn by a hash of the row and the candidate, so copies of a text share no fate.
    """
    each = spans.select(*ids, F.inline("spans"))
    counts: dict[str, dict[tuple[int, ...], int]] = {}
    for kind, votes, n in each.groupBy("kind", "votes").count().collect():
        counts.setdefault(kind, {})[tuple(map(int, votes.split(",")))] = n
    patterns = {kind: reliabilities(c) for kind, c in counts.items()}
    part = min(1.0, TRAIN_CANDIDATES / max(1, sum(n for c in counts.values() for n in c.values())))
    by_hash = F.pmod(F.xxhash64(*ids, "value", "start"), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))
    sample = each.where(by_hash).select("kind", "votes", "feats").collect()
    if not sample:
        return Model(np.zeros(SLOTS + 1), patterns)
    target = [patterns[r.kind][tuple(map(int, r.votes.split(",")))] for r in sample]
    features = [list(r.feats) for r in sample]
    # names are taught a second time as if no list knew them, so that what stands around a name decides where the list can't say
    known, unknown = ps.slot("name|v31", SLOTS), ps.slot("name|v30", SLOTS)
    blind = [(f, t) for f, t in zip(features, target, strict=True) if known in f]
    features += [[unknown if x == known else x for x in f] for f, _ in blind]
    return Model(fit_classifier(features, np.array(target + [t for _, t in blind])), patterns)


def chosen(spans: list, weight: np.ndarray) -> list[tuple[str, int, int, str]]:
    """The details among a text's candidates: likely ones, and of overlapping ones the longer, then the likelier; of names the likelier."""
    scored = [(s["kind"], s["start"], s["stop"], s["value"], float(weight[np.asarray(s["feats"], dtype=int)].sum())) for s in spans]
    out: list[tuple[str, int, int, str]] = []
    for kind, start, stop, value, score in sorted(scored, key=lambda s: (s[0] == "name", 0 if s[0] == "name" else s[1] - s[2], -s[4])):
        if score > np.log(THRESHOLD / (1 - THRESHOLD)) and all(stop <= s or start >= e for _, s, e, _ in out):
            out.append((kind, start, stop, value))
    return sorted(out, key=lambda s: s[1])


_DETAIL = "array<struct<kind:string, start:int, stop:int, value:string>>"


def _chosen(found: DataFrame, ids: list[str]) -> Column:
    """The details among the candidates in column spans, by a model fitted on them."""
    shared = found.sparkSession.sparkContext.broadcast(train(found, ids).weight)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([chosen(x, shared.value) for x in batch], dtype=object)

    return F.pandas_udf(each, _DETAIL)("spans")


def details(texts: DataFrame, ids: list[str]) -> DataFrame:
    """ids, kind, start, stop, value of every personal detail in column body. Null and empty bodies have none."""
    spans = candidate_spans(F.col("body"))
    found = materialize(spread(texts.where("body is not null")).select(*ids, spans.alias("spans")).where(F.size("spans") > 0))
    return found.select(*ids, F.inline(_chosen(found, ids)))


def redact(texts: DataFrame, ids: list[str]) -> DataFrame:
    """ids and body with every detail replaced by its typed placeholder such as [EMAIL]; the rest stays as it is.

    Bodies are written once beside their candidates, so details are cut out, from the end on, of the very text they were
    found in, and no row moves. Null bodies stay null.
    """
    found = materialize(spread(texts).select(*ids, "body", candidate_spans(F.col("body")).alias("spans")))
    replaced = F.aggregate(
        F.reverse(_chosen(found, ids)), F.col("body"),
        lambda b, s: F.concat(F.substring(b, F.lit(1), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"), F.substring(b, s["stop"] + 1, F.length(b))),
    )
    return found.select(*ids, F.when(F.size("spans") > 0, replaced).otherwise(F.col("body")).alias("body"))
