"""Evaluation passages in a training corpus, by a prefix-filtered set join.

A window of an item leaks into a document if its words stand there one after the other and at most one in eight is
another word. Such a window shares a known number of shingles with the document, so a document that shares none of the
window's rarest shingles - its prefix - can't hold it. Prefixes find candidates, length and position bound them, and the
words of item and document decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.words import words
from tallyforge.operators.skew import broadcast_if_small
from tallyforge.session import materialize

SHINGLE = 5
LEAST_WORDS = 20
#: One word in so many may be another.
TOLERANCE = 8
#: Size of the bit set that sorts out shingles of no item (a power of two: 16 MB), and words whose hashes a task keeps.
FILTER_BITS = 27
KEPT_WORDS = 500_000

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def prefix_positions(frequency: list[int], n: int = SHINGLE, least: int = LEAST_WORDS, tolerance: int = TOLERANCE) -> list[int]:
    """Positions of the shingles of an item of which every leaked window shares at least one with the document.

    frequency has the document frequency of each shingle, in order of position. A window of w words with m others keeps
    at least w - n + 1 - n * m of its w - n + 1 shingles. A long leaked window holds a leaked one of fewer than twice the
    least length, so only those lengths count. Rarer shingles come first, then the later position. Items shorter than the
    least length have no window.
    """
    length = len(frequency) + n - 1
    rank = np.empty(len(frequency), np.int64)
    rank[sorted(range(len(frequency)), key=lambda i: (frequency[i], -i))] = np.arange(len(frequency))
    chosen = np.zeros(len(frequency), bool)
    for w in range(least, min(length, 2 * least - 1) + 1):
        size = w - n + 1
        shared = size - n * (w // tolerance)
        if shared < 1:
            raise ValueError("a window may share no shingle: take shorter shingles or a smaller tolerance")
        keep = size - shared + 1
        windows = np.lib.stride_tricks.sliding_window_view(rank, size)
        for start in range(0, len(windows), 50_000):
            part = windows[start : start + 50_000]
            rarest = np.argpartition(part, keep - 1, axis=1)[:, :keep]
            chosen[(rarest + np.arange(start, start + len(part))[:, None]).ravel()] = True
    return np.flatnonzero(chosen).tolist()


def holds(item: np.ndarray, document: np.ndarray, shift: int, least: int = LEAST_WORDS, tolerance: int = TOLERANCE) -> bool:
    """Whether a long enough window of the item stands in the document at positions shifted by shift."""
    lo, hi = max(0, -shift), min(len(item), len(document) - shift)
    if hi - lo < least:
        return False
    other = item[lo:hi] != document[lo + shift : hi + shift]
    sums = np.concatenate([[0], np.cumsum(1 - tolerance * other.astype(np.int64))])
    return bool((sums[least:] >= np.minimum.accumulate(sums[: len(sums) - least])).any())


def leaked(a: np.ndarray, b: np.ndarray, shifts: list[int], least: int = LEAST_WORDS, tolerance: int = TOLERANCE) -> bool:
    """Whether a document with words b holds a window of an item with words a at one of the given shifts."""
    return any(holds(a, b, int(shift), least, tolerance) for shift in shifts)


def _filter(shingle_ids: DataFrame) -> np.ndarray:
    """A bit set of hashes of the given shingles, of fixed size however many there are; it never misses one."""
    slot = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(63).cast("int"))
    rows = shingle_ids.groupBy(F.shiftright(slot, 6).alias("k")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("k").to_numpy()] = rows.column("bits").to_numpy()
    return out


class _Shingler:
    """Words of texts and the shingles of a batch; hashes of words are kept for later batches of a task."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}

    def __call__(self, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words of each text; the hashes of all words; and text, place and hash of every shingle."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        worded = [words(x) if x else [] for x in texts]
        known = self.known
        for w in {w for ws in worded for w in ws}.difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        size = np.fromiter(map(len, worded), np.int64, len(worded))
        ids = np.fromiter((known[w] for ws in worded for w in ws), np.uint64, int(size.sum()))
        count = np.maximum(size - self.n + 1, 0)
        text = np.repeat(np.arange(len(worded)), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        first = (np.cumsum(size) - size)[text] + at
        h = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                h = (h ^ ids[first + k]) * _PRIME
                h ^= h >> np.uint64(29)
        return worded, ids.view(np.int64), text, at, h.view(np.int64)


def _split(values: np.ndarray, size: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))


def item_shingles(items: DataFrame, n: int = SHINGLE, least: int = LEAST_WORDS) -> DataFrame:
    """item_id, iw and ih (its words and their hashes), hs (its shingles in order) of every item of least words or more."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _Shingler(n)
        for batch in batches:
            worded, ids, text, _, h = shingler(batch.column("text").to_pylist())
            size = np.array([len(w) for w in worded], np.int64)
            keep = np.flatnonzero(size >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(keep)), pa.array([worded[k] for k in keep.tolist()], pa.list_(pa.string())),
                 _split(ids[np.repeat(size >= least, size)], size[keep]), _split(h[np.isin(text, keep)], size[keep] - n + 1)],
                ["item_id", "iw", "ih", "hs"],
            )

    return items.where("text is not null").select("item_id", "text").mapInArrow(each, "item_id bigint, iw array<string>, ih array<bigint>, hs array<bigint>")


def matches(documents: DataFrame, shingle_ids: DataFrame, n: int = SHINGLE, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, dw and dh (its words and their hashes) and hits, the places of every given shingle, of each document that has one; written once.

    Shingles that no item has are dropped in the batch that makes them, so that few rows leave a task.
    """
    shared = documents.sparkSession.sparkContext.broadcast(_filter(shingle_ids))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bits = _Shingler(n), shared.value
        for batch in batches:
            worded, ids, text, at, h = shingler(batch.column("text").to_pylist())
            slot = h & ((1 << FILTER_BITS) - 1)
            hit = (bits[slot >> 6] >> (slot & 63)) & 1 > 0
            text, at, h = text[hit], at[hit], h[hit]
            order = np.lexsort((at, h, text))
            text, at, h = text[order], at[order], h[order]
            new = np.ones(len(text), bool)
            new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
            first = np.flatnonzero(new)
            ats = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
            docs, count = np.unique(text[first], return_counts=True)
            every = np.array([len(w) for w in worded], np.int64)
            size = every[docs]
            hits = pa.StructArray.from_arrays([pa.array(h[first]), ats], ["h", "ats"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(docs)), pa.array(size), pa.array([worded[k] for k in docs.tolist()], pa.list_(pa.string())),
                 _split(ids[np.isin(np.repeat(np.arange(len(every)), every), docs)], size), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), hits)],
                ["doc_id", "n_words", "dw", "dh", "hits"],
            )

    schema = "doc_id bigint, n_words bigint, dw array<string>, dh array<bigint>, hits array<struct<h:bigint, ats:array<int>>>"
    return materialize(documents.select("doc_id", "text").mapInArrow(each, schema).where(F.col("n_words") >= least))


def leaks(documents: DataFrame, items: DataFrame, n: int = SHINGLE, least: int = LEAST_WORDS, tolerance: int = TOLERANCE) -> DataFrame:
    """item_id, doc_id of every document that holds a leaked window of an item, once each.

    documents: doc_id, text; items: item_id, text. Null and empty texts hold nothing.
    """
    worded = materialize(item_shingles(items, n, least))
    of_items = worded.select("item_id", F.size("iw").alias("i_words"), F.posexplode("hs").alias("i_at", "h"))
    found = matches(documents.where("text is not null"), of_items.select("h"), n, least)
    # rarity over the whole corpus
    rarity = materialize(found.select(F.explode("hits.h").alias("h")).groupBy("h").agg(F.count("*").alias("df")))
    ranked = of_items.join(broadcast_if_small(rarity), "h", "left").fillna(0, ["df"])

    def prefix(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i_at")
        return rows.iloc[prefix_positions(rows.df.tolist(), n, least, tolerance)][["item_id", "i_words", "i_at", "h"]]

    cores = documents.sparkSession.sparkContext.defaultParallelism  # items are few and costly: one task would get them all
    prefixes = ranked.repartition(2 * cores, "item_id").groupBy("item_id").applyInPandas(prefix, "item_id bigint, i_words int, i_at int, h bigint")
    prefixes = materialize(prefixes.groupBy("item_id", "i_words", "h").agg(F.sort_array(F.collect_list("i_at")).alias("i_ats")))
    # the most words that item and document can have beside each other at any shift that the shingle allows
    lowest, highest = F.array_min("ats") - F.array_max("i_ats"), F.array_max("ats") - F.array_min("i_ats")
    shift = F.least(F.greatest(lowest, F.least(F.lit(0), F.col("n_words") - F.col("i_words"))), highest)
    room = F.least(F.col("i_words"), F.col("n_words") - shift) - F.greatest(F.lit(0), -shift)
    # every shift between two places of a shingle; where it repeats so often that its pairs outnumber them, all shifts between the outermost
    pairs = F.flatten(F.transform("ats", lambda d: F.transform("i_ats", lambda i: d - i)))
    shifts = F.when(F.size("ats").cast("bigint") * F.size("i_ats") > highest - lowest + 1, F.sequence(lowest, highest)).otherwise(pairs)
    candidates = (
        found.select("doc_id", "n_words", F.inline("hits")).join(broadcast_if_small(prefixes), "h").where(room >= least)
        .groupBy("item_id", "doc_id").agg(F.array_distinct(F.flatten(F.collect_list(shifts))).alias("shifts"))
    )

    def by_hash(item: pd.Series, document: pd.Series, shifts: pd.Series) -> pd.Series:
        return pd.Series([leaked(i, d, x, least, tolerance) for i, d, x in zip(item, document, shifts, strict=True)], dtype=bool)

    def by_word(item: pd.Series, document: pd.Series, shifts: pd.Series) -> pd.Series:
        out = []
        for i, d, x in zip(item, document, shifts, strict=True):
            number = {w: k for k, w in enumerate(i)}
            a, b = (np.array([number.get(w, -1) for w in ws]) for ws in (i, d))
            out.append(leaked(a, b, x, least, tolerance))
        return pd.Series(out, dtype=bool)

    # hashes of words sort out most candidates, the words themselves decide
    near = (
        candidates.join(found.select("doc_id", "dh"), "doc_id").join(broadcast_if_small(worded.select("item_id", "ih")), "item_id")
        .where(F.pandas_udf(by_hash, "boolean")("ih", "dh", "shifts")).select("item_id", "doc_id", "shifts")
    )
    checked = (
        near.join(found.select("doc_id", "dw"), "doc_id").join(broadcast_if_small(worded.select("item_id", "iw")), "item_id")
        .where(F.pandas_udf(by_word, "boolean")("iw", "dw", "shifts"))
    )
    return checked.select("item_id", "doc_id").distinct()
