"""Sentence alignment by geometry in bitext space.

Every text pair spans a plane: places in the English text by places in the Russian one. Words that may translate each other
are points in it. Around every point a rectangle is searched for points that follow the slope of the text pair, across the
ends of sentences; what it holds is the point's support. Where two sentences compete for a word, the rectangle doubles until
one has clearly more support, or the text ends. Points whose word is drawn to another sentence on either side are noise, and
so are lone weak ones. The remaining points form slope-consistent chains. Sentences in another order give chains off the
diagonal, and omissions gaps between chains. Chains are cut at the ends of sentences; each cell of two sentences that its part
of the chains covers well enough becomes a pair, and cells that share a sentence are blocks of merged sentences. Words of
cells that fail are free again for another search.

Translations are learned from the texts themselves: first from words that stand in the same text pairs more often than by
chance, then again from words in those sentence pairs of the first lexicon that cover both sentences.

Texts are read once: tokens are hashed, placed and numbered by sentence, a batch of texts at a time, and kept as arrays.
All further steps work on the arrays of many texts at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialize, spread

#: Links that are sent to every task; a larger lexicon is joined to the texts instead.
MAX_LINKS = 2_000_000
#: Least strength of a link, and the number of units at which a link counts half as much as its correlation.
LEAST_LINK = 0.12
DOUBT = 1.0
#: Words are compared by so many first letters, which forgives endings.
STEM = 7
#: Part of a sentence's translatable words that must be covered by chains.
COVER = 0.72
#: The strength of a rare word that has no link though it is in many units, and the number of units at which it is half that.
UNLINKED = 0.5
UNSEEN = 10.0
#: Part of both sentences that must be covered for a pair to teach the lexicon.
LEARN = 0.5
#: Least mean strength of the covered words of the better covered sentence: weaker links are chance.
LEAST_MEAN = 0.3
#: Characters from a point to the ends of its first rectangle, and the lead that settles between two sentences.
REACH = 30.0
LEAD = 0.15
#: A word and its translation that stand this often beside each other in a text pair are placed along chains of rarer words only.
HOT = 400
#: Texts that are worked on at once.
CHUNK = 1000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LETTER, _OTHER, _JOIN, _SPACE, _UPPER, _STOP, _CYRILLIC, _LATIN = (1 << k for k in range(8))


def _kind(c: str) -> int:
    category = unicodedata.category(c)
    out = 0
    if category[0] in "LM":
        name = unicodedata.name(c, "")
        out = _LETTER | (_UPPER if category == "Lu" else 0) | (_CYRILLIC if name.startswith("CYRILLIC") else _LATIN if name.startswith("LATIN") else 0)
    elif category[0] == "N" or c == "_":
        out = _OTHER
    elif c in "./@:":
        out = _JOIN | (_STOP if c == "." else 0)
    elif c in "!?":
        out = _STOP
    elif c.isspace():
        out = _SPACE
    return out


def _lower(c: str) -> int:
    low = c.lower()
    return ord(low) if len(low) == 1 else ord(c)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What every character of the basic plane is, and its lower case."""
    plane = [chr(i) for i in range(1 << 16)]
    return np.array([_kind(c) for c in plane], np.uint8), np.array([_lower(c) for c in plane], np.uint64)


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds and lower case of all characters of the texts, a zero behind each text, and where each text starts."""
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, lowers = _tables()
    inside = np.minimum(codes, (1 << 16) - 1)
    kind, lower = kinds[inside], lowers[inside]
    for code in np.unique(codes[codes >> 16 > 0]).tolist():
        at = codes == code
        kind[at], lower[at] = _kind(chr(code)), _lower(chr(code))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return kind, lower, np.cumsum(sizes) - sizes


@dataclass
class Side:
    """The tokens of many texts in one language: text, word, place, sentence of each; sentences and length of each text."""

    text: np.ndarray
    word: np.ndarray
    at: np.ndarray
    sentence: np.ndarray
    sentences: np.ndarray
    length: np.ndarray


def tokenize(texts: list[str]) -> tuple[Side, np.ndarray]:
    """The tokens of texts, and the letters of each text that are Latin less those that are Cyrillic.

    A word is the hash of its first letters in lower case, an even number; names and numbers, which hold a digit or
    _ . / @ : between letters, are odd and hashed whole. A sentence ends at . ! or ? before white space and a capital letter.
    """
    kind, lower, starts = _characters(texts)
    word = (kind & (_LETTER | _OTHER)) > 0
    token = word.copy()
    token[1:-1] |= ((kind[1:-1] & _JOIN) > 0) & word[:-2] & word[2:]
    begin = np.flatnonzero(token & ~np.concatenate([[False], token[:-1]]))
    end = np.flatnonzero(token & ~np.concatenate([token[1:], [False]])) + 1
    size = end - begin
    where = np.flatnonzero(token)
    owner = np.repeat(np.arange(len(begin)), size)
    place = where - begin[owner]
    odd = np.concatenate([[0], np.cumsum((kind & _LETTER) == 0)])
    name = odd[end] > odd[begin]
    longest = int(size.max()) if len(size) else 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(longest, _PRIME, np.uint64))
        mixed = (lower[where] + np.uint64(1)) * power[place]
        mixed[(place >= STEM) & ~name[owner]] = 0
        h = np.add.reduceat(mixed, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
        h = (h ^ (h >> np.uint64(31))) * _PRIME
        h ^= h >> np.uint64(29)
    h = ((h | np.uint64(2)) & ~np.uint64(1)) | name.astype(np.uint64)  # never 0
    text = np.searchsorted(starts, begin, "right") - 1
    # a sentence starts at a capital behind white space behind a stop
    space = (kind & _SPACE) > 0
    last = np.maximum.accumulate(np.where(space, 0, np.arange(len(kind))))
    capital = np.flatnonzero(((kind & _UPPER) > 0) & np.concatenate([[False], space[:-1]]))
    head = capital[(kind[last[capital - 1]] & _STOP) > 0]
    head_text = np.searchsorted(starts, head, "right") - 1
    first = np.searchsorted(head_text, np.arange(len(texts)))
    sentence = np.searchsorted(head, begin, "right") - first[text]
    script = np.add.reduceat(((kind & _LATIN) > 0).astype(np.int64) - ((kind & _CYRILLIC) > 0), starts)
    side = Side(
        text, h.view(np.int64), (begin + end) / 2 - starts[text], sentence,
        np.bincount(head_text, minlength=len(texts)) + 1, np.diff(np.append(starts, len(kind))) - 1,
    )
    return side, script


_ARRAYS = [f"{s}_{c} array<{t}>" for s in "er" for c, t in (("word", "bigint"), ("at", "float"), ("sentence", "int"))]
_SIZES = [f"{s}_{c} bigint" for s in "er" for c in ("sentences", "length")]


def _types(df: DataFrame, ids: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids]


def tokenized(texts: DataFrame, ids: list[str]) -> DataFrame:
    """ids and the tokens of columns en and ru as arrays, written once.

    Only rows whose en is mostly Latin and whose ru is mostly Cyrillic are kept: null, empty and untranslated texts pair
    with nothing.
    """
    names = [x.split()[0] for x in _ARRAYS + _SIZES]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                sides = [tokenize(batch.column(c).to_pylist()) for c in ("en", "ru")]
                keep = np.flatnonzero((sides[0][1] > 0) & (sides[1][1] < 0))
                columns = [batch.column(c).take(pa.array(keep)) for c in ids]
                sizes = []
                for side, _ in sides:
                    wanted = np.isin(side.text, keep)
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(side.text, minlength=batch.num_rows)[keep])]).astype(np.int32))
                    for x, t in ((side.word, pa.int64()), (side.at, pa.float32()), (side.sentence, pa.int32())):
                        columns.append(pa.ListArray.from_arrays(offsets, pa.array(x[wanted]).cast(t, safe=False)))
                    sizes += [pa.array(x[keep].astype(np.int64)) for x in (side.sentences, side.length)]
                yield pa.RecordBatch.from_arrays(columns + sizes, [*ids, *names])

    read = texts.select(*ids, "en", "ru").where("en <> '' and ru <> ''")
    schema = ", ".join(_types(texts, ids) + _ARRAYS + _SIZES)
    return spread(materialize(spread(read).mapInArrow(each, schema)))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, np.repeat(np.arange(len(column)), np.diff(offsets))


def _side(batch: pa.RecordBatch, s: str) -> Side:
    word, text = _flat(batch.column(f"{s}_word"))
    return Side(
        text, word, _flat(batch.column(f"{s}_at"))[0].astype(np.float64), _flat(batch.column(f"{s}_sentence"))[0].astype(np.int64),
        batch.column(f"{s}_sentences").to_numpy(), batch.column(f"{s}_length").to_numpy(),
    )


@dataclass
class Links:
    """The strength v of words e and their translations r. A word's own strength stands beside a 0."""

    e: np.ndarray
    r: np.ndarray
    v: np.ndarray

    def strength(self, words: np.ndarray, mine: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The strength of each word; 1 for names and numbers, 0 for words that are unknown."""
        own = (other == 0) & (mine != 0)
        order = np.argsort(mine[own])
        keys, values = mine[own][order], self.v[own][order]
        if not len(keys):
            return (words & 1).astype(float)
        k = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(words & 1, 1.0, np.where(keys[k] == words, values[k], 0.0))


def _ranges(lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges given by start and size: the range of every place in them, and the places."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner]


@dataclass
class Points:
    """Possible correspondences in order of text and place: en token, ru token, weight."""

    i: np.ndarray
    j: np.ndarray
    w: np.ndarray

    def __getitem__(self, some) -> Points:
        return Points(self.i[some], self.j[some], self.w[some])


def points(e: Side, r: Side, links: Links) -> tuple[Points, list[tuple[np.ndarray, np.ndarray, float]]]:
    """The points of all texts; and of words repeated too often for all their points the en places, ru places and weight.

    A name, a number or a word that stands in both languages corresponds to itself.
    """
    known = np.unique(np.concatenate([e.word, r.word]))
    n = len(known)
    ed, rd = np.searchsorted(known, e.word), np.searchsorted(known, r.word)
    order = np.argsort(r.text * n + rd, kind="stable")
    keys = (r.text * n + rd)[order]
    real = (links.e != 0) & (links.r != 0) & (links.e != links.r)
    le, lr, lv = links.e[real], links.r[real], links.v[real]
    a, b = (np.minimum(np.searchsorted(known, x), max(n - 1, 0)) for x in (le, lr))
    here = (known[a] == le) & (known[b] == lr) if n else np.zeros(0, bool)
    a, b, lv = a[here], b[here], lv[here]
    by = np.argsort(a, kind="stable")
    a, b, lv = a[by], b[by], lv[by]
    first = np.searchsorted(a, np.arange(n + 1))
    # distinct words of a text, each with itself and its translations
    pair, inverse, count = np.unique(e.text * n + ed, return_inverse=True, return_counts=True)
    text, d = pair // max(n, 1), pair % max(n, 1)
    own, k = _ranges(first[d], first[d + 1] - first[d]) if n else (np.zeros(0, int), np.zeros(0, int))
    own, target, w = np.concatenate([np.arange(len(pair)), own]), np.concatenate([d, b[k]]), np.concatenate([np.ones(len(pair)), lv[k]])
    lo, hi = np.searchsorted(keys, text[own] * n + target), np.searchsorted(keys, text[own] * n + target, "right")
    some = hi > lo
    own, lo, size, w = own[some], lo[some], (hi - lo)[some], w[some]
    tokens = np.argsort(inverse, kind="stable")
    before = np.cumsum(count) - count
    hot = size * count[own] > HOT
    many = [(tokens[before[o] : before[o] + count[o]], np.sort(order[s : s + z]), float(v)) for o, s, z, v in zip(own[hot], lo[hot], size[hot], w[hot], strict=True)]
    own, lo, size, w = own[~hot], lo[~hot], size[~hot], w[~hot]
    which, t = _ranges(before[own], count[own])
    which2, p = _ranges(lo[which], size[which])
    return _sorted(Points(tokens[t][which2], order[p], w[which][which2])), many


def _sorted(p: Points) -> Points:
    return p[np.lexsort((p.j, p.i))]


class Plane:
    """The bitext spaces of many text pairs side by side."""

    def __init__(self, e: Side, r: Side, links: Links) -> None:
        self.e, self.r = e, r
        self.slope = r.length / np.maximum(e.length, 1)
        self.spread = 0.6 * np.maximum(r.length / r.sentences, 40)
        self.left = np.cumsum(e.sentences)[e.text] - e.sentences[e.text] + e.sentence
        self.right = np.cumsum(r.sentences)[r.text] - r.sentences[r.text] + r.sentence
        self.n_left, self.n_right = int(e.sentences.sum()), int(r.sentences.sum())
        self.power_e, self.power_r = links.strength(e.word, links.e, links.r), links.strength(r.word, links.r, links.e)
        self.whole_e = np.bincount(self.left, self.power_e, self.n_left)
        self.whole_r = np.bincount(self.right, self.power_r, self.n_right)
        self.x = e.at + e.text * (2.0 * e.length.max() + 1) if len(e.at) else e.at  # texts apart
        self.longest = float(e.length.max()) if len(e.length) else 0.0

    def drift(self, p: Points) -> np.ndarray:
        """How far points lie off the diagonal of their text pair."""
        return self.r.at[p.j] - self.slope[self.e.text[p.i]] * self.e.at[p.i]

    def cell(self, p: Points) -> np.ndarray:
        """The two sentences that a point lies in, as one number."""
        return self.left[p.i] * self.n_right + self.right[p.j]

    def support(self, p: Points, drift: np.ndarray, wanted: np.ndarray, reach: float) -> np.ndarray:
        """The weight of slope-consistent points in a rectangle around each wanted point; nearer to its diagonal counts more."""
        x, lane, weight = self.x[p.i], (drift / (self.spread[self.e.text[p.i]] / 2)).astype(np.float32), p.w.astype(np.float32)
        lo, hi = np.searchsorted(x, x[wanted] - reach), np.searchsorted(x, x[wanted] + reach, "right")
        size, ends, own = hi - lo, np.cumsum(hi - lo), lane[wanted]
        out, done = np.zeros(len(wanted)), 0
        while done < len(wanted):  # so many pairs at a time that their arrays stay in the cache
            start = ends[done] - size[done]
            upto = max(done + 1, int(np.searchsorted(ends, start + (1 << 17))))
            mine = slice(done, upto)
            begin = ends[mine] - size[mine] - start
            q = np.arange(ends[upto - 1] - start) + np.repeat(lo[mine] - begin, size[mine])
            near = lane[q]
            near -= np.repeat(own[mine], size[mine])
            np.abs(near, out=near)
            np.subtract(1, near, out=near)
            np.maximum(near, 0, out=near)
            near *= weight[q]
            out[mine] = np.add.reduceat(near, begin)
            done = upto
        return out - 1e-6 * np.abs(drift[wanted])

    def settle(self, p: Points) -> np.ndarray:
        """Which points are no noise: their words are drawn to each other's sentences by the support of growing rectangles."""
        drift, cell = self.drift(p), self.cell(p)
        rivals = [(p.i, np.zeros(len(p.i))), (p.j, np.zeros(len(p.i)))]
        reach = REACH
        chosen = [np.zeros(len(self.e.at), np.int64), np.zeros(len(self.r.at), np.int64)]
        open_ = []
        for k, (token, _) in enumerate(rivals):  # words with points in one sentence only are settled
            chosen[k][token] = cell
            contested = np.zeros(len(chosen[k]), bool)
            contested[token[chosen[k][token] != cell]] = True
            open_.append(contested[token])
        wanted = np.flatnonzero(open_[0] | open_[1])
        while len(wanted):
            s = self.support(p, drift, wanted, reach)
            for k, (token, score) in enumerate(rivals):
                mine = open_[k][wanted]
                at = wanted[mine]
                score[at] = s[mine]
                best = np.full(len(chosen[k]), -np.inf)
                np.maximum.at(best, token[at], score[at])
                top = at[score[at] == best[token[at]]][::-1]
                chosen[k][token[top]] = cell[top]
                other = at[cell[at] != chosen[k][token[at]]]
                second = np.full(len(chosen[k]), -np.inf)
                np.maximum.at(second, token[other], score[other])
                unsure = second > (1 - LEAD) * best
                open_[k] = np.zeros(len(p.i), bool)
                open_[k][at[unsure[token[at]]]] = True
            reach *= 2
            wanted = np.flatnonzero(open_[0] | open_[1]) if reach < 2 * self.longest else wanted[:0]
        return (chosen[0][p.i] == cell) & (chosen[1][p.j] == cell)

    def chains(self, p: Points) -> np.ndarray:
        """The chain of each point: points in order of place follow each other while they keep near one diagonal."""
        drift, text = self.drift(p), self.e.text[p.i]
        new = np.ones(len(p.i), bool)
        new[1:] = (text[1:] != text[:-1]) | (np.abs(np.diff(drift)) > self.spread[text[1:]])
        return np.cumsum(new) - 1

    def along(self, p: Points, many: list[tuple[np.ndarray, np.ndarray, float]]) -> Points:
        """p with the points of often repeated words that lie nearest to the main diagonal and to the chains of p beside them.

        A chain can only take such a word's nearest places, so no other of its points is needed.
        """
        kept = p[self.settle(p)]
        x, drift = self.x[kept.i], self.drift(kept)
        text = self.e.text[kept.i]
        out = [p]
        for i, js, w in many:
            t = self.e.text[i]
            k = np.searchsorted(x, self.x[i])
            base = self.slope[t] * self.e.at[i]
            beside = [np.zeros(len(i))]
            for q in (k - 1, k):
                q = np.clip(q, 0, max(len(x) - 1, 0))
                beside.append(np.where(text[q] == t, drift[q], 0.0) if len(x) else np.zeros(len(i)))
            at = self.r.at[js]
            js_of = [js[np.clip(np.searchsorted(at, base + d) - side, 0, len(js) - 1)] for d in beside for side in (0, 1)]
            pairs = np.unique(np.stack([np.tile(i, len(js_of)), np.concatenate(js_of)]), axis=1)
            out.append(Points(pairs[0], pairs[1], np.full(pairs.shape[1], w)))
        return _sorted(Points(*[np.concatenate([getattr(q, f) for q in out]) for f in ("i", "j", "w")]))

    def coverage(self, p: Points) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The cells of points, the cell of each point, the covered part of either sentence, and whether links are stronger than chance.

        A token covers a cell by its strongest point in it.
        """
        cells, inverse = np.unique(self.cell(p), return_inverse=True)
        parts, sure = [], []
        for token, n, power, whole, sentence in ((p.i, len(self.e.at), self.power_e, self.whole_e, cells // max(self.n_right, 1)), (p.j, len(self.r.at), self.power_r, self.whole_r, cells % max(self.n_right, 1))):
            key = inverse * n + token
            order = np.lexsort((-p.w, key))
            first = order[np.concatenate([[True], np.diff(key[order]) > 0])] if len(order) else order
            best, c = p.w[first], inverse[first]
            covered = np.bincount(c, np.minimum(power[token[first]], best / 0.7), len(cells))
            parts.append(np.divide(covered, whole[sentence], out=np.zeros(len(cells)), where=whole[sentence] > 0))
            sure.append(np.bincount(c, best, len(cells)) >= LEAST_MEAN * np.bincount(c, minlength=len(cells)))
        return cells, inverse, parts[0], parts[1], np.stack(sure)


def align(e: Side, r: Side, links: Links) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, en sentence, ru sentence, coverage of the better and of the other) of all pairs in which one says at least a part of the other.

    Tokens in cells that fail are free again. The search is repeated without cells that all their free points can't cover, and
    in a text where nothing else moves without the weakest cell, until no points are left.
    """
    plane = Plane(e, r, links)
    found, many = points(e, r, links)
    if many:
        found = plane.along(found, many)
    cells, better, other = [], [], []
    while len(found.i):
        kept = found[plane.settle(found)]
        chain = plane.chains(kept)
        strong = np.bincount(chain, minlength=1) >= 2
        kept = kept[strong[chain] | (kept.w >= 0.5)]
        cell, of, by_e, by_r, sure = plane.coverage(kept)
        by_e, by_r = by_e * sure[0], by_r * sure[1]
        good = np.maximum(by_e, by_r) >= COVER
        cells.append(cell[good])
        better.append(np.maximum(by_e, by_r)[good])
        other.append(np.minimum(by_e, by_r)[good])
        used_e, used_r = np.zeros(len(e.at), bool), np.zeros(len(r.at), bool)
        won = kept[good[of]]
        used_e[won.i] = used_r[won.j] = True
        found = found[~used_e[found.i] & ~used_r[found.j]]
        left, of, by_e, by_r, _ = plane.coverage(found)
        reach = np.maximum(by_e, by_r)
        lost = reach < COVER
        text_of = np.zeros(len(left), np.int64)
        text_of[of] = e.text[found.i]
        moved = np.zeros(len(e.length), bool)
        moved[e.text[won.i]] = moved[text_of[lost]] = True
        still = np.flatnonzero(~moved[text_of])
        if len(still):
            order = still[np.lexsort((left[still], reach[still], text_of[still]))]
            lost[order[np.concatenate([[True], np.diff(text_of[order]) > 0])]] = True
        found = found[~lost[of]]
    if not cells:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),) * 2
    cell, high, low = np.concatenate(cells), np.concatenate(better), np.concatenate(other)
    order = np.argsort(cell, kind="stable")
    cell, high, low = cell[order], high[order], low[order]
    left, right = cell // plane.n_right, cell % plane.n_right
    first_e, first_r = np.cumsum(e.sentences) - e.sentences, np.cumsum(r.sentences) - r.sentences
    text = np.searchsorted(first_e, left, "right") - 1
    return text, left - first_e[text], right - first_r[text], high, low


def _distinct(unit: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (unit, word) pairs in order of unit."""
    both = np.unique(unit * n + word)
    return both // n, both % n


class _Counter:
    """Counts of words of either side and of both, over units of a task."""

    def __init__(self) -> None:
        self.e, self.r, self.n = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, e: np.ndarray, r: np.ndarray, n: np.ndarray) -> None:
        self.waiting.append((e, r, n))
        self.size += len(e)
        if self.size > 4_000_000:
            self.fold()

    def fold(self) -> None:
        e, r, n = (np.concatenate([x, *[w[k] for w in self.waiting]]) for k, x in enumerate((self.e, self.r, self.n)))
        order = np.lexsort((r, e))
        e, r, n = e[order], r[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(e) != 0) | (np.diff(r) != 0)])) if len(e) else np.zeros(0, np.int64)
        self.e, self.r, self.n = e[first], r[first], np.add.reduceat(n, first) if len(first) else n
        self.waiting, self.size = [], 0

    def units(self, eu: np.ndarray, ew: np.ndarray, ru: np.ndarray, rw: np.ndarray, n: int) -> None:
        """Count units 0 to n - 1, given by the unit and word of every word of either side; names don't count."""
        plain_e, plain_r = (ew & 1) == 0, (rw & 1) == 0
        words_e, de = np.unique(ew[plain_e], return_inverse=True)
        words_r, dr = np.unique(rw[plain_r], return_inverse=True)
        none = np.zeros(1, np.int64)
        self.add(none, none, np.array([n], np.int64))
        if len(words_e):
            eu, de = _distinct(eu[plain_e], de, len(words_e))
            self.add(words_e, np.zeros(len(words_e), np.int64), np.bincount(de, minlength=len(words_e)))
        if len(words_r):
            ru, dr = _distinct(ru[plain_r], dr, len(words_r))
            self.add(np.zeros(len(words_r), np.int64), words_r, np.bincount(dr, minlength=len(words_r)))
        if not len(words_e) or not len(words_r):
            return
        lo, hi = np.searchsorted(ru, eu), np.searchsorted(ru, eu, "right")
        ends, done = np.cumsum(hi - lo), 0
        while done < len(eu):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + 4_000_000)))
            k, q = _ranges(lo[done:upto], (hi - lo)[done:upto])
            code = de[done:upto][k] * len(words_r) + dr[q]
            if len(words_e) * len(words_r) <= 1 << 23:
                counts = np.bincount(code)
                code = np.flatnonzero(counts)
                counts = counts[code]
            else:
                code, counts = np.unique(code, return_counts=True)
            self.add(words_e[code // len(words_r)], words_r[code % len(words_r)], counts)
            done = upto


def _paired_units(e: Side, r: Side, links: Links) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Sentence pairs that cover both sentences as units, and every sentence without such a pair as a unit of one side."""
    text, i, j, _, both = align(e, r, links)
    sure = both >= LEARN
    plane_e, plane_r = np.cumsum(e.sentences) - e.sentences, np.cumsum(r.sentences) - r.sentences
    left, right = (plane_e[text] + i)[sure], (plane_r[text] + j)[sure]
    n = len(left)
    out, total = [], n
    for side, mine, start in ((e, left, plane_e), (r, right, plane_r)):
        sentence = start[side.text] + side.sentence
        lone = np.setdiff1d(np.arange(int(side.sentences.sum())), mine)
        unit = np.concatenate([np.arange(n), np.arange(total, total + len(lone))])
        owner = np.concatenate([mine, lone])
        total += len(lone)
        first, last = np.searchsorted(sentence, owner), np.searchsorted(sentence, owner, "right")
        k, t = _ranges(first, last - first)
        out += [unit[k], side.word[t]]
    return *out, total


def _counts(tokens: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    """How many units have a word of the left, of the right, and both: e, r, n; added up within a task first.

    Units are whole texts, or with a lexicon the sentence pairs that it finds.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                e, r = _side(batch, "e"), _side(batch, "r")
                units = (e.text, e.word, r.text, r.word, batch.num_rows) if lexicon is None else _paired_units(e, r, lexicon.of(batch))
                counter.units(*units)
        counter.fold()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (counter.e, counter.r, counter.n)], ["e", "r", "n"])

    rows = tokens if lexicon is None else lexicon.beside(tokens)
    return rows.mapInArrow(each, "e bigint, r bigint, n bigint").groupBy("e", "r").agg(F.sum("n").alias("n"))


class Lexicon:
    """Links as a table e, r, v; sent to all tasks if there are at most `most` of them, else joined to the texts that need them."""

    def __init__(self, table: DataFrame, rows: int, most: int = MAX_LINKS) -> None:
        self._table, self._shared = table, None
        if rows <= most:
            found = table.toArrow()
            links = Links(*[found.column(c).to_numpy() for c in ("e", "r", "v")])
            self._shared = table.sparkSession.sparkContext.broadcast(links)
        else:
            self._table = materialize(table)

    def __getstate__(self):
        return {"_shared": self._shared, "_table": None}

    def beside(self, tokens: DataFrame) -> DataFrame:
        """tokens, with the links of each row's words in columns e, r, v where the lexicon is too large to be sent."""
        if self._shared is not None:
            return tokens
        row = tokens.withColumn("_row", F.xxhash64(*tokens.columns))
        words = row.select("_row", F.explode(F.array_distinct(F.concat("e_word", "r_word"))).alias("w"))
        links = self._table.withColumn("w", F.when(F.col("e") != 0, F.col("e")).otherwise(F.col("r")))
        mine = words.join(links, "w").groupBy("_row").agg(F.collect_set(F.struct("e", "r", "v")).alias("_l"))
        mine = mine.select("_row", *[F.col(f"_l.{c}").alias(f"l_{c}") for c in "erv"])
        return row.join(mine, "_row", "left").drop("_row")

    def of(self, batch: pa.RecordBatch) -> Links:
        """The links for the words of a batch."""
        if self._shared is not None:
            return self._shared.value
        e, r, v = (_flat(batch.column(f"l_{c}"))[0] for c in "erv")
        order = np.lexsort((r, e))
        e, r, v = e[order], r[order], v[order]
        first = np.concatenate([[True], (np.diff(e) != 0) | (np.diff(r) != 0)]) if len(e) else np.zeros(0, bool)
        return Links(e[first], r[first], v[first])


def lexicon_of(counts: DataFrame, most: int = MAX_LINKS) -> Lexicon:
    """The correlation of words over all counted units, doubted by how few units have both; and the strength of every word.

    A word is as strong as its strongest link. A word without links gets the more strength the more units have it, since its
    links would be known, but little if it stands in a large part of all units.
    """
    counts = materialize(counts)
    total = (counts.where("e = 0 and r = 0").first() or [0, 0, 0])[2]
    n, a, b = F.lit(float(total)), F.col("n_e").cast("double"), F.col("n_r").cast("double")
    link = (F.col("n") - a * b / n) / F.sqrt(a * b * F.greatest(1 - a / n, F.lit(1e-9)) * F.greatest(1 - b / n, F.lit(1e-9)))
    words = {c: counts.where(f"{c} <> 0 and {o} = 0").select(c, F.col("n").alias(f"n_{c}")) for c, o in (("e", "r"), ("r", "e"))}
    links = (
        counts.where("e <> 0 and r <> 0").join(words["e"], "e").join(words["r"], "r")
        .select("e", "r", (link * F.col("n") / (F.col("n") + DOUBT)).alias("v")).where(F.col("v") >= LEAST_LINK)
    )
    table = links = materialize(links)
    for c, o in (("e", "r"), ("r", "e")):
        unlinked = UNLINKED * F.greatest(F.lit(0.0), 1 - 5 * F.col(f"n_{c}") / n) * F.col(f"n_{c}") / (F.col(f"n_{c}") + UNSEEN)
        own = words[c].join(links.groupBy(c).agg(F.max("v").alias("best")), c, "left").select(c, F.lit(0).cast("bigint").alias(o), F.greatest("best", unlinked).alias("v"))
        table = table.unionByName(own)
    return Lexicon(table, links.count() + counts.where("e = 0 or r = 0").count(), most)


def learn(tokens: DataFrame, rounds: int = 1, most: int = MAX_LINKS) -> Lexicon:
    """A lexicon from tokenized texts: from whole texts, then in rounds from the sentence pairs found with the last one.

    Sentences without a pair count as units of one side, so words that often stand unpaired get no links.
    """
    lexicon = lexicon_of(_counts(tokens, None), most)
    for _ in range(rounds):
        lexicon = lexicon_of(_counts(tokens, lexicon), most)
    return lexicon


def alignment(tokens: DataFrame, ids: list[str], lexicon: Lexicon) -> DataFrame:
    """ids, en_pos, ru_pos, coverage of every sentence pair of tokenized texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                text, i, j, cover, _ = align(_side(batch, "e"), _side(batch, "r"), lexicon.of(batch))
                columns = [batch.column(c).take(pa.array(text)) for c in ids]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(i), pa.array(j), pa.array(cover)], [*ids, "en_pos", "ru_pos", "coverage"])

    schema = ", ".join([*_types(tokens, ids), "en_pos bigint", "ru_pos bigint", "coverage double"])
    return lexicon.beside(tokens).mapInArrow(each, schema)
