"""Character language models with interpolated Kneser-Ney smoothing in sorted hash arrays.

Words are scored one by one, padded with spaces, so a word's score does not depend on its neighbours and every distinct
word of a batch is scored once. All languages share one sorted array of n-gram hashes; a row of the matrix behind it has
the discounted probability of the n-gram in every language.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np

PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Characters that an unseen character is one of.
ALPHABET = 5000


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n codes that end at each position; positions before n - 1 are not valid."""
    h = np.full(len(codes), n * 0x2545F491 + 1, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(n - 1, -1, -1):
            h = (h ^ np.roll(codes, back)) * PRIME
            h ^= h >> np.uint64(29)
    return h


def _padded(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each behind order - 1 spaces and before one; and the word of every scored position."""
    pad = " " * (order - 1)
    text = "".join(f"{pad}{w} " for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + order for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return codes, np.where(inside >= order - 1, owner, -1)


@dataclass
class Models:
    """Kneser-Ney models of several languages, by order: sorted hashes with a matrix for n-grams, and one for histories.

    unseen: per language a cross-entropy a character that words it has never seen stay below, if it was measured.
    """

    languages: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    histories: list[tuple[np.ndarray, np.ndarray]]
    unseen: dict[str, float] = field(default_factory=dict)

    def score(self, words: list[str]) -> np.ndarray:
        """Natural-log probability of each word, its end included, in every language."""
        out = np.zeros((len(words), len(self.languages)))
        step = 20_000
        for at in range(0, len(words), step):
            out[at : at + step] = self._score(words[at : at + step])
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        codes, owner = _padded(words, self.order)
        place = np.flatnonzero(owner >= 0)
        p = np.full((len(place), len(self.languages)), 1 / ALPHABET, np.float32)
        for n in range(1, self.order + 1):
            found, row = _find(self.grams[n - 1][0], _hashes(codes, n)[place])
            known, line = _find(self.histories[n - 1][0], np.roll(_hashes(codes, n - 1), 1)[place] if n > 1 else np.zeros(len(place), np.uint64))
            weight = np.where(known[:, None], self.histories[n - 1][1][line], np.float32(1))
            p = p * weight + np.where(found[:, None], self.grams[n - 1][1][row], np.float32(0))
        out = np.zeros((len(words), len(self.languages)))
        np.add.at(out, owner[place], np.log(p))
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[row] == wanted, row


def fit(vocabularies: dict[str, dict[str, int]], order: int = 4) -> Models:
    """Models from the word counts of each language; words also count in the form without diacritics."""
    languages = sorted(vocabularies)
    grams: list[dict[str, np.ndarray]] = [{} for _ in range(order)]
    histories: list[dict[str, np.ndarray]] = [{} for _ in range(order)]
    for k, language in enumerate(languages):
        words: Counter[str] = Counter()
        for word, count in vocabularies[language].items():
            words[word] += count
            if (plain := without_marks(word)) != word:
                words[plain] += count
        counts: list[Counter[str]] = [Counter() for _ in range(order)]
        for word, count in words.items():
            text = " " * (order - 1) + word + " "
            for end in range(order, len(text) + 1):
                counts[order - 1][text[end - order : end]] += count
        for n in range(order - 1, 0, -1):  # how many characters precede
            counts[n - 1] = Counter(g[1:] for g in counts[n])
        for n in range(1, order + 1):
            total: dict[str, float] = defaultdict(float)
            kinds: Counter[str] = Counter()
            for g, c in counts[n - 1].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            ones = sum(c == 1 for c in counts[n - 1].values())
            twos = sum(c == 2 for c in counts[n - 1].values())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            for g, c in counts[n - 1].items():
                row = grams[n - 1].setdefault(g, np.zeros(len(languages), np.float32))
                row[k] = max(c - discount, 0) / total[g[:-1]]
            for h, t in total.items():
                histories[n - 1].setdefault(h, np.ones(len(languages), np.float32))[k] = discount * kinds[h] / t
    return Models(languages, order, [_table(x, n) for n, x in enumerate(grams, 1)], [_table(x, n) for n, x in enumerate(histories)])


def _table(rows: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    if not n:  # the empty history
        return np.zeros(1, np.uint64), np.stack(list(rows.values())) if rows else np.ones((1, 0), np.float32)
    codes = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    keys = _hashes(codes, n)[n - 1 :: n]
    order = np.argsort(keys)
    return keys[order], np.stack(list(rows.values()))[order]


def without_marks(word: str) -> str:
    """A word in lower case without diacritics; Hangul stays whole, dotless i gets its dot."""
    if word.isascii():
        return word
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    return unicodedata.normalize("NFC", bare).replace("ı", "i")
