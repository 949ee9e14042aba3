"""Languages of documents and of their stretches, by character language models.

Texts are read a batch at a time: what is no running text is masked, words are found and hashed over the characters of all
texts at once, and every distinct word is scored once. Clauses add up their words' scores; the best path of languages over
the clauses of a text pays for each change. A stretch gets the language with the lowest cross-entropy a character. Which
cross-entropies are too high for any language, and how sure a lead is, is measured over all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import charmodel
from tallyforge.session import materialize

# Codes and English names of the languages.
NAMES = {
    "en": ["eng", "english"],
    "ru": ["rus", "russian"],
    "de": ["deu", "ger", "german"],
    "fr": ["fra", "fre", "french"],
    "es": ["spa", "spanish", "castilian"],
    "pt": ["por", "portuguese"],
    "tr": ["tur", "turkish"],
    "zh": ["zho", "chi", "cmn", "chinese", "mandarin"],
    "ja": ["jpn", "japanese"],
    "ko": ["kor", "korean"],
}
# The first articles of the Universal Declaration of Human Rights, from which the models start.
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood."
          " Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms. No one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."
          " Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах. Никто не должен подвергаться пыткам или жестоким, бесчеловечным или унижающим его достоинство обращению и наказанию.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen."
          " Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel sind in allen ihren Formen verboten. Niemand darf der Folter oder grausamer, unmenschlicher oder erniedrigender Behandlung oder Strafe unterworfen werden.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité."
          " Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et la traite des esclaves sont interdits sous toutes leurs formes. Nul ne sera soumis à la torture, ni à des peines ou traitements cruels, inhumains ou dégradants.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros."
          " Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en todas sus formas. Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade."
          " Todo indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão; a escravatura e o trato dos escravos, sob todas as formas, são proibidos. Ninguém será submetido a tortura nem a penas ou tratamentos cruéis, desumanos ou degradantes.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."
          " Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır. Hiç kimse kölelik veya kulluk altında bulundurulamaz; kölelik ve köle ticareti her türlü şekliyle yasaktır. Hiç kimse işkenceye, zalimane, gayriinsani, haysiyet kırıcı cezalara veya muamelelere tabi tutulamaz.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
}
#: Labelled documents per language of which models are fitted, about, and clauses of each, spread over its whole text.
SAMPLE_DOCUMENTS = 400
SAMPLE_CLAUSES = 200
#: A word that is more than 1 / FOREIGN times as frequent in another language is not counted.
FOREIGN = 0.4
#: By how much a character, in natural-log units, the seeds may find the label worse than the best language.
DOUBT = 0.1
#: What a change of language costs, in natural-log units, at the end of a sentence and elsewhere.
SWITCH = 8.0
SWITCH_INSIDE = 14.0
#: Texts that are worked on at once, and words whose scores a task keeps.
CHUNK = 2000
KEPT_WORDS = 300_000
#: A stretch has at least so many letters, in scripts without spaces and in others.
LEAST_DENSE = 6
LEAST_LETTERS = 12
#: A cross-entropy is rejected beyond the median plus so many times the distance from it to the 99th percentile, but only if
#: it is also beyond that of so large a part of groups of so many unseen words: a text about something else is no other language.
REJECT = 3.0
UNSEEN_PART = 0.9
UNSEEN_WORDS = 8
UNKNOWN = "unknown"

# what is no running text, each with signs without which it can't be there
_MASKS = [
    (("```", "~~~"), re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)),
    (("`", "<!--"), re.compile(r"<!--.*?-->|`[^`\n]*`", re.S)),
    (("://", "www.", "@", "WWW."), re.compile(r"(?:https?|ftp|ssh|git)://\S+|www\.\S+|[\w.+-]+@[\w.-]+", re.I)),
    (("#",), re.compile(r"^[ \t]*#+[ \t]*\S+[ \t]*$", re.M)),  # a heading of one token
    (tuple("«“„「『\"‹”」』›»"), re.compile(r"[«“„「『\"‹]\s*[^\s«»“”„「」『』\"‹›]+\s*[»”“」』\"›]")),  # one quoted word
    (("<", "&"), re.compile(r"</?[A-Za-z][^<>]*>|&\w+;")),
]
_DENSE_RANGES = [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)]
_FLAGS = ["LETTER", "DENSE", "MARK", "DROPPED", "SPACE", "LINE", "END", "BREAK", "PART", "JOINT", "ALNUM", "DIGIT", "LINK", "WORD", "KANA", "HANGUL", "HAN", "CYRILLIC"]
LETTER, DENSE, MARK, DROPPED, SPACE, LINE, END, BREAK, PART, JOINT, ALNUM, DIGIT, LINK, WORD, KANA, HANGUL, HAN, CYRILLIC = (1 << k for k in range(len(_FLAGS)))


def _kind(c: str) -> int:
    code = ord(c)
    plain = c.isascii()
    hidden = code in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
    dense = any(a <= code <= b for a, b in _DENSE_RANGES)
    tests = [
        c.isalnum() and not c.isdecimal() and not dense, dense, 0x300 <= code <= 0x36F or hidden, code == 0x307 or hidden, c.isspace(), c == "\n",
        c in ".!?。！？…", c in ".!?。！？…\n,;:，、；：()（）|—–", plain and (c.isalnum() or c in "@~$%&+=#-"), c in "./\\_:@=~", plain and c.isalnum(),
        plain and c.isdigit(), c in ".-", c.isalnum() or c == "_" or dense, 0x3040 <= code <= 0x30FF, 0xAC00 <= code <= 0xD7A3, 0x4E00 <= code <= 0x9FFF, 0x430 <= code <= 0x451,
    ]
    return sum(1 << k for k, t in enumerate(tests) if t)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What every character of the basic plane is, and its lower case."""
    plane = [chr(i) for i in range(1 << 16)]
    return np.array([_kind(c) for c in plane], np.uint32), np.array([ord(c.lower()[0]) for c in plane], np.uint32)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _blank(m: re.Match) -> str:
    return " " * len(m[0]) if "\n" not in m[0] else re.sub(r"[^\n]", " ", m[0])


def _names(kind: np.ndarray) -> np.ndarray:
    """Characters of paths, names and ids with joints inside, and of versions, hashes and numbers."""
    out = np.zeros(len(kind), bool)
    part = (kind & PART) > 0
    joint = np.zeros(len(kind), bool)
    joint[:-1] = ((kind[:-1] & JOINT) > 0) & part[1:]
    start, end = _runs(part | joint)
    if len(start):
        behind = np.where(start > 0, kind[start - 1] & WORD, 0) > 0
        hit = np.logical_or.reduceat(np.append(joint, False), np.stack([start, end], 1).ravel())[::2] & ~behind
        out |= _filled(start[hit], end[hit], len(kind))
    alnum = (kind & ALNUM) > 0
    link = np.zeros(len(kind), bool)
    link[1:-1] = ((kind[1:-1] & LINK) > 0) & alnum[:-2] & alnum[2:]
    start, end = _runs(alnum)
    if len(start):
        digit = np.logical_or.reduceat(np.append((kind & DIGIT) > 0, False), np.stack([start, end], 1).ravel())[::2]
        first = np.ones(len(start), bool)  # of the pieces that links hold together
        first[1:] = ~((start[1:] - end[:-1] == 1) & link[end[:-1]])
        seen = np.cumsum(digit)
        before = (seen - digit)[np.flatnonzero(first)][np.cumsum(first) - 1]
        hit = seen > before
        until = end + np.append(~first[1:], False)  # the link behind a masked piece
        out |= _filled(start[hit], until[hit], len(kind))
    return out


def _filled(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


@dataclass
class Clauses:
    """The clauses of running text of many texts.

    Of each clause its text, start, end, whether a sentence ends before it, its letters (those of dense scripts counted so
    that LEAST_DENSE are enough), its size in scored characters and its script; of each word its clause and its number among
    the distinct words.
    """

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ends: np.ndarray
    letters: np.ndarray
    size: np.ndarray
    script: np.ndarray
    clause: np.ndarray
    word: np.ndarray
    keys: np.ndarray
    words: list[str]


DENSE_LANGUAGES = {"ja", "zh"}
#: Scripts that name a language, in the order in which they decide; everything else is written in Latin letters.
SCRIPTS = ["ja", "ko", "zh", "ru", "latin"]


def clauses(texts: list[str]) -> Clauses:
    """The clauses of all texts. Code, URLs, ids, file names, versions and single quoted words are left out."""
    masked = []
    for text in texts:
        for signs, mask in _MASKS:
            if any(sign in text for sign in signs):
                text = mask.sub(_blank, text)
        masked.append(text)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer(("\0".join(masked) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, lowers = _tables()
    inside = np.minimum(codes, (1 << 16) - 1)
    kind, lower = kinds[inside], lowers[inside]
    for code in np.unique(codes[codes >> 16 > 0]).tolist():
        kind[codes == code], lower[codes == code] = _kind(chr(code)), ord(chr(code).lower()[0])
    kind[_names(kind)] = SPACE
    # words: runs of dense letters, or of other letters with the marks behind them
    place = np.arange(len(kind))
    mark = (kind & MARK) > 0
    bearer = np.maximum.accumulate(np.where(mark, 0, place))
    sort = np.where(kind & DENSE, 2, np.where(kind & LETTER, 1, 0)).astype(np.int8)
    sort = np.where(mark, np.where(sort[bearer] == 1, 1, 0), sort)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], sort, [0]])))
    begin, end = edge[:-1], edge[1:]
    real = sort[begin] > 0
    begin, end = begin[real], end[real]
    n = len(begin)
    none = np.zeros(0, np.int64)
    if not n:
        return Clauses(none, none, none, none.astype(bool), none.astype(float), none, none, none, none, none.view(np.uint64), [])
    size = end - begin
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + begin[owner]
    keep = (kind[at] & DROPPED) == 0
    keep |= at == begin[owner]
    at, owner = at[keep], owner[keep]
    first = np.searchsorted(owner, np.arange(n))
    length = np.diff(np.append(first, len(owner)))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(length.max()), charmodel.PRIME, np.uint64))
        h = np.add.reduceat((lower[at].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(at)) - first[owner]], first)
        h = (h ^ (h >> np.uint64(31))) * charmodel.PRIME
    keys, one, word = np.unique(h, return_index=True, return_inverse=True)
    words = [lower[at[first[k] : first[k] + length[k]]].tobytes().decode("utf-32-le", "surrogatepass") for k in one.tolist()]
    # clauses: a new one at a text's first word and at a break between words
    text = np.searchsorted(starts, begin, "right") - 1
    breaks = np.concatenate([[0], np.cumsum((kind & BREAK) > 0)])
    line = (kind & LINE) > 0
    solid = np.maximum.accumulate(np.where((kind & SPACE) > 0, -1, place))
    line_before = np.concatenate([[-1], np.maximum.accumulate(np.where(line, place, -1))[:-1]])
    stops = np.concatenate([[0], np.cumsum(((kind & END) > 0) | line & (line_before > solid))])
    new, ends = np.ones(n, bool), np.ones(n, bool)
    new[1:] = (text[1:] != text[:-1]) | (breaks[begin[1:]] > breaks[end[:-1]])
    ends[1:] = (text[1:] != text[:-1]) | (stops[begin[1:]] > stops[end[:-1]])
    head = np.flatnonzero(new)
    clause = np.cumsum(new) - 1
    heavy = (codes[begin] >= 0x3040) & (codes[begin] <= 0x9FFF)
    letters = np.add.reduceat(length * np.where(heavy, LEAST_LETTERS / LEAST_DENSE, 1), head)
    chars = np.add.reduceat(length, head)
    of = [np.add.reduceat(np.add.reduceat((kind[at] & flag > 0).astype(np.int64), first), head) for flag in (KANA, HANGUL, HAN, CYRILLIC)]
    script = np.select([of[0] > 0, *[2 * x > chars for x in of[1:]]], [0, 1, 2, 3], 4)
    return Clauses(
        text[head], begin[head] - starts[text[head]], end[np.append(head[1:], n) - 1] - starts[text[head]], ends[head], letters,
        np.add.reduceat(length + 1, head), script, clause, word, keys, words,
    )


class Scorer:
    """Scores of clauses by models; the scores of words are kept for later batches of a task."""

    def __init__(self, models: charmodel.Models) -> None:
        self.models = models
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, len(models.languages)))

    def __call__(self, c: Clauses) -> np.ndarray:
        """A row a clause and a column a language."""
        if not len(c.text):
            return np.zeros((0, len(self.models.languages)))
        if len(self.keys) > KEPT_WORDS:
            self.__init__(self.models)
        k = np.searchsorted(self.keys, c.keys)
        new = np.flatnonzero(self.keys[np.minimum(k, len(self.keys) - 1)] != c.keys) if len(self.keys) else np.arange(len(c.keys))
        if len(new):
            keys = np.concatenate([self.keys, c.keys[new]])
            order = np.argsort(keys)
            self.scores = np.concatenate([self.scores, self.models.score([c.words[i] for i in new.tolist()])])[order]
            self.keys = keys[order]
        rows = self.scores[np.searchsorted(self.keys, c.keys)]
        return np.add.reduceat(rows[c.word], np.searchsorted(c.clause, np.arange(len(c.text))), axis=0)


def paths(c: Clauses, scores: np.ndarray) -> np.ndarray:
    """The language of every clause on the best path over the clauses of its text; all texts take a step at once."""
    text, first, count = np.unique(c.text, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    best = scores[first].copy()
    price = np.where(c.ends, SWITCH, SWITCH_INSIDE)
    back = []
    for t in range(1, int(count[0]) if len(count) else 1):
        n = int(np.searchsorted(-count, -t))  # texts with more clauses
        now, before = first[:n] + t, best[:n]
        top = before.argmax(axis=1)
        moved = (before[np.arange(n), top] - price[now])[:, None]
        stay = before >= moved
        back.append((stay, top))
        best[:n] = np.where(stay, before, moved) + scores[now]
    state = best.argmax(axis=1)
    path = np.zeros(len(c.text), np.int64)
    for t in range(len(back), 0, -1):
        stay, top = back[t - 1]
        n = len(top)
        path[first[:n] + t] = state[:n]
        state[:n] = np.where(stay[np.arange(n), state[:n]], state[:n], top)
    path[first] = state
    return path


@dataclass
class Stretches:
    """Stretches of texts in one language: text, first clause, end, language (-1: too short to tell), cross-entropy, lead."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    language: np.ndarray
    entropy: np.ndarray
    lead: np.ndarray


def stretches(c: Clauses, scores: np.ndarray) -> Stretches:
    """Runs of clauses in one language, with the lowest cross-entropy a character and its lead over the second best.

    A run that is too short joins the run before it, or else the next, without counting there; a text with short runs only is
    one stretch without a language.
    """
    path = paths(c, scores)
    new = np.ones(len(path), bool)
    new[1:] = (c.text[1:] != c.text[:-1]) | (path[1:] != path[:-1])
    head = np.flatnonzero(new)
    if not len(head):
        return Stretches(*[np.zeros(0, np.int64)] * 4, np.zeros(0), np.zeros(0))
    text, run = c.text[head], np.arange(len(head))
    long = np.add.reduceat(c.letters, head) >= LEAST_LETTERS
    before = np.maximum.accumulate(np.where(long, run, -1))
    after = np.minimum.accumulate(np.where(long, run, len(run))[::-1])[::-1]
    has_before = (before >= 0) & (text[before] == text)
    has_after = (after < len(run)) & (text[np.minimum(after, len(run) - 1)] == text)
    target = np.where(has_before, before, np.where(has_after, after, -1))
    language = np.where(target >= 0, path[head][target], -1)
    start = np.ones(len(run), bool)
    start[1:] = (text[1:] != text[:-1]) | (language[1:] != language[:-1])
    counted = np.repeat(long | (target < 0), np.diff(np.append(head, len(path))))
    first = head[start]
    total = np.add.reduceat(scores * counted[:, None], first, axis=0)
    size = np.add.reduceat(c.size * counted, first)
    cross = -total / size[:, None]
    two = np.partition(cross, 1, axis=1)[:, :2] if cross.shape[1] > 1 else np.repeat(cross, 2, axis=1)
    best = np.where(language[start] < 0, -1, cross.argmin(axis=1))
    return Stretches(text[start], first, np.append(first[1:], len(path)) - 1, best, two[:, 0], (two[:, 1] - two[:, 0]) * np.sqrt(size))


def known_label(label: Column) -> Column:
    """The language that a label names in any form, in two letters; null if it names none of them."""
    low = F.lower(F.trim(label))
    names = F.create_map(*[F.lit(x) for code, forms in NAMES.items() for form in (code, *forms) for x in (form, code)])
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.regexp_extract(low, r"^([a-z]{2,3})[-_][a-z0-9_-]+$", 1)))


def _purified(found: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
    """Word counts without words that are much more frequent in another language: those came in by wrong labels."""
    totals = {language: sum(words.values()) for language, words in found.items()}
    most: dict[str, float] = {}
    for language, words in found.items():
        for w, n in words.items():
            most[w] = max(most.get(w, 0.0), n / totals[language])
    return {
        language: {w: n for w, n in words.items() if n / totals[language] >= FOREIGN * most[w]} for language, words in found.items()
    }


def _with_seeds(found: dict[str, dict[str, int]]) -> dict[str, dict[str, int]]:
    out = {}
    for language, seed in SEEDS.items():
        out[language] = dict(found.get(language, {}))
        c = clauses([seed])
        for k in c.word.tolist():
            out[language][c.words[k]] = out[language].get(c.words[k], 0) + 1
    return out


def _vocabulary(sample: DataFrame, models: charmodel.Models, doubt: float) -> dict[str, dict[str, int]]:
    """Word counts by language of clauses in the label's script whose label is the best language, or worse by at most doubt a
    character; counted on Spark."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        of = {x: SCRIPTS.index(x) if x in SCRIPTS else len(SCRIPTS) - 1 for x in scorer.models.languages}
        for batch in batches:
            c = clauses(batch.column("text").to_pylist())
            label = batch.column("label").to_pylist()
            mine = np.array([scorer.models.languages.index(x) for x in label], np.int64)[c.text]
            script = np.array([of[x] for x in label], np.int64)[c.text]
            scores = scorer(c)
            kept = (c.script == script) & (scores.max(axis=1, initial=-np.inf) - scores[np.arange(len(mine)), mine] <= doubt * c.size)
            number = np.arange(len(c.text)) - np.searchsorted(c.text, c.text)
            step = -(-np.bincount(c.text, minlength=len(label)) // SAMPLE_CLAUSES)
            kept &= number % np.maximum(step[c.text], 1) == 0
            some = kept[c.clause]
            pair, n = np.unique(mine[c.clause[some]] * max(len(c.words), 1) + c.word[some], return_counts=True)
            names = [scorer.models.languages[k] for k in (pair // max(len(c.words), 1)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c.words[k] for k in (pair % max(len(c.words), 1)).tolist()], pa.string()), pa.array(n)], ["label", "word", "n"])

    rows = sample.mapInArrow(each, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n")).toArrow()
    out: dict[str, dict[str, int]] = {}
    for label, word, n in zip(*[rows.column(c).to_pylist() for c in ("label", "word", "n")], strict=True):
        out.setdefault(label, {})[word] = n
    return out


def train(documents: DataFrame, order: int = 4, sample: int = SAMPLE_DOCUMENTS, rounds: int = 2) -> charmodel.Models:
    """Models fitted on a bounded sample of labelled documents, drawn by a hash with a rate for each label.

    Labels may be wrong and texts mixed, so each round takes only clauses in the label's script whose label the models of the
    round before agree with, and leaves out words that belong to another language. The first models know only the seeds, and
    are doubted a little.
    """
    known = documents.where("text is not null and text <> ''").select("doc_id", known_label(F.col("lang")).alias("label"), "text").where("label is not null")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rates = F.create_map(*[F.lit(x) for label, n in (counts or {"": 1}).items() for x in (label, int(min(1.0, sample / n) * (1 << 30)))])
    rows = materialize(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(rates, F.col("label"))).select("label", "text"))
    models = charmodel.fit(_with_seeds({}), order)
    for n in range(rounds):
        words = _with_seeds(_purified(_vocabulary(rows, models, 0.0 if n else DOUBT)))
        models = charmodel.fit(words, order)
    models.unseen = _unseen(words, order) if rounds else {}
    return models


def _unseen(words: dict[str, dict[str, int]], order: int) -> dict[str, float]:
    """Per language a cross-entropy that groups of words it has never seen stay below: models without every fourth word, by the
    order of their hashes, judge those words."""
    split = {x: sorted(w, key=lambda v: hashlib.md5(v.encode("utf-8", "replace")).digest()) for x, w in words.items()}
    rest = charmodel.fit({x: {v: words[x][v] for k, v in enumerate(w) if k % 4} for x, w in split.items()}, order)
    out = {}
    for k, language in enumerate(rest.languages):
        held = split[language][::4]
        if len(held) >= UNSEEN_WORDS:
            loss, size = -rest.score(held)[:, k], np.array([len(v) + 1 for v in held])
            heads = np.arange(0, len(held) - UNSEEN_WORDS + 1, UNSEEN_WORDS)
            cross = np.add.reduceat(loss, heads) / np.add.reduceat(size, heads)
            out[language] = float(np.quantile(cross, UNSEEN_PART))
    for language in DENSE_LANGUAGES & set(out):  # most of their characters are rare, but their script tells them
        out[language] = max(out[language], float(np.log(charmodel.ALPHABET)) + 0.5)
    return out


def measured(documents: DataFrame, models: charmodel.Models) -> DataFrame:
    """doc_id, label and the measures of every stretch of every document; and, beside a text's first stretch, the best
    language of its first clause and its lead. Written once."""
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = np.array([*scorer.models.languages, None], object)
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                c = clauses([x or "" for x in batch.column("text").to_pylist()])
                scores = scorer(c)
                s = stretches(c, scores)
                number = np.arange(len(s.text)) - np.searchsorted(s.text, s.text)
                two = -np.partition(-scores[s.first], 1, axis=1)[:, :2] if len(s.first) else np.zeros((0, 2))
                lead = (two[:, 0] - two[:, 1]) / np.sqrt(c.size[s.first])
                start, end = c.start[s.first], c.end[s.last]
                columns = [
                    batch.column("doc_id").take(pa.array(s.text)), batch.column("label").take(pa.array(s.text)),
                    np.bincount(s.text, minlength=batch.num_rows)[s.text], number, names[s.language], s.entropy, s.lead, start, end - start,
                    np.where(number == 0, names[scores[s.first].argmax(axis=1)] if len(s.first) else names[:0], None), lead,
                ]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], fields)

    kinds = [None, None, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
    fields = ["doc_id", "label", "n_segs", "n", "lang", "entropy", "lead", "start", "length", "clause_lang", "clause_lead"]
    schema = "doc_id bigint, label string, n_segs bigint, n bigint, lang string, entropy double, lead double, start int, length int, clause_lang string, clause_lead double"
    rows = documents.where("text is not null and text <> ''").select("doc_id", F.col("lang").alias("label"), "text")
    return materialize(rows.mapInArrow(each, schema))


@dataclass
class Calibration:
    """Per language the median cross-entropy and that beyond which it is rejected; and the lead at which a choice is right with odds e to 1."""

    middle: dict[str, float]
    limit: dict[str, float]
    temperature: float


def _trusted(raw: DataFrame) -> DataFrame:
    """Rows of texts in one stretch with a known label, in column known."""
    return raw.where("n_segs = 1").withColumn("known", known_label(F.col("label"))).where("known is not null")


def reliability(raw: DataFrame, width: float = 0.5, most: float = 20.0) -> DataFrame:
    """bin, n, agreed: how often the best language of a text's first clause is the text's label, by its lead; over all documents."""
    lead = F.floor(F.least(F.col("clause_lead"), F.lit(most)) / width) * width
    return _trusted(raw).groupBy(lead.alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("clause_lang") == F.col("known")).alias("agreed"))


def calibrate(raw: DataFrame, unseen: dict[str, float] | None = None) -> Calibration:
    """Limits and temperature measured over all documents of raw.

    Labels are wrong now and then even where the lead leaves no doubt, so agreement is measured against that of the highest
    leads. The temperature is the largest with which the confidences fit the agreements nearly as well as they can, by their
    likelihood: where leads leave no doubt, confidences stay on the careful side.
    """
    own = _trusted(raw).where("known = lang")
    rows = own.groupBy("lang").agg(F.percentile_approx("entropy", [0.5, 0.99], 10_000).alias("q")).collect()
    middle = {r.lang: r.q[0] for r in rows}
    limit = {r.lang: r.q[0] + REJECT * max(r.q[1] - r.q[0], 0.05) for r in rows}
    limit = {x: max(limit.get(x, 0.0), (unseen or {}).get(x, 0.0)) for x in {*limit, *(unseen or {})}}
    bins = sorted((r.bin, r.n, r.agreed) for r in reliability(raw).collect() if r.bin is not None)
    if not bins:
        return Calibration(middle, limit, 1.0)
    x, n, agreed = (np.array(v, float) for v in zip(*bins, strict=True))
    sure = n * (np.cumsum(n[::-1])[::-1] <= max(0.5 * n.sum(), n[-1]))
    plateau = min(1 - 1e-6, (agreed * (sure > 0)).sum() / max((n * (sure > 0)).sum(), 1))
    fits = []
    for t in np.geomspace(0.02, 20, 200):
        p = np.clip(plateau / (1 + np.exp(-np.clip((x + 0.25) / t, 0, 30))), 1e-9, 1 - 1e-9)
        fits.append((float((agreed * np.log(p) + (n - agreed) * np.log(1 - p)).sum()), float(t)))
    return Calibration(middle, limit, max(t for fit, t in fits if fit >= max(fits)[0] - 0.5))


def segments(documents: DataFrame, models: charmodel.Models) -> DataFrame:
    """doc_id, label, n_segs, seg_no, lang, confidence, start, length of every stretch of running text in every document.

    seg_no and n_segs count stretches with a language. A stretch that is too short to tell, or whose cross-entropy is beyond
    the limit of its best language, has the language `unknown`, no seg_no, and the confidence that it is rejected rightly.
    Null, empty and code-only texts have no stretch. Positions are code points of the text.
    """
    raw = measured(documents, models)
    fitted = calibrate(raw, models.unseen)

    def of(values: dict[str, float], other: float) -> Column:
        known = [F.lit(x) for pair in values.items() for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*known), F.col("lang")), F.lit(other)) if known else F.lit(other)

    most = max(fitted.limit.values(), default=1e9)
    limit, middle = of(fitted.limit, most), of({x: min(v, fitted.limit[x] - 0.05) for x, v in fitted.middle.items()}, most - 1)
    lost = F.col("lang").isNull() | (F.col("entropy") > limit)
    sure = 1 / (1 + F.exp(-F.col("lead") / fitted.temperature))
    odd = F.when(F.col("lang").isNull(), 0.5).otherwise(1 / (1 + F.exp(-REJECT * (F.col("entropy") - limit) / (limit - middle))))
    rows = raw.withColumn("_lost", lost)
    gone = rows.where("_lost").groupBy("doc_id").agg(F.count("*").alias("_gone"), F.sort_array(F.collect_list("n")).alias("_places"))
    joined = rows.join(gone, "doc_id", "left")
    earlier = F.size(F.filter(F.coalesce("_places", F.array().cast("array<bigint>")), lambda p: p < F.col("n")))
    return joined.select(
        "doc_id", "label", (F.col("n_segs") - F.coalesce("_gone", F.lit(0))).alias("n_segs"), F.when(~F.col("_lost"), F.col("n") - earlier).alias("seg_no"),
        F.when(F.col("_lost"), UNKNOWN).otherwise(F.col("lang")).alias("lang"), F.when(F.col("_lost"), odd).otherwise(sure).alias("confidence"), "start", "length",
    )
