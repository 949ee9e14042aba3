import itertools
import random
import time

import numpy as np
import pytest
import regex

from tallyforge.llm import bitext
from tests.oracle import DATA

EN = ["The first reviewer opened a heavy door.", "The old cache lost every record!", "Nobody saw the silver lamp.", "Is the narrow path still used?", "Commit a1b2c3 changed src/Main.qml in line 12."]
RU = ["Первый рецензент открыл тяжёлую дверь.", "Старый кэш потерял каждую запись!", "Никто не видел серебряную лампу.", "Используется ли ещё узкая тропа?", "Коммит a1b2c3 изменил src/Main.qml в строке 12."]


def plain_tokens(text):
    """(form compared, middle, sentence) of every token by regular expressions."""
    heads = [m.end() for m in regex.finditer(r"(?<=[.!?])\s+(?=\p{Lu})", text)]
    out = []
    for m in regex.finditer(r"[\p{L}\p{M}\p{N}_]+(?:[./@:][\p{L}\p{M}\p{N}_]+)*", text):
        name = regex.search(r"[^\p{L}\p{M}]", m[0]) is not None
        w = "".join(c.lower() if len(c.lower()) == 1 else c for c in m[0])
        out.append((w if name else w[: bitext.STEM], name, (m.start() + m.end()) / 2, sum(h <= m.start() for h in heads)))
    return out


def test_tokens_against_regular_expressions():
    rng = random.Random(4)
    pieces = ["a1b2", "Src/Main.qml", "x..y", "e.g.", "Three?", "Ω", "İx", "𝒜b", "ёлка", "Ель!", "\n", "  ", "_id_", "a@b:c", "-", "１２", "é", "", "0"]
    texts = ["  One e.g. two. Three? Four! five. Six", "", " ", ".", "A"] + ["".join(rng.choice(pieces) + rng.choice([" ", "", ". "]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    side, _ = bitext.tokenize(texts)
    forms = {}
    for t, text in enumerate(texts):
        mine, want = np.flatnonzero(side.text == t), plain_tokens(text)
        assert [(bool(side.word[k] & 1), side.at[k], side.sentence[k]) for k in mine] == [w[1:] for w in want]
        for k, w in zip(mine, want, strict=True):
            assert forms.setdefault(w[0], side.word[k]) == side.word[k]
    assert len(set(forms.values())) == len(forms) and side.sentences[0] == 4


def texts(spark):
    rows = []
    for n, order in enumerate(itertools.permutations(range(5), 3)):
        rows.append((f"t{n}", " ".join(EN[i] for i in order), " ".join(RU[i] for i in order)))
    rows += [
        ("turned", f"{EN[0]} {EN[1]}", f"{RU[1]} {RU[0]}"), ("omitted", f"{EN[0]} {EN[2]} {EN[1]}", f"{RU[0]} {RU[1]}"),
        ("merged", f"{EN[0]} {EN[1]}", f"{RU[0][:-1]}, а {RU[1][0].lower()}{RU[1][1:]}"), ("same", EN[0], EN[0]), ("null", None, RU[0]), ("empty", EN[0], ""),
    ]
    return spark.createDataFrame(rows, "id string, en string, ru string")


def pairs(df):
    return {(r.id, r.en_pos, r.ru_pos) for r in df.collect()}


def test_alignment(spark):
    rows = bitext.tokenized(texts(spark), ["id"])
    assert {"same", "null", "empty"} & {r.id for r in rows.collect()} == set()
    found = pairs(bitext.alignment(rows, ["id"], bitext.learn(rows)))
    got = {}
    for i, e, r in found:
        got.setdefault(i, set()).add((e, r))
    assert got["turned"] == {(0, 1), (1, 0)} and got["omitted"] == {(0, 0), (2, 1)} and got["merged"] == {(0, 0), (1, 0)}
    straight = {(0, 0), (1, 1), (2, 2)}
    assert all(got.get(f"t{n}") == straight for n in range(60))
    # a lexicon too large to be sent is joined to the texts, with the same result
    assert pairs(bitext.alignment(rows, ["id"], bitext.learn(rows, most=3))) == found


def test_empty(spark):
    rows = bitext.tokenized(texts(spark).limit(0), ["id"])
    assert bitext.alignment(rows, ["id"], bitext.learn(rows)).count() == 0


def links(pairs):
    words = [bitext.tokenize([w])[0].word[0] for pair in pairs for w in pair]
    e, r = np.array(words[::2]), np.array(words[1::2])
    none, full = np.zeros(len(e), np.int64), np.full(len(e), 0.9)
    return bitext.Links(np.concatenate([e, e, none]), np.concatenate([r, none, r]), np.concatenate([full] * 3))


def one(en, ru, lexicon):
    _, i, j, _, _ = bitext.align(bitext.tokenize([en])[0], bitext.tokenize([ru])[0], lexicon)
    return list(zip(i.tolist(), j.tolist(), strict=True))


WORDS = [("ant", "муравей"), ("bee", "пчела"), ("cat", "кошка"), ("dog", "собака"), ("elk", "лось"), ("fox", "лиса"), ("hen", "курица"), ("owl", "сова")]


def test_chains_cross_sentences():
    e, r = bitext.tokenize(["Ant bee cat. Dog elk fox."])[0], bitext.tokenize(["Муравей пчела кошка. Собака лось лиса."])[0]
    lexicon = links(WORDS)
    found, _ = bitext.points(e, r, lexicon)
    assert set(bitext.Plane(e, r, lexicon).chains(found).tolist()) == {0} and len(found.i) == 6


def test_repeated_sentence_follows_its_chain():
    # the last sentence stands right behind the three merged ones and once more after that, where its number is nearer
    en = [f"{a}{n}" for n in "bcdf" for a in ("window", "garden", "silver", "planet")]
    ru = [f"{a}{n}" for n in "бвгд" for a in ("окошко", "садики", "серебр", "планет")]
    en_text = " ".join(" ".join(en[i : i + 4]).capitalize() + "." for i in range(0, 16, 4))
    last = " ".join(ru[12:]).capitalize() + "."
    assert one(en_text, f"{' '.join(ru[:12]).capitalize()}. {last} {last}", links(list(zip(en, ru, strict=True)))) == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_one_word_over_and_over():
    began = time.time()
    assert one("Ant. " * 5000, "Муравей. " * 5000, links(WORDS)) == [(n, n) for n in range(5000)]
    assert one("ant " * 5000, "муравей " * 5000, links(WORDS)) == [(0, 0)]
    middle = "bee cat dog elk. "
    assert one("Ant " * 3000 + middle + "Ant " * 3000, "Муравей " * 3000 + "пчела кошка собака лось. " + "Муравей " * 3000, links(WORDS)) == [(0, 0), (1, 1)]
    assert time.time() - began < 20


@pytest.fixture(scope="module")
def given(spark):
    """Tokenized corrections, their lexicon, and texts in which every text stands twice with its pairs."""
    rows = spark.read.parquet(f"{DATA}/corrections.parquet").select("correction_id", "observation.*").where("en <> '' and ru <> ''").dropDuplicates(["correction_id"])
    rows = rows.withColumnRenamed("correction_id", "id")
    tokens = bitext.tokenized(rows, ["id"])
    lexicon = bitext.learn(tokens)
    single = pairs(bitext.alignment(tokens, ["id"], lexicon))
    size = {r.id: (r.e_sentences, r.r_sentences) for r in tokens.collect()}
    want = single | {(i, e + size[i][0], r + size[i][1]) for i, e, r in single}
    twice = bitext.tokenized(rows.selectExpr("id", "concat(trim(en), ' ', trim(en)) en", "concat(trim(ru), ' ', trim(ru)) ru"), ["id"])
    return twice, lexicon, want


def test_chain_search_decides_between_equal_sentences(given, monkeypatch):
    """Texts said twice: each sentence has two equal partners. The chain search tells them apart; without it they do not come apart."""
    twice, lexicon, want = given
    got = pairs(bitext.alignment(twice, ["id"], lexicon))
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    shared = lexicon._shared.value
    monkeypatch.setattr(bitext.Plane, "settle", lambda self, p: np.ones(len(p.i), bool))
    batch = twice.toArrow().combine_chunks().to_batches()[0]
    text, i, j, _, _ = bitext.align(bitext._side(batch, "e"), bitext._side(batch, "r"), shared)
    ids = batch.column("id").to_pylist()
    blind = {(ids[t], a, b) for t, a, b in zip(text.tolist(), i.tolist(), j.tolist(), strict=True)}
    assert len(blind & want) < 0.7 * len(blind)
