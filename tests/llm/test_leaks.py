import random

from tallyforge.llm import leaks
from tallyforge.llm.words import words


def test_words():
    assert words("> The **qu­ick** <b>Br</b>own&nbsp;f​ox—JUMPS over [the](http://x.y/a_(b)) <!-- no --> year's ｅnd") == "the quick brown fox jumps over the years end".split()
    assert words("") == [] and words("?!") == []


def brute(item, doc):
    for shift in range(-len(item), len(doc) + 1):
        for a in range(len(item)):
            for b in range(a + 20, len(item) + 1):
                if a + shift >= 0 and b + shift <= len(doc) and sum(item[i] != doc[i + shift] for i in range(a, b)) * 8 <= b - a:
                    return True
    return False


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [*"all items open alike here".split(), *rng.choices(vocabulary, k=rng.randint(10, 40))]) for i in range(12)]
    docs = []
    for d in range(120):
        text = rng.choices(vocabulary, k=rng.randint(0, 40))
        if d % 3:
            _, item = rng.choice(items)
            n = rng.randint(17, 30)
            start = rng.randint(0, max(0, len(item) - n))
            part = item[start : start + n]
            for k in rng.sample(range(len(part)), min(len(part), rng.randint(0, 5))):
                part[k] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((d, text))
    want = {(i, d) for i, item in items for d, text in docs if brute(item, text)}
    di = spark.createDataFrame([(d, " ".join(t).upper(), "clash") for d, t in docs] + [(900, None, ""), (901, "", "")], "doc_id bigint, text string, h string")
    it = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(77, None), (78, "too short")], "item_id bigint, text string")
    got = [tuple(r) for r in leaks.leaks(di, it).collect()]
    assert len(want) > 15 and set(got) == want and len(got) == len(set(got))


def test_every_window_has_a_prefix():
    rng = random.Random(2)
    for _ in range(40):
        length = rng.randint(20, 60)
        frequency = [rng.choice([0, 1, 1, 5, 900]) for _ in range(length - 4)]
        prefix = set(leaks.prefix_positions(frequency))
        w = rng.randint(20, min(length, 39))
        start = rng.randint(0, length - w)
        others = rng.sample(range(start, start + w), w // 8)
        kept = {p for p in range(start, start + w - 4) if not any(p <= o < p + 5 for o in others)}
        assert kept & prefix
    assert leaks.prefix_positions([1] * 10) == []


def test_one_word_over_and_over(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "word " * 19), (3, "word other " * 10_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "word " * 5_000)], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.leaks(docs, items).collect()] == [(7, 1)]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaks(docs, items).count() == 0
