import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import mixing


def reachable(lengths, budget):
    sums = {0}
    for n, c in lengths.items():
        sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= budget}
    return max(sums)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(1, 400), st.integers(1, 3))
def test_budget_is_filled_as_well_as_it_can_be(lengths, budget, repeats):
    whole, extra = mixing.fit_source(lengths, budget, repeats)
    total = sum(n * c for n, c in lengths.items())
    assert all(0 < extra[n] <= lengths[n] for n in extra) and whole + bool(extra) <= repeats
    rest = min(budget, repeats * total) - whole * total
    assert sum(n * k for n, k in extra.items()) == (reachable(lengths, rest) if whole < repeats else 0)


def test_budgets_beyond_the_window_are_filled_as_well_as_they_can_be(monkeypatch):
    """A window of a few tokens must grow until no better sum can exist."""
    monkeypatch.setattr(mixing, "WINDOW", 4)
    rng = random.Random(8)
    for _ in range(200):
        lengths = {rng.randint(2, 90): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        total = sum(n * c for n, c in lengths.items())
        budget = rng.randint(1, total)
        whole, extra = mixing.fit_source(lengths, budget, 1)
        assert whole * total + sum(n * k for n, k in extra.items()) == reachable(lengths, budget)
    monkeypatch.undo()
    even = {n: 10**6 for n in range(1000, 2000, 2)}
    _, extra = mixing.fit_source(even, 10**9 + 1, 1)
    assert sum(n * k for n, k in extra.items()) == 10**9


def docs(spark, rows):
    return mixing.counted(spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_tokens string"))


def test_mixture(spark):
    random.seed(1)
    rows = [(i, random.choice(["Big", " big "]), "word " * random.randint(1, 40), "clash") for i in range(400)]
    rows += [(1000 + i, "small", "some more words here", None) for i in range(10)] + [(2000, "other", "x", None), (2001, None, "x", None), (2002, "big", None, None), (2003, "big", "", None)]
    targets = spark.createDataFrame([("\u00a0big\t", 2.0, 1), ("SMALL", 1.0, 3), ("gone", 1.0, 5), ("other", None, 5)], "source string, target_weight double, max_repeats int")
    counted = docs(spark, rows)
    mixed, shares = mixing.mixture(counted, targets)
    by = {r.source: r for r in shares.collect()}
    assert abs(by["big"].share - 2 / 3) < 0.01 and by["small"].whole_repeats == 3 and by["gone"].tokens == 0 == by["other"].tokens
    got = mixed.collect()
    assert sum(r.n_tokens * r.copies for r in got if r.source == "big") == by["big"].tokens and max(r.copies for r in got) == 3
    assert {(r.doc_id, r.copies) for r in mixing.mixture(counted, targets)[0].collect()} == {(r.doc_id, r.copies) for r in got}
    capped = {r.source: r for r in mixing.mixture(counted, targets, 10**6)[1].collect()}
    assert capped["big"].tokens == capped["big"].available_tokens and capped["small"].tokens == 3 * capped["small"].available_tokens


def test_equal_lengths_are_drawn_by_hash(spark):
    counted = docs(spark, [(i, "a", "same text", None) for i in range(300)])
    n = counted.first().n_tokens
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_weight double, max_repeats int")
    assert mixing.mixture(counted, targets, 100 * n)[0].count() == 100
    assert mixing.mixture(counted, targets, 350 * n)[0].where("copies = 2").count() == 50


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_weight double, max_repeats int")
    mixed, shares = mixing.mixture(docs(spark, []), targets)
    assert mixed.count() == 0 and shares.first().tokens == 0
