from datetime import datetime

from tallyforge.operators import references
from tallyforge.operators.references import Reference

PARENT = "id string, up string, loaded_at timestamp, removed_at timestamp"
CHILD = "id string, one string, many array<string>, loaded_at timestamp"


def day(n):
    return datetime(2026, 1, n)


def found(spark, parents, children, graph):
    tables = {"p": (spark.createDataFrame(parents, PARENT), "id"), "c": (spark.createDataFrame(children, CHILD), "id")}
    return {tuple(r) for r in references.orphan_cascade(tables, graph).select("child_table", "child_id", "field", "ref_id", "kind", "depth").collect()}


GRAPH = [Reference("c", "one", "p"), Reference("c", "many", "p"), Reference("p", "up", "p")]


def test_kinds_and_inheritance(spark):
    parents = [("A", None, day(1), None), ("b ", None, day(9), None), ("d", None, day(1), day(3)), ("d", None, day(2), None), ("e", "nowhere", day(1), None), ("f", "E", day(1), None)]
    children = [
        ("c1", " a", ["B", "D", "zz", None, "", " "], day(5)),
        ("c1", " a", ["B", "D", "zz", None, "", " "], day(7)),  # delivered again
        ("c2", "f", None, day(2)),
        ("c3", None, [], day(2)),
    ]
    got = found(spark, parents, children, GRAPH)
    assert got == {
        ("c", "c1", "many", "b", "late", 0), ("c", "c1", "many", "d", "deleted", 0), ("c", "c1", "many", "zz", "missing", 0),
        ("p", "e", "up", "nowhere", "missing", 0), ("p", "f", "up", "e", "inherited", 1), ("c", "c2", "one", "f", "inherited", 2),
    }


def test_cycle_ends(spark):
    parents = [("x", "y", day(1), None), ("y", "x", day(1), None), ("x", "gone", day(1), None)]
    got = found(spark, parents, [("c", "y", None, day(2))], GRAPH)
    assert ("p", "x", "up", "gone", "missing", 0) in got and ("c", "c", "one", "y", "inherited", 2) in got


def test_empty_tables(spark):
    assert found(spark, [], [], GRAPH) == set()


def test_hot_key(spark):
    """A third of the references name one key."""
    parents = [("hot", None, day(1), None)] + [(f"k{i}", None, day(1), None) for i in range(50)]
    children = [(f"c{i}", "hot" if i % 3 == 0 else f"k{i % 60}", None, day(2)) for i in range(600)]
    got = found(spark, parents, children, GRAPH)
    assert {x[3] for x in got} == {f"k{i}" for i in range(50, 60) if any(j % 60 == i and j % 3 for j in range(600))}


def test_long_cascades_end_only_when_nothing_is_left(spark):
    parents = [(f"n{i}", f"n{i - 1}" if i else "gone", day(1), None) for i in range(30)]
    got = found(spark, parents, [], GRAPH)
    assert {(x[1], x[5]) for x in got} == {(f"n{i}", i) for i in range(30)}
