"""Similarity over many texts that share tokens: whole results, and no pairs on disk."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import similarity
from tallyforge.plans import catalog
from tallyforge.session import forget, shared_dir
from tests.oracle import check

#: 900 texts that are all asked make some 450,000 pairs; as rows of a shuffle they took more than 10 bytes each.
MOST_WRITTEN = 3_000_000


def _written(spark) -> int:
    """Bytes of shuffles written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    draw = random.Random(5)
    rows = [
        (100 * i, f"{draw.choice(['red', 'blue', 'small', 'the'])} {draw.choice(['gear', 'bolt', 'ring', 'plate'])}", f"Brand#{draw.randint(1, 9)}", draw.choice(["LARGE", "SMALL", "PROMO"]), draw.randint(1, 12))
        for i in range(900)
    ]
    folder = tmp_path_factory.mktemp("many")
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").toPandas().to_parquet(folder / "part.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["nodes_with_neighbours", "similar_parts", "similarity_degree", "part_influence", "similar_parts_by_cluster", "similarity_edges"])
def test_pairs_are_not_written(spark, many_parts, name):
    before = _written(spark)
    check(spark, catalog.R, name, many_parts)
    assert _written(spark) - before < MOST_WRITTEN


@pytest.mark.parametrize("clustered", [False, True])
def test_blocks_against_brute_force(spark, monkeypatch, clustered):
    monkeypatch.setattr(similarity, "TEXT_ROWS", 90)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 40)
    draw = random.Random(7)
    weights = {f"k{i:03}": {f"t{draw.randint(0, 14)}": draw.choice([0.1, 0.25, 0.5, 0.7]) for _ in range(draw.randint(1, 9))} for i in range(120)}
    groups = {k: draw.choice(["a", "b", None]) for k in weights} if clustered else {}
    asked, bonus = [k for k in weights if draw.random() < 0.6], 0.035 if clustered else 0.0
    want = set()
    for q in asked:
        near = []
        for m in weights:
            shared = weights[q].keys() & weights[m].keys()
            if m != q and shared:
                same = groups.get(q) is not None and groups.get(q) == groups.get(m)
                near.append((-round(round(sum(weights[q][t] * weights[m][t] for t in shared), 6) + bonus * same, 6), m))
        want |= {(q, m, -s, i + 1) for i, (s, m) in enumerate([x for x in sorted(near) if -x[0] >= 0.3][:4])}
    vec = spark.createDataFrame([(k, t, w) for k, v in weights.items() for t, w in v.items()], "k string, token string, w double")
    clusters = spark.createDataFrame(list(groups.items()), "k string, cluster string") if clustered else None
    queries = spark.createDataFrame([(k,) for k in asked], "k string")
    got = similarity.neighbours(vec, "k", queries, least=0.3, clusters=clusters, bonus=bonus)
    assert {tuple(r) for r in got.select("query", F.col("match"), "sim", "place").collect()} == want


def _kept(spark) -> int:
    """Bytes of the tables in the shared folder."""
    return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet") if p.is_file())


@pytest.fixture(scope="module")
def parts_of_all_kinds(spark, tmp_path_factory):
    draw = random.Random(11)
    rows = [
        (i, f"{draw.choice(['red', 'blue', 'small', 'the', 'red red'])} {draw.choice(['gear', 'bolt', 'ring', 'plate'])} lot{draw.randint(1, 999)}", f"Brand#{draw.randint(1, 25)}", draw.choice(["LARGE", "SMALL", "PROMO"]), draw.choice([None, *range(1, 50)]))
        for i in range(12_000)
    ]
    folder = tmp_path_factory.mktemp("kinds")
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(folder / "parts"))
    next((folder / "parts").glob("*.parquet")).rename(folder / "part.parquet")
    return str(folder)


#: Bytes a part in shuffles and kept tables.
MOST_A_PART = 110


@pytest.mark.parametrize("name", ["similar_parts", "part_influence", "similar_parts_by_cluster", "similarity_edges"])
def test_disk_of_a_part(spark, parts_of_all_kinds, name):
    """Parts without a size have no tokens in SQL."""
    forget(spark)
    before = _written(spark) + _kept(spark)
    check(spark, catalog.R, name, parts_of_all_kinds)
    assert (_written(spark) + _kept(spark) - before) / 12_000 < MOST_A_PART


@pytest.mark.parametrize("clustered", [False, True])
def test_whole_texts_against_vectors(spark, monkeypatch, clustered):
    monkeypatch.setattr(similarity, "TEXT_ROWS", 90)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 40)
    draw = random.Random(3)
    rows = [(i, [f"t{draw.randint(0, 14)}" for _ in range(draw.randint(1, 9))], draw.random() < 0.6, draw.choice(["a", "b", None])) for i in range(120)]
    rows += [(None, ["t0", "t1"], True, "a"), (200, [], True, "a"), (201, None, True, "b"), (202, ["t0"], None, None), (203, ["only"], True, None)]
    docs = spark.createDataFrame(rows, "k long, ts array<string>, asked boolean, c string")
    vec = similarity.vectors(docs, "k", "ts").where("k is not null")
    clusters, bonus = (docs.where("k is not null and c is not null").select("k", F.col("c").alias("cluster")), 0.035) if clustered else (None, 0.0)
    want = similarity.neighbours(vec, "k", docs.where("asked"), least=0.3, clusters=clusters, bonus=bonus)
    got = similarity.similar_texts(docs, "k", "ts", "asked", least=0.3, cluster=F.col("c") if clustered else None, bonus=bonus)
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(tuple(r) for r in want.collect()) and len(found) > 100


def test_whole_texts_without_rows(spark):
    docs = spark.createDataFrame([], "k long, ts array<string>, asked boolean")
    assert similarity.similar_texts(docs, "k", "ts", "asked").isEmpty()
    lone = spark.createDataFrame([(1, [], True), (2, None, True)], docs.schema)
    assert similarity.similar_texts(lone, "k", "ts", "asked").isEmpty()


def test_influence_of_many_classes(spark, monkeypatch, parts_of_all_kinds):
    """Classes with an edge that are too many for a broadcast are joined by a shuffle."""
    monkeypatch.setattr(catalog.skew, "broadcast_if_small", lambda df: df)
    check(spark, catalog.R, "part_influence", parts_of_all_kinds)
