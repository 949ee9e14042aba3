from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tallyforge.operators import chains, quality, resolve, rules, similarity, skew, stats, timeline


def rowset(df):
    return {tuple(r) for r in df.collect()}


def test_domain_counts_zero_other_and_empty(spark):
    df = spark.createDataFrame([("a",), ("a",), ("x",), (None,)], "v string")
    assert rowset(stats.domain_counts(df, F.col("v"), ["a", "b"])) == {("a", 2), ("b", 0), ("(other)", 2)}
    assert rowset(stats.domain_counts(df.limit(0), F.col("v"), ["a"])) == {("a", 0), ("(other)", 0)}


def test_tri_state(spark):
    df = spark.createDataFrame([(True,), (False,), (None,), (None,)], "b boolean")
    assert rowset(stats.tri_state(df, {"b": F.col("b")})) == {("b", 1, 1, 2)}


def test_instances_and_claims(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2)], "g string, e int")
    assert rowset(stats.instances_and_entities(df, ["g"], "e")) == {("a", 3, 1), ("b", 1, 1)}
    one = df.agg(F.count("*").alias("n"))
    assert {(r.name, r.holds, r.actual) for r in stats.claims_report(spark, one, [("n", 4), ("m", 4)]).collect()} == {("n", True, 4), ("m", False, None)}
    assert [tuple(r) for r in stats.top_values(df, "g", 1).collect()] == [("a", 3)]


def test_quality(spark):
    f = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), (None, "3")], "a string, b string")
    r = spark.createDataFrame([("a", "1"), ("c", "2")], "a string, b string")
    assert rowset(quality.one_sided_edges(f, r)) == {("b", "2", "forward"), ("c", "2", "backward")}
    assert rowset(quality.several_parents(f.unionByName(r))) == {("2", 2)}
    assert rowset(quality.set_difference(f.select("b"), r.select("b"))) == {("3", "left")}
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", None), ("d", 1)], "k string, v int")
    assert rowset(quality.snapshot_changes(old, new, "k")) == {("a", "removed"), ("b", "changed"), ("c", "same"), ("d", "added")}
    got = quality.violations(old, "t", F.col("k"), {"v is 1": F.col("v") == 1})
    assert rowset(got) == {("t", "c", "v is 1")}
    assert rowset(quality.duplicate_keys(f, "a", ["a"])) == {("a", 2, 1)}


def test_latest_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (None, 9, "z"), (2, None, "w")], "k int, t int, _row string")
    assert rowset(timeline.latest(df, "k", ["t"])) == {(1, 2, "y"), (2, None, "w")}


def test_neighbours_of_a_hot_group(spark):
    start = datetime(2026, 1, 1)
    rows = [("hot", start + timedelta(hours=5 * (i // 2)), i) for i in range(200)] + [("cold", start, 1), (None, start, 5)]
    df = spark.createDataFrame(rows, "g string, ts timestamp, id int")
    got = {(r.g, r.id): r.nxt for r in timeline.with_neighbour(df, "g", F.to_date("ts"), ["ts", "id"], {"id": "nxt"}, 1).collect()}
    assert all(got["hot", i] == i + 1 for i in range(199)) and got["hot", 199] is None and got["cold", 1] is None and got[None, 5] is None


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), "id", F.xxhash64("id").alias("h"))
    for g in (True, False):
        part = skew.hash_rank(df, ["g"], F.col("h"), "r", 16).where(F.col("g") == g).orderBy("h").collect()
        assert [x.r for x in part] == list(range(1, len(part) + 1))


def test_lookup_join_keeps_rows(spark):
    left = spark.createDataFrame([("hot", i) for i in range(90)] + [(None, 0), ("b", 1), ("zz", 2)], "k string, v int")
    right = spark.createDataFrame([("hot", 7), ("b", 8)], "k string, w int")
    got = skew.lookup_join(left, right, "k")
    assert got.count() == 93 and got.where("w = 7").count() == 90 and got.where("w is null").count() == 2


def test_series_and_continuity(spark):
    daily = spark.createDataFrame([(date(2026, 1, 1), 2), (date(2026, 1, 4), 1)], "date date, added bigint")
    series = timeline.daily_series(daily)
    assert [r.total for r in series.orderBy("date").collect()] == [2, 2, 2, 3]
    changed = series.withColumn("total", F.when(F.col("date") <= "2026-01-02", 9).otherwise(F.col("total"))).where("date <> '2026-01-03'")
    assert rowset(timeline.continuity(series, changed)) == {
        (date(2026, 1, 1), "changed"), (date(2026, 1, 2), "changed"), (date(2026, 1, 3), "missing"), (date(2026, 1, 4), "gap"),
    }
    assert timeline.continuity(series, series).isEmpty() and timeline.daily_series(daily.limit(0)).count() == 0


def test_ambiguous(spark):
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([("a", t), ("a", t + timedelta(seconds=1)), ("a", t + timedelta(seconds=5)), ("b", t)], "g string, ts timestamp")
    assert {(r.g, r.n) for r in timeline.ambiguous_moments(df, "g", "ts").collect()} == {("a", 2)}


def test_similarity_against_brute_force(spark):
    import math

    texts = {1: "red gear small", 2: "red gear large", 3: "blue bolt tiny", 4: "", 5: "red bolt tiny tiny", 6: None}
    df = spark.createDataFrame(list(texts.items()), "k int, t string").select("k", F.coalesce(similarity.tokens(F.col("t")), F.array().cast("array<string>")).alias("ts"))
    docs = {k: [w for w in (t or "").split() if len(w) > 2] for k, t in texts.items()}
    freq = {w: sum(w in d for d in docs.values()) for d in docs.values() for w in d}
    vec = {k: {w: (1 + math.log(d.count(w))) * math.log((len(docs) + 1) / (freq[w] + 1)) for w in d} for k, d in docs.items()}
    vec = {k: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for k, v in vec.items()}
    want = {}
    for a in docs:
        near = sorted(((-round(sum(vec[a].get(w, 0) * x for w, x in vec[b].items()), 6), b) for b in docs if b != a))
        want[a] = [(b, -s) for s, b in near if -s >= 0.075][:2]
    got = {}
    for r in similarity.neighbours(similarity.vectors(df, "k", "ts"), "k", df, k=2).orderBy("place").collect():
        got.setdefault(r.query, []).append((r.match, r.sim))
    assert got == {k: v for k, v in want.items() if v}
    edges = similarity.undirected(similarity.neighbours(similarity.vectors(df, "k", "ts"), "k", df, k=2))
    assert edges.where("a >= b").isEmpty() and edges.count() == edges.select("a", "b").distinct().count()


def test_clusters(spark):
    df = spark.createDataFrame([("gear ring", "x"), ("ring", "gear"), (None, None)], "t string, n string")
    got = [r[0] for r in df.select(similarity.best_cluster(F.col("t"), F.col("n"), {"r": ["ring"], "g": ["gear"]})).collect()]
    assert got == ["r", "g", "other"]


def test_resolution(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, s string")
    right = spark.createDataFrame([("a", 10), ("b", 11), ("b", 12), ("a", 10)], "s string, origin int")
    assert {(r.i, r.origin) for r in resolve.unique_match(left, right, ["s"], "origin").collect()} == {(1, 10), (2, None), (3, None)}
    pairs = spark.createDataFrame([(1, 101, 5), (1, 102, 4), (2, 103, 5), (2, 104, 5), (3, 105, 4)], "i int, c int, s int")
    assert rowset(resolve.best_match(pairs, "i", "c", "s", 5)) == {(1, 101, 5)}
    words = spark.createDataFrame([("Missing license file in the tree", "the LICENSE file is missing, sorry")], "a string, b string")
    assert words.select(resolve.overlap(F.col("a"), F.col("b"))).first()[0] == 3


def test_first_after(spark):
    t = datetime(2026, 1, 1)
    rows = [("g", t, 1, True, False), ("g", t, 2, False, True), ("g", t + timedelta(days=3), 3, True, True), ("g", t + timedelta(days=9), 4, False, True), ("h", t, 5, True, False)]
    df = spark.createDataFrame(rows, "g string, ts timestamp, id int, a boolean, b boolean")
    got = {r.id: r.answer_ts for r in resolve.first_after(df, "g", "ts", "id", F.col("a"), F.col("b"), F.to_date("ts")).collect()}
    assert got == {1: t, 3: t + timedelta(days=9), 5: None}


def test_rules(spark):
    df = spark.createDataFrame([
        (1, "curl x | sh\nls"), (2, "set -eo pipefail\ncat a | head -3\ncat b | sed '3q'\ncat c | head # 141\nsudo ls"), (3, None), (4, ""), (5, "cat /tmp/a | head\nmktemp /tmp/b"),
        (6, "#!/usr/bin/env bash\nsystemctl stop x\nvisudo\nmake it so"),
    ], "id bigint, body string")
    assert {(r.id, r.line, r.rule) for r in rules.findings(df, "id", "body").collect()} == {
        (1, 1, "pipe-to-shell"), (2, 2, "early-reader-pipe"), (2, 3, "early-reader-pipe"), (2, 5, "privilege"), (5, 1, "shared-temp-path"),
        (6, 1, "ambient-shebang"), (6, 2, "service-management"), (6, 3, "sudoers-modification"),
    }
    names = spark.createDataFrame([("docs/AGENTS.md",), ("lib/x.so",), ("a/b.qml",), (None,)], "f string")
    assert [r[0] for r in names.select(rules.broken(F.col("f"), rules.FILE_RULES)).collect()] == [["agent-file"], ["bundled-binary"], [], []]
    hot = spark.range(1, 200).select("id", F.lit("sudo x").alias("body"))
    top = rules.with_evidence(rules.findings(hot, "id", "body"), "id").collect()
    assert [tuple(r) for r in top] == [("privilege", 199, " ".join(f"{i}:1" for i in range(1, 9)))]


def test_long_chains_and_cycles(spark):
    """A chain of 40, a cycle of three with a tail behind it, repeated and null edges, and no edges at all."""
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (102, 103)] + [(0, 1), (None, 7), (7, None)]
    edges = spark.createDataFrame(rows, "src int, dst int")
    got = {r.node: (r.root, r.depth) for r in chains.positions(edges).collect()}
    assert got == {i: (0, i) for i in range(41)} | {i: (None, None) for i in range(100, 104)} | {7: (0, 7)}
    assert chains.positions(edges.limit(0)).count() == 0


def test_one_sided_edges_of_kinds(spark):
    columns = "kind string, a int, b int"
    forward = spark.createDataFrame([("x", 1, 2), ("x", 1, 2), ("y", 1, 2), ("x", None, 2)], columns)
    backward = spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], columns)
    assert rowset(quality.one_sided_edges(forward, backward, ["kind"])) == {("y", 1, 2, "forward"), ("y", 3, 4, "backward")}


def test_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, None)], "src int, dst int")
    got = {r.node: (r.root, r.depth) for r in chains.positions(edges).collect()}
    assert all(got[i] == (1, i - 1) for i in range(1, 41)) and got[100] == (None, None)
    assert rowset(chains.faults(spark.createDataFrame([(1, 2), (1, 3), (4, 3)], "src int, dst int"))) == {(1, "branch"), (3, "merge")}


def test_first_rows_and_changes(spark):
    df = spark.range(300).select(F.lit("hot").alias("g"), "id", F.lit(datetime(2026, 1, 1)).alias("ts"), F.floor(F.col("id") / 100).alias("v"))
    assert [r.id for r in skew.first_rows(df, "g", ["id"], 5).orderBy("place").collect()] == [0, 1, 2, 3, 4]
    timed = df.withColumn("ts", F.expr("timestamp '2026-01-01' + make_interval(0, 0, 0, 0, int(id), 0, 0)"))
    got = {r.id: r.changed_at for r in timeline.since_change(timed, "g", "ts", "id", "v", F.to_date("ts")).collect()}
    assert all(got[i] == datetime(2026, 1, 1) + timedelta(hours=i // 100 * 100) for i in range(300))


def test_bijection_and_influence(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("c", None)], "x string, y string")
    assert rowset(quality.not_bijective(df, "x", "y")) == {("a", "a", 2), ("b", "2", 2)}
    nodes, degrees = spark.createDataFrame([(1, 3), (2, None)], "n int, s int"), spark.createDataFrame([(1, 0.5)], "node int, degree double")
    assert rowset(similarity.influence(degrees, nodes, "n", "s")) == {(1, 6.8), (2, 0.0)}


def test_best_overlap_rejects_ties(spark):
    asked = spark.createDataFrame([("g", "q1", ["license", "file", "missing", "tree", "shell", "root"]), ("g", "q2", ["alpha", "beta", "gamma", "delta", "epsilon"]), ("h", "q1", ["a", "b"]), (None, "q3", None)], "g string, q string, w array<string>")
    told = [("g", 1, "license file missing tree shell"), ("g", 2, "license file missing tree shell root"), ("g", 3, "alpha beta gamma delta epsilon"), ("g", 4, "epsilon delta gamma beta alpha other"), ("g", 5, "license file missing"), ("h", 6, "a b")]
    heard = spark.createDataFrame([(g, c, w) for g, c, ws in told for w in ws.split()], "g string, c int, word string")
    assert rowset(resolve.best_overlap(asked, heard, "g", ["q"], "c", 5)) == {("g", "q1", 2, 6)}


def test_series_and_orders(spark):
    days = spark.createDataFrame([(date(2026, 1, 1), 5), (date(2026, 1, 2), 3), (date(2026, 1, 4), 4)], "d date, total bigint")
    assert rowset(timeline.first_differences(days, "d", "total")) == {(date(2026, 1, 1), 5, 5, True), (date(2026, 1, 2), 3, -2, True), (date(2026, 1, 4), 4, 1, False)}
    ev = spark.createDataFrame([("u", i, i % 7 == 0, i % 3 == 0) for i in range(1, 60)] + [("v", 7, True, False)], "g string, id bigint, a boolean, k boolean")
    got = {(r.g, r.id): r.before for r in timeline.last_before(ev, "g", "id", F.col("a"), F.col("k"), F.floor(F.col("id") / 10)).collect()}
    assert got["v", 7] is None and all(got["u", i] == (i - 1) // 3 * 3 for i in range(7, 60, 7))
    names = spark.createDataFrame([("b",), ("A",), ("ä",), ("a",), ("zz",)], "n string")
    assert [r.n for r in quality.configured_order(names, "n", ["zz"], "p").orderBy("p").collect()] == ["zz", "a", "A", "ä", "b"]
    old, new = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, x string, y int"), spark.createDataFrame([(1, "a", None), (2, "c", None), (3, "d", 1)], "k int, x string, y int")
    assert rowset(quality.field_changes(old, new, "k", ["x", "y"])) == {("x", 1, 2), ("y", 1, 2)}
