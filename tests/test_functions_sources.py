import base64
import json

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.strict_json import fault
from tallyforge.session import materialize, shared_dir
from tallyforge.sources import files
from tallyforge.streaming import live


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).first()[0]


def test_text_functions(spark):
    h = 0
    for c in "blue bolt":
        h = (h * 31 + ord(c)) % 2**32
    assert one(spark, T.hash31(F.col("c0")), "blue bolt") == h
    assert one(spark, T.hash31(F.col("c0"), 7), "") == 7 and one(spark, T.hash31(F.col("c0")), None) is None
    assert one(spark, T.initials(F.col("c0")), "  tiny-blue bolt") == "TB"
    assert one(spark, T.section(F.col("c0"), "Plugin ID"), "### Repository URL\n\nx\n\n### Plugin ID\n\n a.b \n\n### C\n") == "a.b"
    assert one(spark, T.section(F.col("c0"), "No"), "### Yes\nx") is None
    assert one(spark, T.repository_slug(F.col("c0")), "https://Git.example/Own/Name.git") == "own/name"
    assert one(spark, T.repository_slug(F.col("c0")), "git.example/x") is None
    assert one(spark, T.markdown_escape(F.col("c0")), "a|b*c") == "a\\|b\\*c"
    assert one(spark, T.sentence(F.col("c0")), " two \n words ") == "two words."
    coded = base64.urlsafe_b64encode(json.dumps({"x": "ü??>"}).encode()).decode().rstrip("=")
    assert json.loads(one(spark, T.payload(F.col("c0"), "m:v1"), f"<!-- m:v1 e30 --> <!-- m:v1 {coded} -->")) == {"x": "ü??>"}
    assert one(spark, T.payload(F.col("c0"), "m:v1"), "nothing") is None


def test_markdown_functions(spark):
    blocks = spark.createDataFrame([("a\n```sh\nls\npwd\n```\n```\nx\n```\n```py\nopen",), (None,)], "c0 string").select(T.code_blocks(F.col("c0"))).collect()
    assert [(b.language, b.code) for b in blocks[0][0]] == [("sh", "ls\npwd"), ("", "x")]
    assert tuple(one(spark, T.checklist(F.col("c0")), "- [x] a\n* [ ] b\n- [X] c")) == (2, 3)
    tags = T.tags(F.split("c0", ","), {"menu-bar": "bar", "junk": None})
    assert one(spark, tags, " Menu Bar,bar,junk,Two_Words,é!,x,y") == ["bar", "two-words", "x"]
    assert one(spark, T.full_trim(F.col("c0")), "\ufeff\u00a0 a\u0085 \n") == "a\u0085"
    assert one(spark, T.path_segments(F.col("c0")), "a b/c&d/e") == "a%20b/c%26d/e"
    assert one(spark, T.unfenced(F.col("c0")), "```json\n{}\n```") == "{}"


def test_paths_tags_and_marks(spark):
    good, bad = ["a/b.qml", "x", "..a/b"], ["/a", "a//b", "../a", "a/./b", "C:x", "a\\b", "", "a/", "a\0b"]
    assert all(one(spark, T.safe_path(F.col("c0")), p) for p in good) and not any(one(spark, T.safe_path(F.col("c0")), p) for p in [*bad, None])
    assert one(spark, T.release_tag(F.col("c0")), "v1.0-é") == "v1.0-é" and all(one(spark, T.release_tag(F.col("c0")), t) is None for t in ["", "a\u202eb", "a\nb", "x" * 257, None])
    assert one(spark, T.pointer_key(F.col("c0")), "$.statistics.n_records") == "n_records" and one(spark, T.pointer_key(F.col("c0")), "statistics") is None
    assert one(spark, T.preferred(F.split("c0", ","), ["m", "k"]), "b,k,a,m") == "m" and one(spark, T.preferred(F.split("c0", ","), ["m"]), "b,a") == "a"
    assert one(spark, T.marked_lines(F.col("c0"), "❌"), "x\n ❌ one\n❌two ❌") == ["one", "two ❌"]


def test_strict_json():
    assert fault('{"a": 1.5}') is None
    cases = {"": "blank", None: "blank", '{"a": 1, "a": 2}': "repeated name", '{"a": NaN}': "not finite", '{"a": 1e400}': "not finite", "[1]": "no object", '{"a": 1} x': "syntax"}
    assert {k: fault(k) for k in cases} == cases


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "a": 3}\n{"a": 4}\n')
    rows, faults = files.read_json_lines(spark, str(tmp_path), "a bigint, b string")
    assert {tuple(r) for r in rows.collect()} == {(1, "x"), (4, None)}
    assert {r.fault for r in faults.collect()} == {"blank", "repeated name"}


def test_canonical_json_does_not_depend_on_partitions(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else "é") for i in range(50)], "b int, a string")
    for i, n in enumerate((1, 7)):
        files.write_canonical_json(df.repartition(n), str(tmp_path / str(i)), "b")
    texts = ["".join(p.read_text() for p in sorted((tmp_path / str(i)).glob("part-*"))) for i in (0, 1)]
    assert texts[0] == texts[1] and texts[0].startswith('{"a":"é","b":0}\n{"a":null,"b":1}')


def test_inventory_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "chunk int, v string")
    files.write_chunks(df, str(tmp_path / "c"), "chunk")
    found = files.inventory(spark, str(tmp_path / "c"), "*.json")
    assert found.count() >= 2 and all(len(r.sha256) == 64 for r in found.collect())
    assert {r.folder.rsplit("=", 1)[1] for r in files.manifest_digests(found).collect()} == {"1", "2"}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (None, "e")], "k int, v string")
    assert {tuple(r) for r in files.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_materialize_reads_the_shared_folder(spark):
    df = materialize(spark.range(5).withColumn("n", F.lit(None)))
    assert shared_dir(spark) in df.inputFiles()[0] and df.count() == 5


def test_streams(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "t")
    schema = "k int, v string, ts timestamp"
    assert live.current(spark, table) is None
    for rows in ([(1, "a", "2026-01-01"), (2, "b", "2026-01-01")], [(2, "c", "2026-01-02"), (3, "d", "2026-01-04")]):
        spark.createDataFrame(rows, "k int, v string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(source)
        live.keep_latest(spark.readStream.schema(schema).parquet(source), table, "k", str(tmp_path / "cp")).awaitTermination()
    assert {(r.k, r.v) for r in live.current(spark, table).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    counts = live.daily_counts(spark.readStream.schema(schema).parquet(source), "ts")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(str(r.date), r.n) for r in spark.table("days").collect()} == {("2026-01-01", 2), ("2026-01-02", 1), ("2026-01-04", 1)}


def test_a_batch_that_is_run_again(spark, tmp_path):
    """A crash after the data, before or after the list of versions, loses nothing and repeats nothing."""
    table = str(tmp_path / "t")

    def batch(*rows):
        return spark.createDataFrame(list(rows), "k int, v string, ts int")

    live.merge_batch(batch((1, "a", 1)), 0, table, "k")
    batch((9, "half", 9)).write.parquet(f"{table}/v1")  # crashed before its number was listed
    assert {(r.k, r.v) for r in live.current(spark, table).collect()} == {(1, "a")}
    for _ in range(2):  # run again, twice
        live.merge_batch(batch((1, "b", 2), (2, "c", 2)), 1, table, "k")
        assert {(r.k, r.v) for r in live.current(spark, table).collect()} == {(1, "b"), (2, "c")}


def test_arrays_texts_and_valid_writes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2, "y": 3}]')
    assert {tuple(r) for r in files.read_json_array(spark, str(tmp_path / "a.json"), "x int").collect()} == {(1,), (2,)}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "s.txt").write_bytes(b"a\xffb")
    (tmp_path / "d" / "l.txt").write_text("x" * 100)
    texts, refused = files.read_texts(spark, str(tmp_path / "d"), 50)
    assert [r.text for r in texts.collect()] == ["a\ufffdb"] and [r.length for r in refused.collect()] == [100]
    assert files.inventory(spark, str(tmp_path / "d"), without=r"/s\.txt$").count() == 1
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert [tuple(r)[1:] for r in files.write_valid(df, str(tmp_path / "o"), "k", {"v told": F.col("v").isNotNull()}).collect()] == [("2", "v told")]
    assert not (tmp_path / "o").exists()
    assert files.write_valid(df, str(tmp_path / "o"), "k", {"k told": F.col("k").isNotNull()}).isEmpty() and (tmp_path / "o").exists()
    assert {tuple(r) for r in files.write_chunks(df, str(tmp_path / "c"), "k").collect()} == {(1, 1), (2, 1)}


def test_broadcast_needs_few_rows_and_bytes(spark):
    from tallyforge.operators.skew import broadcast_if_small

    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    def hinted(d):
        return "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, max_rows=99)) and not hinted(broadcast_if_small(df, max_bytes=50_000))


def test_forget(spark):
    from tallyforge.session import forget

    df = materialize(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    import os

    assert os.path.exists(path)
    forget(spark)
    assert not os.path.exists(path)
