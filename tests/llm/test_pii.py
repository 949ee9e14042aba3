import pytest

from tallyforge.llm import pii, pii_spans

CASES = {
    "You can reach me at greta.holm+list@post.example if the build breaks again.": {("email", "greta.holm+list@post.example")},
    "cc w_stone (at) box (dot) test, Ivan7 AT post DOT example": {("email", "w_stone (at) box (dot) test"), ("email", "Ivan7 AT post DOT example")},
    "Clone it with git@git.example:kit/shelf.git and retry. The dependency @kit/core@2.1.0 is pinned. The prompt shows dev@box:~$ here.": set(),
    "Please call (212) 555 0142 ext. 7 or +44 20 7946 0188 before noon.": {("phone", "(212) 555 0142 ext. 7"), ("phone", "+44 20 7946 0188")},
    "Build 2125550142 failed twice. Job 442079460188 used 12 workers. Measured 1853-35-4402 microseconds.": set(),
    "My passport 00 00 253446 was printed, my identity number is X00821093.": {("id_number", "00 00 253446"), ("id_number", "X00821093")},
    "Send the board to Flat 7, 167 Mill Hill Lane, Port Amber WX4 0ZZ.": {("address", "Flat 7, 167 Mill Hill Lane, Port Amber WX4 0ZZ")},
    "Meine Anschrift lautet Lindenstraße 15a, 00543 Bad Amsel.": {("address", "Lindenstraße 15a, 00543 Bad Amsel")},
    "Baker Lane Clock is the name of the fork. The Solar Deck theme is new. See section 12 Main Layout.": set(),
    "I spoke with Marta R. Keller-Braun yesterday. Signed-off-by: Stein, Viktor <x1@y.example>": {("name", "Marta R. Keller-Braun"), ("name", "Stein, Viktor"), ("email", "x1@y.example")},
    "Hi Greta, thanks! Marta is away.": set(),
    "": set(), None: set(),
}


@pytest.fixture(scope="module")
def rows(spark):
    texts = list(CASES)
    return spark.createDataFrame([(i, texts[i % len(texts)], "clash") for i in range(40 * len(texts))], "row_id bigint, body string, spans string")


def test_details(spark, rows):
    texts = list(CASES)
    got = {}
    for r in pii.details(rows.select("row_id", "body"), ["row_id"]).collect():
        got.setdefault(texts[r.row_id % len(texts)], set()).add((r.kind, r.value))
        assert texts[r.row_id % len(texts)][r.start : r.stop] == r.value
    assert {t: got.get(t, set()) for t in CASES} == CASES


def test_redaction_keeps_the_rest(spark, rows):
    few = rows.select("row_id", "body")
    out = {r.row_id: r.body for r in pii.redact(few, ["row_id"]).collect()}
    texts = list(CASES)
    assert out[texts.index("You can reach me at greta.holm+list@post.example if the build breaks again.")] == "You can reach me at [EMAIL] if the build breaks again."
    for i, t in enumerate(texts):
        if not CASES[t]:
            assert out[i] == t
    assert len(out) == rows.count()


def test_reliabilities():
    counts = {(1, 1, 1): 60, (1, 0, 1): 20, (0, 1, 1): 10, (0, -1, -1): 50, (-1, -1, 0): 30, (0, 0, 0): 5}
    p = pii.reliabilities(counts)
    assert p[1, 1, 1] > 0.95 and p[0, 1, 1] > 0.8 and p[0, -1, -1] < 0.1 and p[-1, -1, 0] < 0.1
    assert pii.reliabilities({(1, 0, 1): 7})[1, 0, 1] > 0.8  # one pattern only: sides don't change places


def test_features_are_stable():
    a = pii_spans.features("call 12", "phone", 5, 7, [1, 0], 100)
    assert a == pii_spans.features("call 12", "phone", 5, 7, [1, 0], 100) and all(0 <= x < 100 for x in a)


def test_long_and_empty(spark):
    long = "x " * 300_000 + "write to ann.lee@post.example"
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], "row_id bigint, body string")
    assert [tuple(r) for r in pii.details(df, ["row_id"]).select("row_id", "value").collect()] == [(1, "ann.lee@post.example")]
    assert pii.details(df.limit(0), ["row_id"]).count() == 0


OUTSIDE = ["Siobhan", "Zbigniew", "Wei", "Oluwaseun", "Thandiwe", "Kwame", "Saoirse", "Yuki", "Anneliese", "Ravindra", "Xochitl", "Bjarte"]


def test_names_outside_the_list(spark):
    """Names whose given name no list knows, put in the place of known ones in texts of the tables: most are found, and hardly anything else is."""
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")
    bodies = spark.read.parquet(f"{folder}/comments.parquet").selectExpr("id row_id", "body").where("body is not null").dropDuplicates(["row_id"])
    assert not {x.lower() for x in OUTSIDE} & pii_spans.GIVEN
    found = {}
    for r in pii.details(bodies, ["row_id"]).where("kind = 'name'").collect():
        found.setdefault(r.row_id, []).append(r)
    texts = {r.row_id: r.body for r in bodies.collect()}
    changed, want = [], set()
    for n, (row, spans) in enumerate(sorted(found.items())):
        text = texts[row]
        for s in sorted(spans, key=lambda s: -s.start):
            given = next((w for w in s.value.replace(",", " ").split() if w.lower() in pii_spans.GIVEN), None)
            if given:
                name = s.value.replace(given, OUTSIDE[n % len(OUTSIDE)])
                text = text[: s.start] + name + text[s.stop :]
                want.add((-row, name))
        changed.append((-row, text))
    both = bodies.unionByName(spark.createDataFrame(changed, bodies.schema))
    got = {(r.row_id, r.value) for r in pii.details(both, ["row_id"]).where("kind = 'name' and row_id < 0").collect()}
    expected = want | {(-row, s.value) for row, spans in found.items() for s in spans}
    print("names outside the list:", len(want), "recall", len(got & want) / len(want), "precision", len(got & expected) / max(1, len(got)))
    assert len(want) > 30 and len(got & want) >= 0.6 * len(want) and len(got & expected) >= 0.9 * len(got)
