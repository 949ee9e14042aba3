from datetime import datetime

from tallyforge.llm import conversations as c

COMMENTS = "id bigint, issue_number bigint, user string, created_at string, body string, fetched_at timestamp, speaker string"
ISSUES = "number bigint, user string, created_at string, fetched_at timestamp"


def test_instants(spark):
    cases = {
        "2026-01-05T01:00:00Z": 1, "2026-01-05 01:00:00": 1, "2026-01-05T02:00:00+01:00": 1, "2026-01-05T01:00:00.000Z": 1, "2026-01-05T01:00": 1,
        "2026-02-30T01:00:00Z": None, "n/a": None, "": None, None: None, "2026-01-05": None, "2026-13-01T00:00:00Z": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", c.instant(df.t)).collect()}
    assert {k: v and v.hour for k, v in got.items()} == cases


def tables(spark, comments, issues, accounts=(("Bot", "bot"), ("boss", "maintainer"))):
    t = datetime(2026, 2, 1)
    rows = [(i, n, u, f"2026-01-{d:02d}T00:00:00Z" if isinstance(d, int) else d, b, t, "clash") for i, n, u, d, b in comments]
    return (
        spark.createDataFrame(rows, COMMENTS), spark.createDataFrame([(n, u, f"2026-01-{d:02d}T00:00:00Z", t) for n, u, d in issues], ISSUES),
        spark.createDataFrame(list(accounts), "login string, role string"),
    )


def reasons(spark, *args):
    comments, issues, accounts = tables(spark, *args)
    return {r.issue_number: r.reason for r in c.verdicts(c.turns(comments, accounts), c.openers(issues)).collect()}


def test_reasons(spark):
    comments = [
        (1, 1, "ann", 2, "hello"), (2, 1, "Boss", 3, "answer"), (2, 1, "Boss", 3, "answer"),
        (3, 2, "ann", 2, "x"),  # no such issue
        (4, 3, "bob", 1, "too early"), (5, 4, "bob", None, "undated"), (6, 5, "bob", 5, "<!-- text --> 👍 ?!"), (7, 5, "x", 5, None),
        (8, 6, "bob", 5, "q"), (9, 6, "ANN", 6, "by the opener"), (10, 7, "BOT", 6, "only a bot"), (11, 0, "x", 6, "none"), (12, None, "x", 6, "none"),
        (13, 8, "bob", 6, "tie"), (14, 8, "ann", 6, "the opener's id is later"), (15, 9, None, 6, "nobody answers"), (16, 9, "", 7, "nobody"),
    ]
    issues = [(n, "ann", 2) for n in (1, 3, 4, 5, 6, 7, 8)] + [(9, None, 2)]
    assert reasons(spark, comments, issues) == {1: None, 2: "broken", 3: "broken", 4: "broken", 5: "empty", 6: "unanswered", 7: "unanswered", 8: "unanswered", 9: None}


def test_turns_of_a_hot_discussion(spark):
    comments = [(i, 1, "bob" if i % 2 else "ann", 2 + i % 20, f"text {i}") for i in range(1, 121)] + [(500, 2, "bot", 3, "x"), (501, 2, "boss", 4, "y")]
    got = c.conversations(*tables(spark, comments, [(1, "zed", 1), (2, "ann", 1)])).orderBy("issue_number", "turn_no").collect()
    first = [r for r in got if r.issue_number == 1]
    assert [r.turn_no for r in first] == list(range(120)) and [(r["at"], r.id) for r in first] == sorted((r["at"], r.id) for r in first)
    assert [r.role for r in got if r.issue_number == 2] == ["bot", "maintainer"]


def test_versions(spark):
    """Creates, edits, deletes and retries of messages, in any order of arrival."""
    rows = [
        (1, 3, "edited twice"), (1, 1, "created"), (1, 2, "edited"), (2, 1, "created"), (2, 2, "created"), (3, 1, "created"), (3, 2, None),
        (4, 1, "created"), (4, 2, None), (4, 3, "again"), (5, 1, None), (6, 1, "a"), (6, 1, "a"), (None, 1, "no key"),
    ]
    df = spark.createDataFrame(rows, "id int, v int, body string").withColumn("p", c.F.col("body").isNotNull()).repartition(3)
    assert {(r.id, r.v, r.body) for r in c.fold(df, "id", "v", "p").collect()} == {(1, 3, "edited twice"), (2, 2, "created"), (4, 3, "again"), (5, 1, None), (6, 1, "a")}


def test_edits_and_deletions_decide_discussions(spark):
    def at(*days):
        return [datetime(2026, 2, d) for d in days]

    comments, issues, accounts = tables(spark, [], [(1, "ann", 1), (2, "ann", 1), (3, "ann", 1)])
    first, second = at(1, 2)
    log = [
        (1, 1, "bob", "2026-01-02T00:00:00Z", "an answer", first, None), (1, 1, None, None, None, second, None), (2, 1, "ann", "2026-01-01T00:00:00Z", "why?", first, None),  # the answer is deleted
        (3, 2, "bob", "2026-01-02T00:00:00Z", "<!-- -->", first, None), (3, 2, "bob", "2026-01-02T00:00:00Z", "now with words", second, None),  # edited into a text
        (4, 3, "bob", "2026-01-02T00:00:00Z", "words", first, None), (4, 3, "bob", "2026-01-02T00:00:00Z", "words", second, None),  # a retry
    ]
    comments = spark.createDataFrame(log, COMMENTS)
    assert {r.issue_number: r.reason for r in c.verdicts(c.turns(comments, accounts), c.openers(issues)).collect()} == {1: "unanswered", 2: None, 3: None}
    assert {(r.id, r.body) for r in c.conversations(comments, issues, accounts).collect()} == {(3, "now with words"), (4, "words")}


def test_empty(spark):
    assert reasons(spark, [], []) == {} and c.conversations(*tables(spark, [], [])).count() == 0
