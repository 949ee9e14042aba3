"""Conversations from message rows.

Rows are an event log: deliveries of one message are versions, and the last one is the turn. Turns are judged one by one,
discussions by aggregates of their turns only, so a discussion of any size is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.skew import broadcast_if_small, bucketed_sequence, lookup_join
from tallyforge.session import materialize

_DATE_TIME = r"^\s*(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2})(:\d{2}(?:\.\d{1,9})?)?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$"


def instant(text: Column) -> Column:
    """The instant of an ISO date-time, UTC where no offset is given; null if it is no real date-time."""
    part = [F.regexp_extract(text, _DATE_TIME, i) for i in range(1, 5)]
    offset = F.when(F.upper(part[3]).isin("", "Z"), "+00:00").otherwise(
        F.regexp_replace(F.regexp_replace(part[3], r"^([+-]\d{2})(\d{2})$", "$1:$2"), r"^([+-]\d{2})$", "$1:00")
    )
    seconds = F.when(part[2] == "", ":00").otherwise(part[2])
    whole = F.concat(part[0], F.lit("T"), part[1], seconds, offset)
    return F.when(text.rlike(_DATE_TIME), whole.try_cast("timestamp"))


def says_something(body: Column) -> Column:
    """Whether a text has a letter or digit outside <!-- --> comments; false for null."""
    return F.coalesce(F.regexp_replace(body, r"(?s)<!--.*?-->", "").rlike(r"[\p{L}\p{N}]"), F.lit(False))


def login(name: Column) -> Column:
    """A login for comparison: trimmed, in lower case; null if it names nobody."""
    low = F.lower(F.trim(name))
    return F.when(low != "", low)


def fold(events: DataFrame, key: str, version: str, present: str | None = None) -> DataFrame:
    """The final row of each key from an event log of deliveries, ordered by version and, where versions tie, by content.

    The first delivery creates a row, a later one with other content edits it, one with equal content is a retry. present
    names a boolean column that tells whether a delivery has any content: a last delivery without any, after one that had
    some, deletes the row; what never had content stays. A delivery after a deletion creates the row again.
    """
    rest = [c for c in events.columns if c != key]
    order = F.struct(F.col(version), F.xxhash64(*[F.col(c) for c in rest]))
    folded = events.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*rest), order).alias("_row"), (F.bool_or(present) if present else F.lit(False)).alias("_had")
    )
    if present:
        folded = folded.where(F.col(f"_row.{present}") | ~F.col("_had"))
    return folded.select(key, "_row.*")


def turns(comments: DataFrame, accounts: DataFrame) -> DataFrame:
    """Final turns: id, issue_number, speaker, at, has_text, is_bot. Texts are judged before the shuffle and dropped."""
    events = comments.select(
        "id", "issue_number", login(F.col("user")).alias("speaker"), instant(F.col("created_at")).alias("at"),
        says_something(F.col("body")).alias("has_text"), "fetched_at",
        F.coalesce("user", "created_at", "body").isNotNull().alias("_present"),
    ).where("issue_number is not null and issue_number <> 0")
    kinds = accounts.select(login(F.col("login")).alias("speaker"), (F.lower("role") == "bot").alias("_bot")).where("speaker is not null")
    kinds = kinds.groupBy("speaker").agg(F.bool_or("_bot").alias("_bot"))
    final = fold(events, "id", "fetched_at", "_present").drop("_present")
    return final.join(broadcast_if_small(kinds), "speaker", "left").withColumn("is_bot", F.coalesce("_bot", F.lit(False))).drop("_bot")


def openers(issues: DataFrame) -> DataFrame:
    """One row per issue: issue_number, opened, opener."""
    return fold(
        issues.select(F.col("number").alias("issue_number"), instant(F.col("created_at")).alias("opened"), login(F.col("user")).alias("opener"), "fetched_at"),
        "issue_number", "fetched_at",
    ).drop("fetched_at")


def verdicts(turn: DataFrame, opener: DataFrame) -> DataFrame:
    """Per discussion: issue_number, reason (`broken`, `empty`, `unanswered` or null for one to keep), n_turns, opener.

    Everything needed is an aggregate that is combined before the shuffle, so hot threads cost no more than others.
    """
    by_issue = turn.groupBy("issue_number").agg(
        F.bool_or(F.col("at").isNull()).alias("_undated"),
        F.min("at").alias("_first"),
        F.bool_or("has_text").alias("_text"),
        F.count("*").alias("n_turns"),
        F.max(F.when(F.col("has_text") & ~F.col("is_bot"), F.struct("at", "id", "speaker"))).alias("_last"),
    )
    joined = by_issue.join(opener.withColumn("_known", F.lit(True)), "issue_number", "left")
    reason = (
        F.when(F.col("_known").isNull() | F.col("_undated") | (F.col("_first") < F.col("opened")), "broken")
        .when(~F.col("_text"), "empty")
        .when(F.col("_last").isNull() | (F.col("_last.speaker") == F.col("opener")), "unanswered")
    )
    return joined.select("issue_number", reason.alias("reason"), "n_turns", "opener")


def conversations(comments: DataFrame, issues: DataFrame, accounts: DataFrame) -> DataFrame:
    """The turns of all discussions to keep, in order: issue_number, turn_no, id, at, role, speaker, body.

    role is `bot`, `maintainer`, `author` (who opened the issue) or `contributor`; nobody's turns are a contributor's.
    Turns are numbered per discussion over days, so that a hot discussion is spread.
    """
    turn = materialize(turns(comments, accounts))
    kept = materialize(verdicts(turn, openers(issues)).where("reason is null").select("issue_number", "opener"))
    roles = accounts.select(login(F.col("login")).alias("speaker"), F.lower("role").alias("_role")).groupBy("speaker").agg(F.min("_role").alias("_role"))
    dated = lookup_join(turn.where("has_text"), kept, "issue_number", "inner")
    dated = materialize(dated.join(broadcast_if_small(roles), "speaker", "left").withColumn("_day", F.to_date("at")))
    numbered = bucketed_sequence(dated, "issue_number", "_day", ["at", "id"], "turn_no")
    role = F.coalesce("_role", F.when(F.col("speaker") == F.col("opener"), "author"), F.lit("contributor"))
    of_kept = comments.select("id", "issue_number", "body", "fetched_at").join(broadcast_if_small(kept.select("issue_number")), "issue_number", "left_semi")
    bodies = fold(of_kept.drop("issue_number"), "id", "fetched_at").drop("fetched_at")
    return numbered.join(bodies, "id").select("issue_number", "turn_no", "id", "at", role.alias("role"), "speaker", "body")
