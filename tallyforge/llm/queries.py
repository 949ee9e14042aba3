"""The queries of the numbered text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bitext, conversations, languages, leaks, mixing, pii
from tallyforge.plans.registry import Registry
from tallyforge.session import materialize, spread
from tallyforge.sources import load

R = Registry()


def registries() -> list[Registry]:
    """All registries of this subpackage."""
    return [R]


_P5_SQL = r"""
with a as (select lower(trim(login)) login, bool_or(lower(role) = 'bot') bot from accounts group by all),
c as (
    select distinct id, issue_number, nullif(lower(trim("user")), '') speaker, try_cast(created_at as timestamptz) ts,
        regexp_matches(regexp_replace(coalesce(body, ''), '(?s)<!--.*?-->', '', 'g'), '[\p{L}\p{N}]') txt
    from comments where issue_number is not null and issue_number <> 0 and id is not null),
i as (select distinct number, try_cast(created_at as timestamptz) opened, nullif(lower(trim("user")), '') opener from issues where number is not null),
g as (
    select issue_number, bool_or(ts is null) undated, min(ts) first_at, bool_or(txt) has_text,
        max(case when txt and not coalesce(a.bot, false) then {'ts': ts, 'id': id, 'speaker': speaker} end) last_turn
    from c left join a on a.login = c.speaker group by 1),
r as (
    select issue_number, case when i.number is null or undated or first_at < opened then 'broken' when not has_text then 'empty'
        when last_turn is null or last_turn.speaker = opener then 'unanswered' end reason
    from g left join i on i.number = g.issue_number)
select issue_number, reason from r where reason is not null"""


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, folder, "comments"), load(spark, folder, "issues"), load(spark, folder, "accounts")


@R.add(_P5_SQL)
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Discussions to be dropped, with the reason."""
    comments, issues, accounts = _tables(spark, folder)
    judged = conversations.verdicts(conversations.turns(comments, accounts), conversations.openers(issues))
    return judged.where("reason is not null").select("issue_number", "reason")


@R.add()
def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered turns of all discussions to keep."""
    return conversations.conversations(*_tables(spark, folder))



@R.add()
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaks.leaks(spread(load(spark, folder, "documents").select("doc_id", "text")), load(spark, folder, "eval_items").select("item_id", "text"))


@R.add()
def p6_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item the number of documents that hold a passage of it."""
    return p6_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def _mixed(spark: SparkSession, folder: str, full: bool) -> tuple[DataFrame, DataFrame]:
    docs = mixing.counted(spread(load(spark, folder, "documents").select("doc_id", "source", "text")))
    total = docs.groupBy().sum("n_tokens").first()[0] or 0
    return mixing.mixture(docs, load(spark, folder, "mix_targets"), total if full else None)


@R.add()
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents and their copies, for a total of as many tokens as all documents have."""
    return _mixed(spark, folder, True)[0]


@R.add()
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares of p7_mixture; caps on repeats show here."""
    return _mixed(spark, folder, True)[1]


@R.add()
def p7_shares_within_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted and reached shares at the largest total at which no cap on repeats bites."""
    return _mixed(spark, folder, False)[1]


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(load(spark, folder, "documents").select("doc_id", "text", "lang"))
    return languages.segments(documents, languages.train(documents))


@R.add()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of documents that are mixed, unlabelled or wrongly labelled."""
    wrong = F.coalesce(languages.known_label(F.col("label")) != F.col("lang"), F.lit(True))
    known = _segments(spark, folder).where("seg_no is not null")
    return known.where((F.col("n_segs") > 1) | wrong).select("doc_id", "seg_no", "lang").distinct()


@R.add()
def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of every document with its language and confidence."""
    return _segments(spark, folder)


def _sentence_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "corrections").where("correction_id is not null")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.en").alias("en"), F.col(f"{f}.ru").alias("ru")) for f in ("observation", "correction")])
    texts = rows.select("correction_id", F.inline(fields)).where("en <> '' and ru <> ''").distinct()
    tokens = bitext.tokenized(texts, ["correction_id", "field"])
    return bitext.alignment(tokens, ["correction_id", "field"], bitext.learn(tokens))


@R.add()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sentences of a correction that say the same, wholly or in part."""
    return _sentence_pairs(spark, folder).select("correction_id", "field", "en_pos", "ru_pos").distinct()


@R.add()
def p2_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """The same pairs with the coverage of the better covered sentence."""
    return _sentence_pairs(spark, folder).groupBy("correction_id", "field", "en_pos", "ru_pos").agg(F.max("coverage").alias("coverage"))


def _bodies(spark: SparkSession, folder: str) -> DataFrame:
    issues = load(spark, folder, "issues").select(F.lit("issues").alias("src"), F.col("number").alias("row_id"), "body", "fetched_at")
    comments = load(spark, folder, "comments").select(F.lit("comments").alias("src"), F.col("id").alias("row_id"), "body", "fetched_at")
    return issues.unionByName(comments).where("row_id is not null")


@R.add()
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every personal detail in issue and comment texts."""
    return pii.details(_bodies(spark, folder).drop("fetched_at"), ["src", "row_id"]).select("src", "row_id", "kind", "value").distinct()


@R.add()
def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The last delivery of every issue and comment text with placeholders for personal details."""
    last = _bodies(spark, folder).groupBy("src", "row_id").agg(F.max_by("body", F.struct("fetched_at", F.xxhash64("body"))).alias("body"))
    return pii.redact(last, ["src", "row_id"])
