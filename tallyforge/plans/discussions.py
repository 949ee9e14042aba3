"""Mining of issues and comments: types, labels, blockers, resolutions, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.strict_json import json_fault
from tallyforge.operators import resolve, rules, skew, stats
from tallyforge.operators.timeline import latest
from tallyforge.plans.registry import Registry
from tallyforge.session import materialize, spread
from tallyforge.sources import load

R = Registry()

_ISSUES = "(select distinct on (number) * from issues where number is not null order by number, fetched_at desc)"
_COMMENTS = "(select distinct on (id) * from comments where id is not null order by id, fetched_at desc)"
_CASE = """case when starts_with(title, '[Plugin]') then 'submission' when starts_with(title, '[Verify]') then 'verification'
  when contains(labels, '"bug"') or contains(labels, '"defect"') then 'bug' when contains(labels, '"discussion"') then 'discussion' else 'other' end"""


def _issues(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(load(spark, folder, "issues").select("number", *columns, "fetched_at"), "number", ["fetched_at"]).drop("fetched_at")


def _comments(spark: SparkSession, folder: str, *columns: Column | str) -> DataFrame:
    return latest(load(spark, folder, "comments").select("id", *columns, "fetched_at"), "id", ["fetched_at"]).drop("fetched_at")


def _kind() -> Column:
    return (
        F.when(F.col("title").startswith("[Plugin]"), "submission").when(F.col("title").startswith("[Verify]"), "verification")
        .when(F.col("labels").contains('"bug"') | F.col("labels").contains('"defect"'), "bug").when(F.col("labels").contains('"discussion"'), "discussion").otherwise("other")
    )


@R.add(f"select kind, n, n / sum(n) over () share from (select {_CASE} kind, count(*) n from {_ISSUES} group by 1)")
def issue_types(spark: SparkSession, folder: str) -> DataFrame:
    """Issues by type and their part of all."""
    return stats.share_of_total(_issues(spark, folder, "title", "labels").select(_kind().alias("kind")), ["kind"])


@R.add(f"""
select label, count(*) n from (select unnest(from_json(case when json_valid(labels) then labels end, '["varchar"]')) label from {_ISSUES}) where label is not null
group by 1 order by n desc, label limit 15""")
def top_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The 15 most frequent labels; ties by name."""
    labels = _issues(spark, folder, "labels").select(F.explode(F.from_json("labels", "array<string>")).alias("label"))
    return stats.top_values(labels, "label", 15)


_RULE = r"(MKT-[A-Z]+-[0-9]+|OBS-[A-Z]+-[0-9]+)"


@R.add(f"""
with m as (select c.issue_number, unnest(regexp_extract_all(c.body, '{_RULE}')) as rule from {_COMMENTS} c
  where not exists (select 1 from accounts a where a.role = 'bot' and lower(a.login) = lower(c."user")))
select rule, count(*) n_instances, count(distinct issue_number) n_entities from m group by 1""")
def rule_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """How often people name a rule, and in how many issues; bots are left out."""
    bots = load(spark, folder, "accounts").where("role = 'bot'").select(F.lower("login").alias("who"))
    said = _comments(spark, folder, "issue_number", F.lower("user").alias("who"), F.regexp_extract_all("body", F.lit(_RULE), F.lit(1)).alias("rules"))
    people = said.join(skew.broadcast_if_small(bots), "who", "left_anti")
    return stats.instances_and_entities(people.select("issue_number", F.explode("rules").alias("rule")), ["rule"], "issue_number")


@R.add(f"""
select m.login, count(*) n_instances, count(distinct c.issue_number) n_entities from {_COMMENTS} c
join (select lower(login) login from accounts where role = 'maintainer') m on m.login = lower(c."user") where regexp_matches(c.body, '(?i)cannot approve|blocker|has to go|not allowed|please remove') group by 1""")
def blockers_by_reviewer(spark: SparkSession, folder: str) -> DataFrame:
    """Blocking remarks of maintainers and the issues they stand in."""
    staff = load(spark, folder, "accounts").where("role = 'maintainer'").select(F.lower("login").alias("login"))
    said = _comments(spark, folder, "issue_number", F.lower("user").alias("login"), F.col("body").rlike("(?i)cannot approve|blocker|has to go|not allowed|please remove").alias("b"))
    return stats.instances_and_entities(said.where("b").join(skew.broadcast_if_small(staff), "login"), ["login"], "issue_number")


@R.add(f"""
with q as (select id, issue_number, trim(regexp_extract(body, '(?m)^> (.+)$', 1)) s from {_COMMENTS}),
s as (select distinct id, issue_number, trim(unnest(string_split(body, chr(10)))) s from {_COMMENTS} where body not like '>%'),
f as (select issue_number, s, min(id) origin from s where s <> '' and issue_number is not null group by 1, 2 having count(distinct id) = 1)
select q.id, f.origin from q left join f using (issue_number, s) where q.s <> '' and q.issue_number is not null""")
def quoted_comments(spark: SparkSession, folder: str) -> DataFrame:
    """The one comment of the same issue that a quoted line comes from; null if there is none or several."""
    c = _comments(spark, folder, "issue_number", "body").where("issue_number is not null")
    quotes = c.select("id", "issue_number", F.trim(F.regexp_extract("body", r"(?m)^> (.+)$", 1)).alias("s")).where("s <> ''")
    told = c.where("body not like '>%'").select(F.col("id").alias("origin"), "issue_number", F.explode(F.split("body", "\n")).alias("s"))
    told = told.select("origin", "issue_number", F.trim("s").alias("s")).where("s <> ''")
    return resolve.unique_match(quotes, told, ["issue_number", "s"], "origin").select("id", "origin")


_FIX = "(?i)fixed in|removed|replaced|added the missing|pushed a new"
_ASK = "(?i)cannot approve|has to go|please remove|not allowed|needs a license"


@R.add(f"""
with c as (select id, issue_number g, try_cast(created_at as timestamptz) ts, lower("user") u, coalesce(regexp_matches(body, '{_ASK}'), false) ask, coalesce(regexp_matches(body, '{_FIX}'), false) fix
  from {_COMMENTS} where issue_number > 0),
i as (select number g, lower("user") opener from {_ISSUES}),
e as (select c.*, coalesce(fix and u = opener, false) answers from c join i using (g) where ts is not null)
select g as issue_number, id, epoch_us(min(case when answers then ts end) over (partition by g order by ts, id rows between 1 following and unbounded following)) answer_us from e qualify ask""")
def first_fix_after_blocker(spark: SparkSession, folder: str) -> DataFrame:
    """For each blocking remark the time of the opener's first later comment that tells a fix."""
    ts = F.col("created_at").try_cast("timestamp").alias("ts")
    c = _comments(spark, folder, "issue_number", ts, F.lower("user").alias("u"), F.coalesce(F.col("body").rlike(_ASK), F.lit(False)).alias("ask"), F.coalesce(F.col("body").rlike(_FIX), F.lit(False)).alias("fix"))
    i = _issues(spark, folder, F.lower("user").alias("opener")).withColumnRenamed("number", "issue_number")
    e = materialize(skew.lookup_join(materialize(c.where("issue_number > 0 and ts is not null")), i, "issue_number", "inner"))
    answers = F.coalesce(F.col("fix") & (F.col("u") == F.col("opener")), F.lit(False))
    found = resolve.first_after(e, "issue_number", "ts", "id", F.col("ask"), answers, F.to_date("ts"))
    return found.select("issue_number", "id", F.unix_micros("answer_ts").alias("answer_us"))


_MARKER = "marketplace-security-baseline:v4"


@R.add(f"""
with b as (select id, try(decode(from_base64(translate(list_last(regexp_extract_all(body, '<!-- {_MARKER} ([A-Za-z0-9+/_=-]+) -->', 1)), '-_', '+/')))) j from {_COMMENTS} where contains(body, '<!-- {_MARKER} '))
select capability, count(*) n from (select unnest(from_json(json_extract(j, '$.capabilities'), '["varchar"]')) capability from b where json_valid(j)) group by 1""")
def payload_capabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Capabilities told in the base64 payloads of bot comments."""
    c = _comments(spark, folder, T.payload(F.col("body"), _MARKER).alias("j")).where("try_parse_json(j) is not null")
    told = c.select(F.explode(F.from_json("j", "capabilities array<string>")["capabilities"]).alias("capability"))
    return told.groupBy("capability").agg(F.count("*").alias("n"))


@R.add(f"""
with s as (select number, trim(regexp_extract(body, '(?s)(?:^|\\n)### Repository URL[ \\t]*\\r?\\n(.*?)(?:\\n### |$)', 1), ' ' || chr(10) || chr(13) || chr(9)) url,
  trim(regexp_extract(body, '(?s)(?:^|\\n)### Plugin ID[ \\t]*\\r?\\n(.*?)(?:\\n### |$)', 1), ' ' || chr(10) || chr(13) || chr(9)) pid from {_ISSUES})
select number, lower(regexp_extract(url, '^https?://[^/]+/([^/\\s]+)/', 1) || '/' || regexp_extract(url, '^https?://[^/]+/[^/\\s]+/([^/\\s#?]+?)(?:\\.git)?/?(?:[#?].*)?$', 1)) slug, pid plugin_id
from s where regexp_matches(url, '^https?://[^/]+/([^/\\s]+)/([^/\\s#?]+?)(?:\\.git)?/?(?:[#?].*)?$')""")
def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Repository and plugin id from the sections of submission forms."""
    i = _issues(spark, folder, "body")
    return i.select("number", T.repository_slug(T.section(F.col("body"), "Repository URL")).alias("slug"), T.section(F.col("body"), "Plugin ID").alias("plugin_id")).where("slug is not null")


@R.add(f"""
with s as (select c.issue_number, c.id, row_number() over (partition by c.issue_number order by c.id) r, count(*) over (partition by c.issue_number) n from {_COMMENTS} c where issue_number > 0)
select i.number, coalesce(max(s.n), 0) n_comments, coalesce(string_agg(case when r <= 3 then cast(s.id as varchar) end, ' ' order by s.id), '') first_ids
from {_ISSUES} i left join s on s.issue_number = i.number group by 1""")
def issues_with_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Every issue with the number of its comments and the first three, by aggregates of bounded size."""
    ids = _comments(spark, folder, "issue_number").where("issue_number > 0")
    counts = ids.groupBy("issue_number").agg(F.count("*").alias("n_comments"))
    firsts = _first_ids(ids, 3)
    i = _issues(spark, folder).withColumnRenamed("number", "issue_number")
    joined = i.join(counts, "issue_number", "left").join(firsts, "issue_number", "left")
    return joined.select(F.col("issue_number").alias("number"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"), F.coalesce("first_ids", F.lit("")).alias("first_ids"))


def _first_ids(ids: DataFrame, k: int) -> DataFrame:
    """The k least ids of each issue as text."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), " ")
    return skew.first_rows(ids, "issue_number", ["id"], k).groupBy("issue_number").agg(text.alias("first_ids"))


_CHUNK = 500


@R.add(f"""
with n as (select number, row_number() over (order by number) - 1 r from {_ISSUES})
select r // {_CHUNK} as chunk, count(*) n_issues, min(number) first_number, max(number) last_number from n group by 1""")
def issue_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 500 issues in order of number: size, first and last."""
    i = _issues(spark, folder).withColumn("_all", F.lit(0)).withColumn("_b", F.floor(F.col("number") / 10_000))
    numbered = skew.bucketed_sequence(i, "_all", "_b", ["number"], "_r")
    return numbered.groupBy(F.floor(F.col("_r") / _CHUNK).alias("chunk")).agg(F.count("*").alias("n_issues"), F.min("number").alias("first_number"), F.max("number").alias("last_number"))


_RULES_SQL = " union all ".join(f"select '{r.name}' as rule, id, line, snippet from l where {r.sql('snippet_raw').replace('regexp_matches(snippet_raw, ' + chr(39) + r.given, 'regexp_matches(body, ' + chr(39) + r.given) if r.given else r.sql('snippet_raw')}" for r in rules.RULES)
_LINES = f"""
p as (select id, body, string_split_regex(body, '\\r?\\n') ls from {_COMMENTS} where body is not null),
l as (select id, body, line, ls[line] snippet_raw, trim(ls[line]) snippet from (select id, body, ls, unnest(range(1, len(ls) + 1)) line from p))"""


@R.add(f"with {_LINES} select * from ({_RULES_SQL})")
def script_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of comments that break a rule for scripts."""
    return rules.findings(_comments(spark, folder, "body"), "id", "body").select("rule", "id", "line", "snippet")


@R.add(f"""
with {_LINES}, f as (select distinct rule, id, line from ({_RULES_SQL})), r as (select *, row_number() over (partition by rule order by id, line) k, count(*) over (partition by rule) n from f)
select rule, max(n) n, string_agg(id || ':' || line, ' ' order by id, line) evidence from r where k <= 8 group by 1""")
def findings_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Findings per rule with the first eight places."""
    return rules.with_evidence(rules.findings(_comments(spark, folder, "body"), "id", "body"), "id")


@R.add()
def strict_json_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records of issues and comments that strict reading rejects, by fault."""
    raw = load(spark, folder, "issues").select(F.lit("issues").alias("src"), "raw_json").unionByName(load(spark, folder, "comments").select(F.lit("comments").alias("src"), "raw_json"))
    return spread(raw).select("src", json_fault(F.col("raw_json")).alias("fault")).where("fault is not null").groupBy("src", "fault").agg(F.count("*").alias("n"))


_FENCE = r"(?s)(?:^|\n)```([A-Za-z0-9+#-]*)[^\n]*\n(.*?)\n```"


@R.add(f"""
with b as (select body from {_COMMENTS}), l as (select unnest(regexp_extract_all(body, '{_FENCE}', 1)) "language" from b), c as (select unnest(regexp_extract_all(body, '{_FENCE}', 2)) code from b)
select "language", count(*) n, (select cast(sum(len(code)) as bigint) from c) total_chars from l group by 1""")
def code_block_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Fenced code blocks of comments by language, with the characters of all of them."""
    blocks = _comments(spark, folder, T.code_blocks(F.col("body")).alias("blocks")).select(F.inline("blocks"))
    counts = blocks.groupBy("language").agg(F.count("*").alias("n"), F.sum(F.length("code")).alias("_chars"))
    return counts.join(F.broadcast(counts.agg(F.sum("_chars").alias("total_chars")))).drop("_chars")
