"""Mining of discussions: quotes and their origins, categories of blockers, one extraction record per issue, findings in evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import resolve, rules, similarity, skew, stats
from tallyforge.operators.timeline import latest
from tallyforge.plans.discussions import _COMMENTS, _ISSUES, _comments, _issues
from tallyforge.plans.registry import Registry
from tallyforge.session import materialize
from tallyforge.sources import load

R = Registry()

# quotes: lines that start with `> `; lines of the one who quotes can be quoted in turn
_QUOTES = f"select distinct id, issue_number, trim(unnest(regexp_extract_all(body, '(?m)^> (.+)$', 1))) s from {_COMMENTS} where issue_number is not null"
_TOLD = f"select id, issue_number, trim(l) s from (select id, issue_number, unnest(string_split(body, chr(10))) l from {_COMMENTS} where issue_number is not null) where l not like '>%' and trim(l) <> ''"


def _said(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(id, issue_number, s) of every quoted line, and of every line that is no quote."""
    c = _comments(spark, folder, "issue_number", "body").where("issue_number is not null")
    quoted = c.select("id", "issue_number", F.explode(F.regexp_extract_all("body", F.lit(r"(?m)^> (.+)$"), F.lit(1))).alias("s"))
    told = c.select("id", "issue_number", F.explode(F.split("body", "\n")).alias("s")).where("s not like '>%'")
    return tuple(x.withColumn("s", F.trim("s")).where("s <> ''") for x in (quoted.distinct(), told))


@R.add(f"""
with q as ({_QUOTES}), t as (select issue_number, s, min(id) origin from (select distinct id, issue_number, s from ({_TOLD})) group by 1, 2 having count(*) = 1)
select q.id, q.s, t.origin from q left join t using (issue_number, s) where q.s <> ''""")
def quoted_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every quoted line with the one comment of its issue that has the same line; null if there is none or several."""
    quoted, told = _said(spark, folder)
    return resolve.unique_match(quoted, told.withColumnRenamed("id", "origin"), ["issue_number", "s"], "origin").select("id", "s", "origin")


_SENTENCES = f"select id, issue_number, trim(unnest(string_split_regex(s, '[.!?] '))) s from ({_TOLD})"


@R.add(f"""
with q as ({_QUOTES}), needles as (select id, issue_number, s, substr(lower(s), 1, 35) needle from q where len(s) >= 25),
t as (select issue_number, needle, min(id) origin, count(distinct id) n from (select id, issue_number, substr(lower(s), 1, 35) needle from ({_SENTENCES})) group by 1, 2)
select needles.id, needles.s, case when t.n = 1 then origin end origin, coalesce(t.n, 0) n_found from needles left join t using (issue_number, needle)""")
def quotes_by_needle(spark: SparkSession, folder: str) -> DataFrame:
    """Long quotes with the one comment of their issue that has a sentence with the same first 35 characters, and how many comments have one.

    Sentences are folded to one row an issue and needle before the join, so hot issues and phrases cost one row.
    """
    quoted, told = _said(spark, folder)
    needle = F.substring(F.lower("s"), 1, 35)
    sentence = told.select("id", "issue_number", F.explode(F.split("s", "[.!?] ")).alias("s")).withColumn("s", F.trim("s"))
    folded = sentence.groupBy("issue_number", needle.alias("needle")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("origin"))
    joined = quoted.where(F.length("s") >= 25).withColumn("needle", needle).join(folded, ["issue_number", "needle"], "left")
    return joined.select("id", "s", F.when(F.col("n") == 1, F.col("origin")).alias("origin"), F.coalesce("n", F.lit(0)).alias("n_found"))


_WORDS = "list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: len(w) >= 4))"


@R.add(f"""
with q as (select issue_number, s, {_WORDS.format('s')} w from (select distinct issue_number, s from ({_QUOTES})) where s <> ''),
c as (select issue_number, id, {_WORDS.format("string_agg(s, ' ')")} w from ({_TOLD}) group by 1, 2),
o as (select q.issue_number, q.s, c.id, len(list_intersect(q.w, c.w)) score from q join c using (issue_number) where len(list_intersect(q.w, c.w)) >= 5),
b as (select issue_number, s, max(score) score from o group by 1, 2)
select o.issue_number, o.s, min(o.id) origin, score from o join b using (issue_number, s, score) group by 1, 2, 4 having count(*) = 1""")
def quotes_by_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes with the comment of their issue that shares most significant words, at least five; ties are rejected.

    Quotes are one row an issue and text. Of each only the words that are rare in the issue look for comments: one that
    shares five words with it has at least one of all but the four most frequent.
    """
    quoted, told = _said(spark, folder)
    asked = quoted.select("issue_number", "s").distinct().withColumn("w", resolve.significant_words(F.col("s")))
    heard = told.select("id", "issue_number", F.explode(resolve.significant_words(F.col("s"))).alias("word")).distinct()
    return resolve.best_overlap(materialize(asked), materialize(heard), "issue_number", ["s"], "id", 5).select("issue_number", "s", F.col("id").alias("origin"), "score")


# The categories of blockers and what tells them.
_AGENT = r"\b(?:AGENTS\.md|agent\.md|CLAUDE\.md|\.cursorrules)\b"
_AGENT_ACT = r"\b(?:remove|exclude|rename|cannot approve|shipped inside|distributable|plugin tree{})\b"
CATEGORIES = [
    ("agent_steering_files", rf"(?s){_AGENT}.*{_AGENT_ACT.format('|contains executable agent directives|instruction-injection|auto-load|auto-ingest|untrusted instructions')}|{_AGENT_ACT.format('')}.*{_AGENT}"),
    ("network_and_untrusted_fetch", r"curl\s+.*\|\s*(?:bash|sh)|external host|untrusted network|download.*runtime|remote fetch"),
    ("prebuilt_binaries", r"prebuilt|precompiled|ELF\b|executable binary|committed binary|binary asset"),
    ("undeclared_dependencies", r"base-devel|cmake|compiler|build tool|make|gcc|cargo|pkgconf|hidapi|libpulse|undeclared dependenc"),
    ("sudo_and_privileges", r"sudo\s+-S|sudoers|NOPASSWD|credential harvesting|root privilege|unauthorized root"),
    ("qml_markup_and_quality", r"textFormat|PlainText|rich text|AutoText|markup injection"),
    ("process_lifecycle", r"watchdog|timeout|zombie|stuck process|process lifecycle|unresponsive process"),
    ("symlinks_and_packaging", r"symlink|symbolic link"),
    ("shared_temp_state", r"/(?:tmp|dev/shm)/|temporary directory|XDG_RUNTIME_DIR"),
    ("licensing_and_assets", r"license|copyright|attribution|third-party asset|preview asset"),
    ("wayland_focus", r"keyboardFocus|exclusive focus|layer-shell|wlr"),
]
_TYPES = """case when starts_with(title, '[Plugin]:') or contains(body, '### Repository URL') then 'submission' when starts_with(title, '[Verify]:') or contains(body, '### Verification action') then 'verification_update'
  when contains(labels, '"bug"') or contains(labels, '"defect"') then 'bug_report' when contains(labels, '"discussion"') or contains(labels, '"question"') then 'discussion' else 'other' end"""
_CATEGORY_SQL = "list_filter([" + ", ".join(f"case when regexp_matches(body, '(?i){p}') then '{c}' end" for c, p in CATEGORIES) + "], lambda x: x is not null)"
_BLOCKERS = f"""
select c.id, c.issue_number, lower(c."user") reviewer, unnest({_CATEGORY_SQL.replace('body', 'c.body')}) category from {_COMMENTS} c left join (select lower(login) login, min(role) "role" from accounts group by 1) a on a.login = lower(c."user")
where c.issue_number > 0 and trim(c.body) <> '' and coalesce(a."role", '') <> 'bot' and (a."role" = 'maintainer' or contains(lower(c.body), 'security review') or contains(lower(c.body), 'blocked'))"""


def _categories(body: Column) -> Column:
    return F.filter(F.array(*[F.when(body.rlike(f"(?i){p}"), F.lit(c)) for c, p in CATEGORIES]), lambda x: x.isNotNull())


def _blockers(spark: SparkSession, folder: str) -> DataFrame:
    """id, issue_number, reviewer, category: what maintainers, or comments on a security review or block, object to; one row a category."""
    roles = load(spark, folder, "accounts").groupBy(F.lower("login").alias("reviewer")).agg(F.min("role").alias("role"))
    c = _comments(spark, folder, "issue_number", F.lower("user").alias("reviewer"), "body").where("issue_number > 0 and trim(body) <> ''")
    speaks = (F.col("role") == "maintainer") | F.lower("body").contains("security review") | F.lower("body").contains("blocked")
    told = c.join(skew.broadcast_if_small(roles), "reviewer", "left").where((F.coalesce("role", F.lit("")) != "bot") & speaks)
    return told.select("id", "issue_number", "reviewer", F.explode(_categories(F.col("body"))).alias("category"))


@R.add(f"""
with b as ({_BLOCKERS}), n as (select category, count(*) n_instances, count(distinct issue_number) n_entities from b group by 1)
select row_number() over (order by n_instances desc, category) place, category, n_instances, n_entities from n""")
def blocker_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Categories of blockers with their instances and distinct issues, the most frequent first."""
    counts = stats.instances_and_entities(_blockers(spark, folder), ["category"], "issue_number")
    return stats.ranked(counts, [F.desc("n_instances"), F.col("category")], "place").select("place", "category", "n_instances", "n_entities")


@R.add(f"""
with b as (select issue_number, category, min(id) id from ({_BLOCKERS}) group by 1, 2), l as (select issue_number, count(*) n_categories, string_agg(category, ' ' order by category) categories, min(id) first_id from b group by 1),
e as (select issue_number, sum(len(list_filter(string_split(body, chr(10)), lambda x: starts_with(trim(x), '❌')))) n_errors from {_COMMENTS} where contains(body, '<!-- marketplace-validation -->') group by 1)
select number, {_TYPES} kind, nullif(regexp_extract(body, '### Plugin ID\\s*\\n+([a-z0-9._-]+)', 1), '') plugin_id,
  case when contains(labels, '"listed"') or contains(labels, 'approved-and-verified') then 'approved_published' when state = 'closed' then 'needs_fixes_stalled' when state = 'open' then 'in_review' else 'not_applicable' end outcome,
  coalesce(n_categories, 0) n_categories, coalesce(categories, '') categories, first_id first_blocker, cast(coalesce(n_errors, 0) as bigint) n_errors, substr(title, 1, 90) title
from {_ISSUES} i left join l on l.issue_number = number left join e on e.issue_number = number""")
def issue_extracts(spark: SparkSession, folder: str) -> DataFrame:
    """One record per issue: its kind, plugin, outcome, categories of blockers, first blocker, error lines of the validation and its title cut to 90 characters.

    Categories are a fixed few; everything from comments is an aggregate, so a hot issue is never gathered.
    """
    b = _blockers(spark, folder).groupBy("issue_number", "category").agg(F.min("id").alias("id"))
    blocked = b.groupBy("issue_number").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("category")), " ").alias("categories"), F.min("id").alias("first_blocker"))
    errors = _comments(spark, folder, "issue_number", "body").where(F.col("body").contains("<!-- marketplace-validation -->"))
    errors = errors.groupBy("issue_number").agg(F.sum(F.size(T.marked_lines(F.col("body"), "❌"))).alias("n_errors"))
    has = F.col("labels").contains
    kind = (
        F.when(F.col("title").startswith("[Plugin]:") | F.col("body").contains("### Repository URL"), "submission")
        .when(F.col("title").startswith("[Verify]:") | F.col("body").contains("### Verification action"), "verification_update")
        .when(has('"bug"') | has('"defect"'), "bug_report").when(has('"discussion"') | has('"question"'), "discussion").otherwise("other")
    )
    outcome = F.when(has('"listed"') | has("approved-and-verified"), "approved_published").when(F.col("state") == "closed", "needs_fixes_stalled").when(F.col("state") == "open", "in_review").otherwise("not_applicable")
    i = _issues(spark, folder, "title", "body", "labels", "state").select(
        F.col("number").alias("issue_number"), kind.alias("kind"), outcome.alias("outcome"), F.substring("title", 1, 90).alias("title"),
        F.nullif(F.regexp_extract("body", r"### Plugin ID\s*\n+([a-z0-9._-]+)", 1), F.lit("")).alias("plugin_id"),
    )
    joined = i.join(blocked, "issue_number", "left").join(errors, "issue_number", "left")
    return joined.select(
        F.col("issue_number").alias("number"), "kind", "plugin_id", "outcome", F.coalesce("n", F.lit(0)).alias("n_categories"), F.coalesce("categories", F.lit("")).alias("categories"),
        "first_blocker", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), "title",
    )


@R.add(f"""
select (select count(*) from {_ISSUES}) n_issues, (select count(*) from {_COMMENTS}) n_comments, (select count(distinct issue_number) from {_COMMENTS}) n_discussed, (select count(distinct issue_number) from ({_BLOCKERS})) n_blocked""")
def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Issues, comments, distinct issues with comments, and distinct issues with blockers."""
    issues = load(spark, folder, "issues").select("number").where("number is not null").distinct().agg(F.count("*").alias("n_issues"))
    comments = latest(load(spark, folder, "comments").select("id", "issue_number", "fetched_at"), "id", ["fetched_at"]).agg(F.count("*").alias("n_comments"), F.count_distinct("issue_number").alias("n_discussed"))
    blocked = _blockers(spark, folder).agg(F.count_distinct("issue_number").alias("n_blocked"))
    return issues.join(F.broadcast(comments)).join(F.broadcast(blocked))


@R.add(f"select number, substr(title, 1, 2500) title, substr(body, 1, 2500) body, len(body) > 2500 cut from {_ISSUES} where body is not null")
def issue_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Issues with their texts cut to 2,500 characters, as far as a reader of prompts gets, and whether something was cut."""
    i = _issues(spark, folder, "title", "body").where("body is not null")
    return i.select("number", F.substring("title", 1, 2500).alias("title"), F.substring("body", 1, 2500).alias("body"), (F.length("body") > 2500).alias("cut"))


@R.add("""
select distinct number, created_at from issues where created_at >= '2026-02-01' and created_at < '2026-03-01'""")
def issues_in_range(spark: SparkSession, folder: str) -> DataFrame:
    """Issues opened in a range of days: a filter on a column that reaches the scan."""
    return load(spark, folder, "issues").select("number", "created_at").where("created_at >= '2026-02-01' and created_at < '2026-03-01'").distinct()


@R.add(f"""
with s as (select c.issue_number, c.id, row_number() over (partition by c.issue_number order by c.id) - 1 place from {_COMMENTS} c where issue_number > 0)
select i.number, s.id as comment_id, s.place from {_ISSUES} i left join s on s.issue_number = i.number""")
def issues_with_all_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Every issue with every comment and its place; issues without comments have one row without. Nested, it would be one row an issue of any size."""
    ids = _comments(spark, folder, "issue_number").where("issue_number > 0").withColumn("b", F.floor(F.col("id") / 10_000))
    placed = materialize(skew.bucketed_sequence(ids, "issue_number", "b", ["id"], "place").select("issue_number", F.col("id").alias("comment_id"), "place"))
    i = _issues(spark, folder).withColumnRenamed("number", "issue_number")
    found = skew.lookup_join(placed, i, "issue_number", "inner")
    lone = i.join(placed.select("issue_number").distinct(), "issue_number", "left_anti")
    return found.unionByName(lone, allowMissingColumns=True).withColumnRenamed("issue_number", "number")


_EVIDENCE = "(select distinct evidence_id, file, line, snippet from evidence where evidence_id is not null)"
_SNIPPET_SQL = " union all ".join([f"select '{r.name}' as rule, file, line, evidence_id from {_EVIDENCE} where {r.sql('snippet')}" for r in rules.RULES] + [f"select '{r.name}' as rule, file, line, evidence_id from {_EVIDENCE} where {r.sql('file')}" for r in rules.FILE_RULES])


@R.add(_SNIPPET_SQL)
def evidence_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence whose snippet or file name breaks a rule."""
    e = load(spark, folder, "evidence").where("evidence_id is not null").select("evidence_id", "file", "line", "snippet").distinct()
    hits = F.concat(rules.broken(F.col("snippet"), rules.RULES), rules.broken(F.col("file"), rules.FILE_RULES))
    return e.select(F.explode(hits).alias("rule"), "file", "line", "evidence_id")


@R.add(f"""
with f as (select distinct rule, file, line from ({_SNIPPET_SQL}) where file is not null and line is not null), r as (select *, row_number() over (partition by rule order by file, line) k, count(*) over (partition by rule) n from f)
select rule, max(n) n, string_agg(file || ':' || line, ' ' order by file, line) places from r where k <= 5 group by 1""")
def capability_places(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and capabilities found in evidence with the number of distinct places and the first five."""
    f = evidence_findings(spark, folder).where("file is not null and line is not null").select("rule", F.col("file").alias("path"), "line")
    return rules.with_evidence(f, "path", 5).withColumnRenamed("evidence", "places")


@R.add(f"""
with p as (select number, title, nullif(regexp_extract(body, '### Repository URL\\s*\\n+(\\S+)', 1), '') url, labels from {_ISSUES})
select number, regexp_replace(title, '([\\\\`*_{{}}\\[\\]<>|])', '\\\\\\1', 'g') escaped,
  case when regexp_matches(title, '[.!?]$') then trim(regexp_replace(title, '\\s+', ' ', 'g')) else trim(regexp_replace(title, '\\s+', ' ', 'g')) || '.' end sentence,
  array_to_string(list_filter(list_transform(range(1, len(ts) + 1), lambda i: case when i <= 3 then ts[i] end), lambda x: x is not null), ' ') tags
from (select *, list_filter(list_transform(from_json(case when json_valid(labels) then labels end, '["varchar"]'), lambda x: case when x = 'submission' then 'new' when x = 'listed' then null else x end), lambda x: x is not null) ts from p) where title is not null""")
def title_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Titles escaped for Markdown and as a sentence, and the first three tags of each issue with renamed and dropped ones."""
    i = _issues(spark, folder, "title", "labels").where("title is not null")
    tags = T.tags(F.from_json("labels", "array<string>"), {"submission": "new", "listed": None})
    return i.select("number", T.markdown_escape(F.col("title")).alias("escaped"), T.sentence(F.col("title")).alias("sentence"), F.array_join(tags, " ").alias("tags"))


@R.add("""
select cluster, p_partkey, row_number() over (partition by cluster order by p_size desc, p_partkey) - 1 place
from (select p_partkey, p_size, case when contains(lower(p_type), 'brass') then 'brass' when contains(lower(p_type), 'steel') then 'steel' else 'other' end cluster from part)""")
def place_in_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every part within its cluster, the largest first. Clusters are numbered size by size, so a hot one is spread."""
    p = load(spark, folder, "part").select("p_partkey", "p_size", "p_type")
    kind = similarity.best_cluster(F.col("p_type"), F.lit(""), {"brass": ["brass"], "steel": ["steel"]})
    return skew.bucketed_sequence(p.select("p_partkey", kind.alias("cluster"), (-F.col("p_size")).alias("b")), "cluster", "b", ["p_partkey"], "place").select("cluster", "p_partkey", "place")


@R.add(rf"select id, regexp_replace(body, '^[\t-\r\p{{Z}}\x{{FEFF}}]+|[\t-\r\p{{Z}}\x{{FEFF}}]+$', '', 'g') body from {_COMMENTS} where body <> regexp_replace(body, '^[\t-\r\p{{Z}}\x{{FEFF}}]+|[\t-\r\p{{Z}}\x{{FEFF}}]+$', '', 'g')")
def untidy_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Comments with white space at either end, without it."""
    c = _comments(spark, folder, "body")
    return c.withColumn("t", T.full_trim(F.col("body"))).where("t <> body").select("id", F.col("t").alias("body"))


_FENCED = r"(?s)(?:^|\n)(```[a-z]*[ \t]*\n.*?\n```)"


@R.add(rf"""
with f as (select id, unnest(regexp_extract_all(body, '{_FENCED}', 1)) block, generate_subscripts(regexp_extract_all(body, '{_FENCED}', 1), 1) - 1 place from {_COMMENTS} where contains(body, '```'))
select id, place, regexp_replace(block, '(?s)^```[a-z]*\s*\n(.*?)\n?```$', '\1') code from f""")
def fenced_code(spark: SparkSession, folder: str) -> DataFrame:
    """The code in every fenced block of a comment, without its fence."""
    blocks = F.regexp_extract_all("body", F.lit(_FENCED), F.lit(1))
    c = _comments(spark, folder, "body").where(F.col("body").contains("```")).select("id", F.posexplode(blocks).alias("place", "block"))
    return c.select("id", "place", T.unfenced(F.col("block")).alias("code"))


@R.add(f"select number, array_to_string(list_transform(string_split(title, '/'), lambda x: url_encode(x)), '/') path from {_ISSUES} where title is not null")
def title_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as paths of a URL, every segment percent-encoded."""
    return _issues(spark, folder, "title").where("title is not null").select("number", T.path_segments(F.col("title")).alias("path"))
