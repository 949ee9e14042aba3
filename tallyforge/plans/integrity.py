"""Integrity of the release tables: references in all directions, reciprocity, shapes, paths, keys and states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import chains, quality, skew, timeline
from tallyforge.operators.references import plain_key
from tallyforge.operators.timeline import latest
from tallyforge.plans.registry import Registry
from tallyforge.sources import load

R = Registry()

#: Every direction in which a table of the release names another: child, its key, the field, parent, its key.
DIRECTIONS = [
    ("plugins", "record_id", "evidence_ids", "evidence", "evidence_id"),
    ("plugins", "record_id", "review.correction_ids", "corrections", "correction_id"),
    ("plugins", "record_id", "review.source_ids", "sources", "source_id"),
    ("evidence", "evidence_id", "record_id", "plugins", "record_id"),
    ("evidence", "evidence_id", "correction_ids", "corrections", "correction_id"),
    ("corrections", "correction_id", "record_id", "plugins", "record_id"),
    ("corrections", "correction_id", "evidence_ids", "evidence", "evidence_id"),
    ("corrections", "correction_id", "source_ids", "sources", "source_id"),
    ("sources", "source_id", "record_ids", "plugins", "record_id"),
]
_KEY = r"nullif(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '')"


def _references(spark: SparkSession, folder: str, child: str, key: str, field: str) -> DataFrame:
    """child_id, ref_id of every reference of one direction, keys trimmed and in lower case."""
    df = load(spark, folder, child)
    many = field.endswith("_ids")
    named = df.select(plain_key(F.col(key)).alias("child_id"), (F.explode(field) if many else F.col(field)).alias("r"))
    return named.select("child_id", plain_key(F.col("r")).alias("ref_id")).where("child_id is not null and ref_id is not null")


def _edges(spark: SparkSession, folder: str, child: str, key: str, field: str) -> DataFrame:
    """The distinct references of one direction."""
    return _references(spark, folder, child, key, field).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _edges_sql(child: str, key: str, field: str) -> str:
    ref = f"unnest({field})" if field.endswith("_ids") else field
    return f"select distinct {_KEY.format('c')} child_id, {_KEY.format('r')} ref_id from (select {key} c, {ref} r from {child}) where {_KEY.format('c')} is not null and {_KEY.format('r')} is not null"


@R.add(" union all ".join(f"""
select '{c}' child_table, '{f}' field, '{p}' parent_table, count(*) n_references, count(distinct ref_id) n_targets, count_if(k is null) n_dangling
from ({_edges_sql(c, ck, f)}) left join (select distinct {_KEY.format(pk)} k from {p}) on k = ref_id""" for c, ck, f, p, pk in DIRECTIONS))
def references_by_direction(spark: SparkSession, folder: str) -> DataFrame:
    """Per direction of the foreign keys its references, their targets and those without a target.

    The references of all directions are folded in one shuffle to one row a direction and target, so no hot target is left when they meet the keys.
    """
    edges = _union([
        _references(spark, folder, child, key, field).select(F.lit(i).alias("direction"), F.lit(parent).alias("parent_table"), "child_id", "ref_id")
        for i, (child, key, field, parent, _) in enumerate(DIRECTIONS)
    ]).distinct()
    keys = {(parent, key) for *_, parent, key in DIRECTIONS}
    known = _union([load(spark, folder, t).select(F.lit(t).alias("parent_table"), plain_key(F.col(k)).alias("ref_id")).where("ref_id is not null") for t, k in sorted(keys)]).distinct()
    per = edges.groupBy("direction", "parent_table", "ref_id").agg(F.count("*").alias("n"))
    counts = per.join(known.withColumn("_known", F.lit(True)), ["parent_table", "ref_id"], "left").groupBy("direction").agg(
        F.sum("n").alias("n_references"), F.count("*").alias("n_targets"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("n_dangling")
    )
    names = spark.createDataFrame([(i, c, f, p) for i, (c, _, f, p, _) in enumerate(DIRECTIONS)], "direction int, child_table string, field string, parent_table string")
    return names.join(counts, "direction", "left").drop("direction").fillna(0)


#: Pairs of directions that must tell the same links.
PAIRS = [(0, 3), (1, 5), (4, 6), (2, 8)]


@R.add(" union all ".join(f"""
select '{DIRECTIONS[i][0]}-{DIRECTIONS[i][3]}' pair, coalesce(f.a, b.a) a, coalesce(f.b, b.b) b, case when b.a is null then 'forward' else 'backward' end side
from (select child_id a, ref_id b from ({_edges_sql(*DIRECTIONS[i][:3])})) f full join (select ref_id a, child_id b from ({_edges_sql(*DIRECTIONS[j][:3])})) b on f.a = b.a and f.b = b.b
where f.a is null or b.a is null""" for i, j in PAIRS))
def links_one_sided(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the four pairs of tables that name each other which only one side tells, all pairs in one shuffle."""
    name = [F.lit(f"{DIRECTIONS[i][0]}-{DIRECTIONS[i][3]}").alias("pair") for i, _ in PAIRS]
    forward = _union([_references(spark, folder, *DIRECTIONS[i][:3]).select(n, F.col("child_id").alias("a"), F.col("ref_id").alias("b")) for n, (i, _) in zip(name, PAIRS, strict=True)])
    backward = _union([_references(spark, folder, *DIRECTIONS[j][:3]).select(n, F.col("ref_id").alias("a"), F.col("child_id").alias("b")) for n, (_, j) in zip(name, PAIRS, strict=True)])
    return quality.one_sided_edges(forward, backward, ["pair"])


_CORRECTION_EVIDENCE = _edges_sql("corrections", "correction_id", "evidence_ids")


@R.add(f"""
with e as (select distinct {_KEY.format('evidence_id')} evidence_id from evidence where {_KEY.format('evidence_id')} is not null),
c as (select ref_id, count(*) n, min(child_id) first_id, max(child_id) last_id from ({_CORRECTION_EVIDENCE}) group by 1)
select evidence_id, coalesce(n, 0) n_corrections, first_id, last_id, case when n is null then 'historical' else 'corrected' end status from e left join c on ref_id = evidence_id""")
def evidence_review(spark: SparkSession, folder: str) -> DataFrame:
    """Every evidence row with the number of corrections that name it, the first and last of them, and the status that follows."""
    c = _edges(spark, folder, "corrections", "correction_id", "evidence_ids").groupBy(F.col("ref_id").alias("evidence_id")).agg(
        F.count("*").alias("n"), F.min("child_id").alias("first_id"), F.max("child_id").alias("last_id")
    )
    e = load(spark, folder, "evidence").select(plain_key(F.col("evidence_id")).alias("evidence_id")).where("evidence_id is not null").distinct()
    return e.join(c, "evidence_id", "left").select(
        "evidence_id", F.coalesce("n", F.lit(0)).alias("n_corrections"), "first_id", "last_id", F.when(F.col("n").isNull(), "historical").otherwise("corrected").alias("status")
    )


_SOURCES = "(select distinct on (source_id) * from sources where source_id is not null order by source_id, loaded_at desc)"


@R.add(f"""
with h as (select repository_url, max(struct_pack(checked_at, revision)) m from {_SOURCES} where repository_url is not null and checked_at is not null and revision is not null group by 1)
select source_id, revision_relation stated, case when h.m.revision = s.revision then 'current-reference' else 'reported-registry-reference' end derived,
  coalesce(revision_relation = case when h.m.revision = s.revision then 'current-reference' else 'reported-registry-reference' end, false) agrees
from {_SOURCES} s left join h using (repository_url)""")
def revision_relations(spark: SparkSession, folder: str) -> DataFrame:
    """The stated relation of a source's revision beside the one derived from the revision of its repository that was checked last."""
    s = latest(load(spark, folder, "sources").select("source_id", "repository_url", "revision", "revision_relation", "checked_at", "loaded_at"), "source_id", ["loaded_at"])
    named = s.where("repository_url is not null and checked_at is not null and revision is not null")
    head = named.groupBy("repository_url").agg(F.max(F.struct("checked_at", "revision"))["revision"].alias("_head"))
    derived = F.when(F.col("_head") == F.col("revision"), "current-reference").otherwise("reported-registry-reference")
    return s.join(head, "repository_url", "left").select(
        "source_id", F.col("revision_relation").alias("stated"), derived.alias("derived"), F.coalesce(F.col("revision_relation") == derived, F.lit(False)).alias("agrees")
    )


_PATHS = """
select 'evidence.file' place, file path from evidence union all select 'plugins.directory', directory from plugins
union all select 'sources.repository_url', repository_url from sources union all select 'sources.files.path', unnest(files).path from sources"""
_SAFE = r"""path is not null and path <> '' and not starts_with(path, '/') and not contains(path, '\') and not contains(path, chr(0)) and not regexp_matches(path, '^[A-Za-z]:')
  and len(list_filter(string_split(path, '/'), lambda x: x in ('', '.', '..'))) = 0"""


@R.add(f"select place, count(*) n_paths, count_if(not ({_SAFE})) n_unsafe from ({_PATHS}) where path is not null group by 1")
def unsafe_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths by place, and those that are no safe relative path: absolute, climbing, with a drive, back slashes, zeros or empty steps."""
    sources = load(spark, folder, "sources")
    paths = (
        load(spark, folder, "evidence").select(F.lit("evidence.file").alias("place"), F.col("file").alias("path"))
        .unionByName(load(spark, folder, "plugins").select(F.lit("plugins.directory").alias("place"), F.col("directory").alias("path")))
        .unionByName(sources.select(F.lit("sources.repository_url").alias("place"), F.col("repository_url").alias("path")))
        .unionByName(sources.select(F.lit("sources.files.path").alias("place"), F.explode("files.path").alias("path")))
    )
    return paths.where("path is not null").groupBy("place").agg(F.count("*").alias("n_paths"), F.count_if(~T.safe_path(F.col("path"))).alias("n_unsafe"))


_PRIVATE = r"(?:^|[^A-Za-z0-9._~-])/(?:home|users|var/lib/[a-z]+)(?:[/\s''\"\\]|$)"


@R.add(rf"""
select place, count(*) n_texts, count_if(regexp_matches(lower(t), '{_PRIVATE}')) n_private, count_if(regexp_matches(t, '(^|[^A-Za-z0-9._~-])/[A-Za-z]+/')) n_absolute
from (select 'comments.body' place, body t from comments union all select 'issues.body', body from issues union all select 'evidence.snippet', snippet from evidence union all select 'documents.text', text from documents)
where t is not null group by 1""")
def private_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Texts by place, those that show a path below a home folder, and those with any absolute path."""
    texts = None
    for table, column in (("comments", "body"), ("issues", "body"), ("evidence", "snippet"), ("documents", "text")):
        part = load(spark, folder, table).select(F.lit(f"{table}.{column}").alias("place"), F.col(column).alias("t"))
        texts = part if texts is None else texts.unionByName(part)
    return texts.where("t is not null").groupBy("place").agg(
        F.count("*").alias("n_texts"), F.count_if(F.lower("t").rlike(_PRIVATE.replace("''", "'"))).alias("n_private"), F.count_if(F.col("t").rlike(r"(^|[^A-Za-z0-9._~-])/[A-Za-z]+/")).alias("n_absolute")
    )


#: Checks of every table: name, condition as SQL for both engines ({t} stands for a timestamp parsed or null).
CHECKS = {
    "evidence": ("evidence_id", [("line not negative", "line >= 0"), ("file named", "file <> ''"), ("record key form", r"regexp_like(record_key, '^chunk_[0-9]+:[0-9]+$')"), ("id tells record key", "starts_with(evidence_id, 'evidence:' || replace(record_key, ':', '-'))")]),
    "sources": ("source_id", [("revision form", "regexp_like(revision, '^[0-9a-f]{40}$')"), ("https repository", "starts_with(repository_url, 'https://')"), ("id form", "regexp_like(source_id, '^SRC-[A-Z0-9]+-[A-Z0-9]+-[0-9A-Z-]+$')"), ("checked on a day", "regexp_like(checked_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')")]),
    "corrections": ("correction_id", [("checked on a day", "regexp_like(checked_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')"), ("id form", "regexp_like(correction_id, '^CORR-[0-9]{4}-[0-9]+-[A-Z-]+$')"), ("known status", "status = 'corrected-static-interpretation'"), ("names a record", "trim(record_id) <> ''")]),
    "issues": ("number", [("known state", "state in ('open', 'closed')"), ("titled", "trim(title) <> ''"), ("closed has a time", "state <> 'closed' or closed_at <> ''"), ("user named", '"user" <> \'\'')]),
    "comments": ("id", [("belongs to an issue", "issue_number > 0"), ("user named", '"user" <> \'\''), ("has a text", "body <> ''"), ("time form", "regexp_like(created_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}')")]),
    "plugins": ("record_id", [("count not negative", "files_inspected_count >= 0"), ("record key form", r"regexp_like(record_key, '^chunk_[0-9]+:[0-9]+$')"), ("directory named", "directory <> ''"), ("summary told", "verdict.summary <> ''")]),
}
_CHECK_ROWS = " union all ".join(
    f"select '{t}' table_name, '{name}' \"check\", cast({key} as varchar) k, {cond.replace('regexp_like', 'regexp_matches')} ok from {t}" for t, (key, checks) in CHECKS.items() for name, cond in checks
)


def _check_rows(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, check, k of every row of every table that breaks a check of its shape."""
    out = None
    for table, (key, checks) in CHECKS.items():
        conditions = {name: F.expr(cond.replace('"user"', "`user`").replace("starts_with(", "startswith(").replace("\\", "\\\\")) for name, cond in checks}
        part = quality.violations(load(spark, folder, table), table, F.col(key).cast("string"), conditions)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("key", "k")


@R.add(f"select table_name, \"check\", count(*) n, min(k) first_key from ({_CHECK_ROWS}) where not coalesce(ok, false) group by 1, 2")
def shape_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all six tables that break a check of their shape, by check, with the first key."""
    return _check_rows(spark, folder).groupBy("table_name", "check").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


@R.add(f"""
with f as (select distinct table_name, "check", k from ({_CHECK_ROWS}) where not coalesce(ok, false) and k is not null), n as (select count(*) total from f)
select table_name, "check", k, total from f, n order by table_name, "check", k limit 10""")
def first_faults(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten faults of all tables and how many there are: a report that stays readable."""
    f = _check_rows(spark, folder).where("k is not null").distinct()
    first = f.orderBy("table_name", "check", "k").limit(10)
    return first.join(F.broadcast(f.agg(F.count("*").alias("total"))))


_PLUGINS = "(select distinct on (record_id) * from plugins where record_id is not null order by record_id, loaded_at desc)"


@R.add(f"""
select array_to_string(list_sort(map_keys(features)), ' ') "keys", count(*) n, list_sort(map_keys(features)) = ['bar_widget', 'ipc', 'network', 'privilege', 'settings_ui'] exact from {_PLUGINS} where features is not null group by 1, 3""")
def feature_key_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Which sets of feature keys there are, and whether a set is exactly the wanted one."""
    p = load(spark, folder, "plugins").select("record_id", F.sort_array(F.map_keys("features")).alias("k"), "loaded_at")
    one = latest(p, "record_id", ["loaded_at"]).where("k is not null")
    wanted = F.array(*[F.lit(x) for x in ("bar_widget", "ipc", "network", "privilege", "settings_ui")])
    return one.groupBy("k").agg(F.count("*").alias("n")).select(F.array_join("k", " ").alias("keys"), "n", (F.col("k") == wanted).alias("exact"))


@R.add(f"""
select coalesce(bool_or(verdict.runtime_verified), false) any_runtime_verified, coalesce(bool_or(features['privilege'] is true), false) any_privilege,
  coalesce(bool_and(coalesce(revision_verified, false)), true) all_revisions_verified from {_PLUGINS}""")
def release_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Whether any record was verified at run time, any wants privileges, and all revisions are verified."""
    p = load(spark, folder, "plugins").select("record_id", F.col("verdict.runtime_verified").alias("r"), "revision_verified", F.try_element_at("features", F.lit("privilege")).alias("p"), "loaded_at")
    return latest(p, "record_id", ["loaded_at"]).agg(
        F.coalesce(F.bool_or("r"), F.lit(False)).alias("any_runtime_verified"), F.coalesce(F.bool_or(F.coalesce("p", F.lit(False))), F.lit(False)).alias("any_privilege"),
        F.coalesce(F.bool_and(F.coalesce("revision_verified", F.lit(False))), F.lit(True)).alias("all_revisions_verified"),
    )


@R.add(f"""
with l as (select child_id k, list_sort(list(ref_id)) ids from ({_edges_sql(*DIRECTIONS[0][:3])}) group by 1), r as (select ref_id k, list_sort(list(child_id)) ids from ({_edges_sql(*DIRECTIONS[3][:3])}) group by 1)
select k as record_id, coalesce(l.ids = r.ids, false) same from l full join r using (k)""")
def evidence_sets_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a record's evidence ids are the ids of the evidence that names it. Sets are compared by size and by sum of hashes, so no set is gathered."""
    sides = []
    for d, owner, member, name in ((0, "child_id", "ref_id", "l"), (3, "ref_id", "child_id", "r")):
        e = _edges(spark, folder, *DIRECTIONS[d][:3])
        h = F.xxhash64(member).cast("decimal(20,0)")
        sides.append(e.groupBy(F.col(owner).alias("record_id")).agg(F.struct(F.count("*"), F.sum(h), F.sum(F.xxhash64(F.lit(7), member).cast("decimal(20,0)"))).alias(name)))
    return sides[0].join(sides[1], "record_id", "full").select("record_id", F.coalesce(F.col("l") == F.col("r"), F.lit(False)).alias("same"))


_CUT = "2026-05-01"
_FIELDS = ["plugin_id", "directory", "release", "source_report", "files_inspected_count"]


@R.add(f"""
with o as (select distinct on (record_id) * from plugins where record_id is not null and loaded_at < timestamptz '{_CUT} 00:00:00+00' order by record_id, loaded_at desc),
n as (select distinct on (plugin_id) * from plugins where plugin_id is not null order by plugin_id, record_id desc, loaded_at desc)
select field, count_if(changed) n_changed, count(*) n_rows from (select unnest([{', '.join("{'field': '" + f + "', 'changed': o." + f + " is distinct from n." + f + "}" for f in _FIELDS)}], recursive := true) from o join n using (plugin_id)) group by 1""")
def changed_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Field by field, how many records before a date differ from the last record of their plugin."""
    p = load(spark, folder, "plugins").select("record_id", *_FIELDS, "loaded_at")
    old = latest(p.where(F.col("loaded_at") < F.lit(f"{_CUT} 00:00:00").cast("timestamp")), "record_id", ["loaded_at"])
    new = latest(p, "plugin_id", ["record_id", "loaded_at"])
    return quality.field_changes(old, new, "plugin_id", _FIELDS)


@R.add(f"select source_id, array_to_string(list_filter(list_transform(range(1, len(ps) + 1), lambda i: case when list_position(ps, ps[i]) = i then ps[i] end), lambda x: x is not null), ' ') paths, ps[len(ps)] last_path from (select source_id, list_transform(files, lambda f: f.path) ps from {_SOURCES}) where ps is not null")
def source_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct paths of each source in order of first occurrence, and the path that stands last."""
    s = load(spark, folder, "sources").select("source_id", F.col("files.path").alias("ps"), "loaded_at")
    return latest(s, "source_id", ["loaded_at"]).where("ps is not null").select("source_id", F.array_join(F.array_distinct("ps"), " ").alias("paths"), F.try_element_at("ps", F.lit(-1)).alias("last_path"))


#: Files that describe a source best, in order.
PREFERRED = ["manifest.json", "Main.qml", "BarWidget.qml", "Panel.qml"]
_RANK = "coalesce(list_position([" + ", ".join(f"'{x}'" for x in PREFERRED) + "], path), 99)"


@R.add(f"select distinct on (source_id) source_id, path from (select source_id, unnest(files).path path from {_SOURCES}) where path is not null order by source_id, {_RANK}, path")
def preferred_files(spark: SparkSession, folder: str) -> DataFrame:
    """The file that describes each source best: by a list of preferred names, else the first by name."""
    s = latest(load(spark, folder, "sources").select("source_id", F.col("files.path").alias("ps"), "loaded_at"), "source_id", ["loaded_at"])
    return s.select("source_id", T.preferred(F.col("ps"), PREFERRED).alias("path")).where("path is not null")


_ORDER = ["process_lifecycle", "agent_steering_files", "prebuilt_binaries"]
_PLACE = "coalesce(list_position([" + ", ".join(f"'{x}'" for x in _ORDER) + "], type), 99)"


@R.add(f"select type, count(*) n, row_number() over (order by {_PLACE}, type) - 1 place from evidence where type is not null group by type")
def evidence_types_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Types of evidence in a configured order, all others behind them by name in the order of a dictionary."""
    counts = load(spark, folder, "evidence").where("type is not null").groupBy("type").agg(F.count("*").alias("n"))
    return quality.configured_order(counts, "type", _ORDER, "place")


@R.add("""
select a.node, a.fault from (select src node, 'branch' fault from (select distinct correction_id src, unnest(evidence_ids) dst from corrections) where src is not null and dst is not null group by 1 having count(*) > 1
union all select dst, 'merge' from (select distinct correction_id src, unnest(evidence_ids) dst from corrections) where src is not null and dst is not null group by 1 having count(*) > 1) a""")
def correction_chain_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Where corrections and evidence do not form a chain: corrections with several evidence rows, evidence with several corrections."""
    return chains.faults(load(spark, folder, "corrections").select(F.col("correction_id").alias("src"), F.explode("evidence_ids").alias("dst")))


@R.add("select release, count(*) n, release is not null and release <> '' and len(release) <= 256 and not regexp_matches(release, '[\\x00-\\x1f\\x7f]') valid from plugins group by 1, 3")
def release_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Release tags, their rows, and whether a tag is a proper one."""
    return load(spark, folder, "plugins").groupBy("release").agg(F.count("*").alias("n")).select("release", "n", T.release_tag(F.col("release")).isNotNull().alias("valid"))


@R.add("""
with e as (select user_id, cast(ts as date) d, ts, event_id, event_type from events where ts < timestamp '2024-01-21')
select user_id, cast(d as varchar) as date, arg_max(event_id, (ts, event_id)) event_id, arg_max(event_type, (ts, event_id)) event_type from e group by 1, 2""")
def last_event_of_day(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user and UTC day up to a horizon."""
    e = load(spark, folder, "events").where(F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")).select("user_id", F.to_date("ts").alias("d"), "ts", "event_id", "event_type")
    last = e.groupBy("user_id", "d").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("m"))
    return last.select("user_id", F.col("d").cast("string").alias("date"), "m.event_id", "m.event_type")


@R.add("""
with d as (select cast(ts as date) d, count(distinct user_id) total from events group by 1)
select cast(d as varchar) as date, total, total - coalesce(lag(total) over (order by d), 0) change, coalesce(d - lag(d) over (order by d) = 1, true) follows from d""")
def daily_users(spark: SparkSession, folder: str) -> DataFrame:
    """Users of each day, the change from the day before, and whether the day follows the one before it. The window runs over days only."""
    days = load(spark, folder, "events").select(F.to_date("ts").alias("d"), "user_id").groupBy("d").agg(F.count_distinct("user_id").alias("total"))
    return timeline.first_differences(days, "d", "total").select(F.col("d").cast("string").alias("date"), "total", "change", "follows")


@R.add("""
select event_id, (select max(p.event_id) from events p where p.user_id = e.user_id and p.event_type in ('view', 'click') and p.event_id < e.event_id) before_id
from events e where event_type = 'purchase'""")
def event_before_purchase(spark: SparkSession, folder: str) -> DataFrame:
    """For each purchase the user's last view or click with a smaller event id; null if there is none."""
    e = load(spark, folder, "events").select("user_id", "event_id", "event_type")
    bucket = F.floor(F.col("event_id") / 100_000)
    return timeline.last_before(e, "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type").isin("view", "click"), bucket).select("event_id", F.col("before").alias("before_id"))


@R.add("""
with o as (select o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) before, row_number() over (partition by o_custkey order by o_orderkey) - 1 pos from orders)
select o_orderkey, pos from o where o_orderdate < before""")
def order_time_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Orders, in order of key, whose date lies before that of the customer's order before: places where a chain runs back in time."""
    o = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("b", F.floor(F.col("o_orderkey") / 100_000))
    numbered = skew.bucketed_sequence(o, "o_custkey", "b", ["o_orderkey"], "pos")
    before = numbered.select("o_custkey", (F.col("pos") + 1).alias("pos"), F.col("o_orderdate").alias("before"))
    return numbered.join(before, ["o_custkey", "pos"]).where("o_orderdate < before").select("o_orderkey", "pos")


_SOURCE_RECORDS = _edges_sql("sources", "source_id", "record_ids")


@R.add(f"select ref_id b, count(distinct child_id) n_parents from ({_SOURCE_RECORDS}) group by 1 having count(distinct child_id) > 1")
def records_of_several_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Plugin records that more than one source names."""
    return quality.several_parents(_edges(spark, folder, "sources", "source_id", "record_ids").select(F.col("child_id").alias("a"), F.col("ref_id").alias("b")))


@R.add("""
with p as (select distinct plugin_id a, record_id b from plugins where plugin_id is not null and record_id is not null)
select 'a' side, a as value, count(*) n from p group by 2 having count(*) > 1 union all select 'b', b, count(*) from p group by 2 having count(*) > 1""")
def plugin_ids_not_bijective(spark: SparkSession, folder: str) -> DataFrame:
    """Plugin ids with several records and records with several plugin ids."""
    return quality.not_bijective(load(spark, folder, "plugins"), "plugin_id", "record_id")


@R.add(f"""
with l as (select distinct {_KEY.format('record_id')} v from corrections), r as (select distinct {_KEY.format('record_id')} v from plugins)
select v as value, 'left' side from l where v is not null and v not in (select v from r where v is not null)
union all select v, 'right' from r where v is not null and v not in (select v from l where v is not null)""")
def corrected_records_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Record ids that only corrections or only plugin records know: corrections of nothing, and records without a correction."""
    sides = [load(spark, folder, t).select(plain_key(F.col("record_id"))) for t in ("corrections", "plugins")]
    return quality.set_difference(*sides)


@R.add(f"""
with c as (select c.child_id, c.ref_id, r.ref_id record_id from ({_CORRECTION_EVIDENCE}) c join ({_edges_sql("corrections", "correction_id", "record_id")}) r using (child_id))
select c.child_id correction_id, c.ref_id evidence_id, c.record_id, e.ref_id evidence_record from c join ({_edges_sql("evidence", "evidence_id", "record_id")}) e on e.child_id = c.ref_id where e.ref_id <> c.record_id""")
def evidence_of_other_records(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that a correction names although it belongs to another record than the corrected one. Hot evidence is split by the lookup."""
    named = _edges(spark, folder, "corrections", "correction_id", "evidence_ids").withColumnRenamed("ref_id", "evidence_id")
    corrected = _edges(spark, folder, "corrections", "correction_id", "record_id").withColumnRenamed("ref_id", "record_id")
    owner = _edges(spark, folder, "evidence", "evidence_id", "record_id").select(F.col("child_id").alias("evidence_id"), F.col("ref_id").alias("evidence_record"))
    pairs = named.join(corrected, "child_id").withColumnRenamed("child_id", "correction_id")
    return skew.lookup_join(pairs, owner, "evidence_id", "inner").where("evidence_record <> record_id").select("correction_id", "evidence_id", "record_id", "evidence_record")
