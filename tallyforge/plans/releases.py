"""Release statistics and data quality of plugin records, evidence, sources and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import quality, skew, stats, timeline
from tallyforge.operators.timeline import latest
from tallyforge.plans.registry import Registry
from tallyforge.sources import load

R = Registry()

VERDICTS = ["pass", "warning", "broken", "suspicious"]
JOINS = ["exact", "directory_candidate", "unmatched"]
FEATURES = ["bar_widget", "network", "ipc", "settings_ui", "privilege"]


def _plugins(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per record: its last delivery, by aggregate. Only the asked columns are read."""
    wanted = ["record_id", *[c for c in columns if c != "record_id"], "loaded_at"]
    return latest(load(spark, folder, "plugins").select(*wanted), "record_id", ["loaded_at"])


def _scalar_plugins(spark: SparkSession, folder: str) -> DataFrame:
    p = load(spark, folder, "plugins").select(
        "record_id", "record_key", "files_inspected_count", "join", F.col("verdict.normalized").alias("verdict"), "loaded_at",
        F.try_element_at("features", F.lit("network")).alias("network"),
    )
    return latest(p, "record_id", ["loaded_at"])


_PLUGINS = "(select distinct on (record_id) * from plugins where record_id is not null order by record_id, loaded_at desc)"


@R.add(f"""
select count(*) n_records, count(distinct split_part(record_key, ':', 1)) n_chunks, sum(coalesce(files_inspected_count, 0)) n_files,
  count_if("join" = 'exact') n_exact, count_if(verdict.normalized = 'pass') n_pass,
  count_if(features['network'] is true) network_true, count_if(features['network'] is false) network_false, count_if(features['network'] is null) network_null
from {_PLUGINS}""")
def release_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Release-style statistics in one row and one pass over the deduplicated records."""
    return _scalar_plugins(spark, folder).agg(
        F.count("*").alias("n_records"),
        F.count_distinct(F.substring_index("record_key", ":", 1)).alias("n_chunks"),
        F.sum(F.coalesce("files_inspected_count", F.lit(0))).alias("n_files"),
        F.count_if(F.col("join") == "exact").alias("n_exact"),
        F.count_if(F.col("verdict") == "pass").alias("n_pass"),
        F.count_if(F.col("network")).alias("network_true"),
        F.count_if(~F.col("network")).alias("network_false"),
        F.count_if(F.col("network").isNull()).alias("network_null"),
    )


def _domain_sql(column: str, values: list[str]) -> str:
    listed = ", ".join(f"('{v}')" for v in [*values, "(other)"])
    known = ", ".join(f"'{v}'" for v in values)
    return f"""
with c as (select case when {column} in ({known}) then {column} else '(other)' end v, count(*) n from {_PLUGINS} group by 1)
select d.v as value, coalesce(c.n, 0) n from (values {listed}) d(v) left join c on c.v = d.v"""


@R.add(_domain_sql("verdict.normalized", [*VERDICTS, "withdrawn"]))
def verdict_domain_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts over their closed domain; members without a record count 0."""
    return stats.domain_counts(_scalar_plugins(spark, folder), F.col("verdict"), [*VERDICTS, "withdrawn"])


@R.add(_domain_sql('"join"', JOINS))
def join_domain_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Join results over their closed domain."""
    return stats.domain_counts(_scalar_plugins(spark, folder), F.col("join"), JOINS)


@R.add("select v as name, count_if(features[v] is true) n_true, count_if(features[v] is false) n_false, count_if(features[v] is null) n_null from "
       + _PLUGINS + " p, (values " + ", ".join(f"('{f}')" for f in FEATURES) + ") d(v) group by 1")
def feature_tri_state(spark: SparkSession, folder: str) -> DataFrame:
    """Features that are true, false or unknown; a missing key is unknown."""
    p = load(spark, folder, "plugins").select("record_id", *[F.try_element_at("features", F.lit(f)).alias(f) for f in FEATURES], "loaded_at")
    return stats.tri_state(latest(p, "record_id", ["loaded_at"]), {f: F.col(f) for f in FEATURES})


@R.add(f"""
with s as (select count(*) n_records, count(distinct split_part(record_key, ':', 1)) n_chunks from {_PLUGINS}),
u as (select 'n_records' as name, n_records actual from s union all select 'n_chunks', n_chunks from s)
select c.name, c.claimed, u.actual, coalesce(c.claimed = u.actual, false) holds
from (values ('n_records', 3086), ('n_chunks', 311), ('n_stars', 1)) c(name, claimed) left join u using (name)""")
def claims_against_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Claimed figures beside the recomputed ones."""
    s = _scalar_plugins(spark, folder).agg(F.count("*").alias("n_records"), F.count_distinct(F.substring_index("record_key", ":", 1)).alias("n_chunks"))
    return stats.claims_report(spark, s, [("n_records", 3086), ("n_chunks", 311), ("n_stars", 1)])


@R.add("""
select 'plugins' t, record_id as key, count(*) n_rows from plugins group by 2 having count(*) > 1
union all select 'evidence', evidence_id, count(*) from evidence group by 2 having count(*) > 1
union all select 'sources', source_id, count(*) from sources group by 2 having count(*) > 1
union all select 'corrections', correction_id, count(*) from corrections group by 2 having count(*) > 1""")
def repeated_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that were delivered more than once, per table."""
    parts = [
        quality.duplicate_keys(load(spark, folder, t).select(k), k).select(F.lit(t).alias("t"), "key", "n_rows")
        for t, k in (("plugins", "record_id"), ("evidence", "evidence_id"), ("sources", "source_id"), ("corrections", "correction_id"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@R.add("select * from (select evidence_id as key, count(*) n_rows, count(distinct (record_id, file, line, snippet)) n_versions from evidence group by 1) where n_rows > 1")
def evidence_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence delivered again, and whether its content changed."""
    e = load(spark, folder, "evidence").select("evidence_id", "record_id", "file", "line", "snippet")
    return quality.duplicate_keys(e, "evidence_id", ["evidence_id"])



@R.add("""
with f as (select distinct record_id a, unnest(evidence_ids) b from plugins), r as (select distinct record_id a, evidence_id b from evidence),
ff as (select * from f where a is not null and b is not null), rr as (select * from r where a is not null and b is not null)
select a, b, 'forward' side from (select * from ff except select * from rr) union all select a, b, 'backward' from (select * from rr except select * from ff)""")
def evidence_links_one_sided(spark: SparkSession, folder: str) -> DataFrame:
    """Links of plugins and evidence that only one side tells."""
    forward = load(spark, folder, "plugins").select(F.col("record_id").alias("a"), F.explode("evidence_ids").alias("b"))
    backward = load(spark, folder, "evidence").select(F.col("record_id").alias("a"), F.col("evidence_id").alias("b"))
    return quality.one_sided_edges(forward, backward)


@R.add("""
with f as (select distinct record_id a, unnest(review.correction_ids) b from plugins), r as (select distinct record_id a, correction_id b from corrections),
ff as (select * from f where a is not null and b is not null), rr as (select * from r where a is not null and b is not null)
select a, b, 'forward' side from (select * from ff except select * from rr) union all select a, b, 'backward' from (select * from rr except select * from ff)""")
def correction_links_one_sided(spark: SparkSession, folder: str) -> DataFrame:
    """Links of plugins and corrections that only one side tells."""
    forward = load(spark, folder, "plugins").select(F.col("record_id").alias("a"), F.explode("review.correction_ids").alias("b"))
    backward = load(spark, folder, "corrections").select(F.col("record_id").alias("a"), F.col("correction_id").alias("b"))
    return quality.one_sided_edges(forward, backward)


@R.add("select b, count(distinct a) n_parents from (select record_id a, unnest(evidence_ids) b from plugins) where a is not null and b is not null group by 1 having count(distinct a) > 1")
def evidence_claimed_twice(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence that more than one plugin record claims."""
    return quality.several_parents(load(spark, folder, "plugins").select(F.col("record_id").alias("a"), F.explode("evidence_ids").alias("b")))


@R.add("""
select distinct e.evidence_id, e.record_key evidence_key, p.record_key plugin_key
from evidence e join plugins p using (record_id) where e.record_key <> p.record_key""")
def record_keys_disagree(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence whose record_key differs from that of the plugin record it names."""
    p = load(spark, folder, "plugins").select("record_id", F.col("record_key").alias("plugin_key")).distinct()
    e = load(spark, folder, "evidence").select("evidence_id", "record_id", F.col("record_key").alias("evidence_key")).distinct()
    return e.join(p, "record_id").where("evidence_key <> plugin_key").select("evidence_id", "evidence_key", "plugin_key").distinct()


@R.add("""
with l as (select distinct unnest(evidence_ids) v from plugins), r as (select distinct evidence_id v from evidence)
select v as value, 'left' side from l where v is not null and v not in (select v from r where v is not null)
union all select v, 'right' from r where v is not null and v not in (select v from l where v is not null)""")
def evidence_ids_difference(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence ids that only plugin records or only the evidence table know."""
    return quality.set_difference(load(spark, folder, "plugins").select(F.explode("evidence_ids")), load(spark, folder, "evidence").select("evidence_id"))


_CUT = "2026-05-01"


@R.add(f"""
with o as (select distinct on (record_id) record_id k, plugin_id, "join" j, verdict.normalized v from plugins where loaded_at < timestamptz '{_CUT} 00:00:00+00' and (removed_at is null or removed_at >= timestamptz '{_CUT} 00:00:00+00') order by record_id, loaded_at desc),
n as (select distinct on (record_id) record_id k, plugin_id, "join" j, verdict.normalized v from plugins where removed_at is null order by record_id, loaded_at desc)
select coalesce(o.k, n.k) as key, case when o.k is null then 'added' when n.k is null then 'removed'
  when (o.plugin_id, o.j, o.v) is not distinct from (n.plugin_id, n.j, n.v) then 'same' else 'changed' end change
from o full join n on o.k = n.k""")
def catalog_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Records added, removed or changed between the state at a date and the last state."""
    p = load(spark, folder, "plugins").select("record_id", "plugin_id", F.col("join").alias("j"), F.col("verdict.normalized").alias("v"), "loaded_at", "removed_at")
    cut = F.lit(f"{_CUT} 00:00:00").cast("timestamp")
    old = p.where((F.col("loaded_at") < cut) & (F.col("removed_at").isNull() | (F.col("removed_at") >= cut)))
    states = [latest(x.drop("removed_at"), "record_id", ["loaded_at"]).drop("loaded_at") for x in (old, p.where("removed_at is null"))]
    return quality.snapshot_changes(*states, "record_id")


@R.add(f"""
with p as {_PLUGINS}
select 'plugins' table_name, record_id as key, c.n as "check" from p, lateral (values
  ('count not negative', files_inspected_count >= 0), ('known join', "join" in ('exact', 'directory_candidate', 'unmatched')),
  ('verdict spelled as normalized', verdict.raw = verdict.normalized), ('record key form', regexp_matches(record_key, '^chunk_[0-9]+:[0-9]+$')),
  ('evidence ids unique', len(evidence_ids) = len(list_distinct(evidence_ids)))) c(n, ok) where not coalesce(ok, false)""")
def record_shape_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Plugin records that break a check of their shape."""
    p = _plugins(spark, folder, "files_inspected_count", "join", "verdict", "record_key", "evidence_ids")
    return quality.violations(p, "plugins", F.col("record_id"), {
        "count not negative": F.col("files_inspected_count") >= 0,
        "known join": F.col("join").isin(JOINS),
        "verdict spelled as normalized": F.col("verdict.raw") == F.col("verdict.normalized"),
        "record key form": F.col("record_key").rlike("^chunk_[0-9]+:[0-9]+$"),
        "evidence ids unique": F.size("evidence_ids") == F.size(F.array_distinct("evidence_ids")),
    })


@R.add(f"""
with c as (select distinct record_id, correction_id from corrections where record_id is not null and correction_id is not null), n as (select record_id, count(*) n from c group by 1)
select p.record_id, case when n is null then 'historical' else 'corrected' end status, coalesce(n, 0) n_corrections, c.correction_id
from {_PLUGINS} p left join n using (record_id) left join c using (record_id)""")
def review_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Plugin records with the review status that follows from their corrections, one row a correction; records without one have one row.

    A record with a third of all corrections is split by the lookup.
    """
    c = load(spark, folder, "corrections").where("record_id is not null and correction_id is not null").select("record_id", "correction_id").distinct()
    p = load(spark, folder, "plugins").select("record_id").where("record_id is not null").distinct()
    state = p.join(c.groupBy("record_id").agg(F.count("*").alias("n")), "record_id", "left").select(
        "record_id", F.when(F.col("n").isNull(), "historical").otherwise("corrected").alias("status"), F.coalesce("n", F.lit(0)).alias("n_corrections")
    )
    told = skew.lookup_join(c, state, "record_id", "inner")
    return told.unionByName(state.where("n_corrections = 0"), allowMissingColumns=True).select("record_id", "status", "n_corrections", "correction_id")


@R.add("""
with d as (select a as date, count(*) added from (select record_id, cast(min(loaded_at) at time zone 'UTC' as date) a from plugins where record_id is not null group by 1) group by 1),
days as (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from d)
select cast(days.date as varchar) as date, coalesce(added, 0) added, sum(coalesce(added, 0)) over (order by days.date) total from days left join d using (date)""")
def catalog_growth(spark: SparkSession, folder: str) -> DataFrame:
    """New records and their running total for every day, gaps filled."""
    first = load(spark, folder, "plugins").where("record_id is not null").groupBy("record_id").agg(F.to_date(F.min("loaded_at")).alias("date"))
    return timeline.daily_series(first.groupBy("date").agg(F.count("*").alias("added"))).withColumn("date", F.col("date").cast("string"))


@R.add("""
with a as (select cast(min(loaded_at) at time zone 'UTC' as date) d from plugins where record_id is not null group by record_id),
b as (select cast(max(loaded_at) at time zone 'UTC' as date) d from plugins where record_id is not null group by record_id),
span as (select min(d) lo, max(d) hi from a), spanb as (select min(d) lo, max(d) hi from b),
p as (select g as date, (select count(*) from a where d <= g) total from (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) g from span)),
c as (select g as date, (select count(*) from b where d <= g) total from (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) g from spanb)),
h as (select p.date, p.total, c.total n, (select max(date) from p) l from p left join c using (date))
select cast(date as varchar) as date, case when n is null then 'missing' else 'changed' end problem from h where n is null or (date < l and n <> total)""")
def growth_continuity(spark: SparkSession, folder: str) -> DataFrame:
    """Where a growth series by last delivery fails to continue the one by first delivery."""
    p = load(spark, folder, "plugins").where("record_id is not null").groupBy("record_id").agg(F.to_date(F.min("loaded_at")).alias("a"), F.to_date(F.max("loaded_at")).alias("b"))
    series = [timeline.daily_series(p.groupBy(F.col(c).alias("date")).agg(F.count("*").alias("added"))) for c in ("a", "b")]
    return timeline.continuity(*series).withColumn("date", F.col("date").cast("string"))


@R.add("""
select plugin_id, record_id, epoch_us(loaded_at) valid_from, epoch_us(lead(loaded_at) over w) superseded_at from
(select plugin_id, record_id, min(loaded_at) loaded_at from plugins where plugin_id is not null and record_id is not null group by 1, 2)
window w as (partition by plugin_id order by loaded_at, record_id)""")
def listing_history(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each plugin in order, with the time at which the next one took over."""
    p = load(spark, folder, "plugins").where("plugin_id is not null and record_id is not null").groupBy("plugin_id", "record_id").agg(F.min("loaded_at").alias("valid_from"))
    held = timeline.with_neighbour(p, "plugin_id", F.date_trunc("month", "valid_from"), ["valid_from", "record_id"], {"valid_from": "superseded_at"}, 1)
    return held.select("plugin_id", "record_id", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("superseded_at").alias("superseded_at"))


@R.add("""
select source_id, n_files, n_bad, digest from (
  select distinct on (source_id) source_id, len(coalesce(files, [])) n_files,
    len(list_filter(coalesce(files, []), lambda f: not coalesce(regexp_matches(f.sha256, '^[0-9a-f]{64}$'), false))) n_bad,
    sha256(array_to_string(list_sort(list_transform(coalesce(files, []), lambda f: coalesce(f.sha256, '') || '  ' || coalesce(f.path, ''))), chr(10))) digest
  from sources where source_id is not null order by source_id, loaded_at desc)""")
def source_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Files of each source, those without a proper digest, and one digest over its sorted manifest."""
    files = F.coalesce("files", F.array().cast("array<struct<path:string,url:string,sha256:string>>"))
    s = load(spark, folder, "sources").select(
        "source_id", "loaded_at", F.size(files).alias("n_files"),
        F.size(F.filter(files, lambda f: ~F.coalesce(f["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False)))).alias("n_bad"),
        F.sha2(F.array_join(F.sort_array(F.transform(files, lambda f: F.concat(F.coalesce(f["sha256"], F.lit("")), F.lit("  "), F.coalesce(f["path"], F.lit(""))))), "\n"), 256).alias("digest"),
    )
    return latest(s, "source_id", ["loaded_at"]).drop("loaded_at")


@R.add("""
with p as (select distinct record_id a, record_key b from plugins where record_id is not null and record_key is not null)
select 'a' side, a as value, count(*) n from p group by 2 having count(*) > 1 union all select 'b', b, count(*) from p group by 2 having count(*) > 1""")
def record_keys_not_bijective(spark: SparkSession, folder: str) -> DataFrame:
    """Record ids with several record keys and record keys of several records."""
    return quality.not_bijective(load(spark, folder, "plugins"), "record_id", "record_key")
