"""All registries outside the llm subpackage, and the queries on the similarity of parts and on events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import chains, similarity, skew, stats, timeline
from tallyforge.plans import discussions, integrity, mining, problems, releases
from tallyforge.plans.registry import Registry
from tallyforge.session import materialize
from tallyforge.sources import load

R = Registry()


def registries() -> list[Registry]:
    """All registries of the core."""
    return [R, releases.R, integrity.R, discussions.R, mining.R, problems.R]


_TEXT = "lower(coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '') || ' ' || cast(p_size as varchar) || 'mm')"
_CLASSES = f"""
t as (select p_partkey k, list_sort(list_filter(list_transform(string_split(regexp_replace({_TEXT}, '[^a-z0-9+#.\\-]+', ' ', 'g'), ' '), lambda x: regexp_replace(x, '^[.\\-]+|[.\\-]+$', '', 'g')), lambda x: len(x) > 2)) ts from part),
c as (select ts, min(k) k, bool_or(k % 100 = 0) asked from t group by 1),
tf as (select k, token, count(*) tf from (select k, unnest(ts) token from c) group by 1, 2), d as (select token, count(*) df from tf group by 1), n as (select count(*) n from c),
raw as (select k, token, (1 + ln(tf)) * ln((n + 1) / (df + 1)) w from tf join d using (token), n),
v as (select k, token, round(w / sqrt(sum(w * w) over (partition by k)), 12) w from raw where w <> 0),
s as (select q.k query, m.k "match", round(sum(q.w * m.w), 6) sim from v q join v m using (token) where q.k in (select k from c where asked) and q.k <> m.k group by 1, 2),
nb as (select * from (select *, row_number() over (partition by query order by sim desc, "match") place from s where sim >= 0.075) where place <= 4)"""


def _part_text(stop_words: Sequence[str] = ()) -> Column:
    """The tokens of a part in order, with blanks between; null for a part without a size."""
    words = [F.coalesce(c, F.lit("")) for c in ("p_name", "p_brand", "p_type")]
    return F.array_join(F.sort_array(similarity.tokens(F.concat(*[x for w in words for x in (w, F.lit(" "))], F.col("p_size").cast("string"), F.lit("mm")), stop_words)), " ")


def _part_classes(spark: SparkSession, folder: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """ts, k, asked of the classes of parts with equal tokens: the least key, and whether any key divides by 100."""
    classes = load(spark, folder, "part").select("p_partkey", _part_text(stop_words).alias("ts")).groupBy("ts").agg(F.min("p_partkey").alias("k"), F.bool_or(F.col("p_partkey") % 100 == 0).alias("asked"))
    return materialize(classes.withColumn("ts", F.filter(F.split("ts", " "), lambda t: t != "")))


def _part_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.similar_texts(_part_classes(spark, folder), "k", "ts", "asked")


@R.add(f'with {_CLASSES} select query, "match", sim, place from nb')
def similar_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The four most similar classes of parts for every class whose key divides by 100, searched against all classes."""
    return _part_neighbours(spark, folder)


@R.add(f'with {_CLASSES} select least(query, "match") a, greatest(query, "match") b, max(round(sim, 4)) weight from nb group by 1, 2')
def similarity_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The undirected edges of similar_parts."""
    return similarity.undirected(_part_neighbours(spark, folder))


_STOP = ["the", "and", "for", "with", "small", "large"]


@R.add(f"""
with {_CLASSES.replace("len(x) > 2)", f"len(x) > 2 and x not in ({', '.join(repr(x) for x in _STOP)}))", 1).replace("where sim >= 0.075", "where sim + bonus >= 0.075").replace("order by sim desc", "order by sim + bonus desc").replace("from s where", "from (select s.*, case when a.cl = b.cl then 0.035 else 0 end bonus from s join cl a on a.k = query join cl b on b.k = s.match) where").replace("s as (select q.k", "cl as (select k, coalesce(list_filter(['gear', 'bolt', 'ring'], lambda w: list_contains(ts, w))[1], 'other') cl from c), s as (select q.k")}
select query, "match", round(sim + bonus, 6) sim, place from nb""")
def similar_parts_by_cluster(spark: SparkSession, folder: str) -> DataFrame:
    """As similar_parts, without stop words and with a bonus for parts of one cluster."""
    cluster = F.coalesce(F.get(F.filter(F.array(*[F.lit(x) for x in ("gear", "bolt", "ring")]), lambda w: F.array_contains("ts", w)), F.lit(0)), F.lit("other"))
    return similarity.similar_texts(_part_classes(spark, folder, _STOP), "k", "ts", "asked", cluster=cluster, bonus=0.035)


@R.add(f"""with {_CLASSES} select query node, string_agg("match" || ':' || cast(cast(round(sim, 2) as decimal(4,2)) as varchar), ' ' order by place) neighbours from nb group by 1""")
def nodes_with_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every asked class with its at most four neighbours and rounded similarities in one row."""
    near = _part_neighbours(spark, folder).select("query", F.struct("place", F.concat_ws(":", F.col("match").cast("string"), similarity.rounded(F.col("sim"), 2).cast("decimal(4,2)").cast("string")).alias("t")).alias("n"))
    return near.groupBy(F.col("query").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("n")), lambda n: n["t"]), " ").alias("neighbours"))


@R.add(f"""
with {_CLASSES}, e as (select least(query, "match") a, greatest(query, "match") b, max(round(sim, 4)) weight from nb group by 1, 2),
x as (select a node, weight from e union all select b, weight from e) select node, round(sum(weight), 4) degree from x group by 1""")
def similarity_degree(spark: SparkSession, folder: str) -> DataFrame:
    """The weighted degree of every class of parts in the similarity graph."""
    return similarity.weighted_degree(similarity.undirected(_part_neighbours(spark, folder)))


_CLUSTERS = {"round": ["ring", "wheel", "bolt"], "flat": ["plate", "panel", "widget"], "toothed": ["gear", "cog"]}
_SCORE = {c: " + ".join(f"(case when contains(' ' || lower(p_name) || ' ' || lower(p_type) || ' ', '{w}') then 1 else 0 end + case when contains(lower(p_name), '{w}') then 2.5 else 0 end)" for w in ws) for c, ws in _CLUSTERS.items()}


@R.add(f"""
with s as (select {', '.join(f'{x} as s_{c}' for c, x in _SCORE.items())} from part)
select case when greatest(s_round, s_flat, s_toothed) = 0 then 'other' when s_round >= s_flat and s_round >= s_toothed then 'round' when s_flat >= s_toothed then 'flat' else 'toothed' end cluster, count(*) n from s group by 1""")
def keyword_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by the cluster with the best keyword score; the first one wins ties."""
    p = load(spark, folder, "part").select("p_name", "p_type")
    return p.groupBy(similarity.best_cluster(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name"), _CLUSTERS).alias("cluster")).agg(F.count("*").alias("n"))


@R.add("""
with recursive h(k, v, s) as (select p_partkey, cast(0 as bigint), p_name from part union all select k, (v * 31 + ascii(s)) & 4294967295, s[2:] from h where len(s) > 0)
select k p_partkey, v h, upper(regexp_extract(p_name, '^[^a-zA-Z0-9]*([a-zA-Z0-9])', 1) || regexp_extract(p_name, '^[^a-zA-Z0-9]*[a-zA-Z0-9]+[^a-zA-Z0-9]+([a-zA-Z0-9])', 1)) initials
from h join part on k = p_partkey where len(s) = 0""")
def name_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The 32-bit polynomial hash of part names and their initials."""
    return load(spark, folder, "part").select("p_partkey", T.hash31(F.col("p_name")).alias("h"), T.initials(F.col("p_name")).alias("initials"))


@R.add("select event_type, count(*) n_instances, count(distinct user_id) n_entities from events group by 1")
def events_and_users(spark: SparkSession, folder: str) -> DataFrame:
    """Events and distinct users per type."""
    return stats.instances_and_entities(load(spark, folder, "events").select("event_type", "user_id"), ["event_type"], "user_id")


@R.add("""
select user_id, epoch_us(date_trunc('second', e.ts)) ts_us, max((select count(*) from events x where x.user_id = e.user_id and date_trunc('second', x.ts) between date_trunc('second', e.ts) - interval 1 second and date_trunc('second', e.ts))) n
from events e group by 1, 2 having n > 1""")
def ambiguous_events(spark: SparkSession, folder: str) -> DataFrame:
    """Moments at which a user has more than one event within a second."""
    found = timeline.ambiguous_moments(load(spark, folder, "events").select("user_id", "ts"), "user_id", "ts")
    return found.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "n")


@R.add("""
with s as (select event_type, date_trunc('second', ts) t, count(*) n from events group by 1, 2)
select a.event_type, epoch_us(a.t) ts_us, cast(sum(b.n) as bigint) n from s a join s b on a.event_type = b.event_type and b.t between a.t - interval 30 second and a.t group by 1, 2 having sum(b.n) > 1""")
def busy_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Moments with more than one event of a type within half a minute."""
    found = timeline.ambiguous_moments(load(spark, folder, "events").select("event_type", "ts"), "event_type", "ts", 30)
    return found.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "n")


@R.add("select event_id, event_type, lag(event_type) over w before, epoch_us(lag(ts) over w) before_us from events window w as (partition by user_id order by ts, event_id)")
def previous_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the one before it of the same user."""
    e = load(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    held = timeline.with_neighbour(e, "user_id", F.to_date("ts"), ["ts", "event_id"], {"event_type": "before", "ts": "before_ts"}, -1)
    return held.select("event_id", "event_type", "before", F.unix_micros(F.col("before_ts").cast("timestamp")).alias("before_us"))


@R.add("select distinct on (user_id) user_id, event_id, event_type from events order by user_id, ts desc, event_id desc")
def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user."""
    e = load(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return timeline.latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@R.add("select distinct on (user_id, event_type) user_id, event_type, event_id from events order by user_id, event_type, ts, event_id")
def first_event_of_type(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each user and type."""
    e = load(spark, folder, "events")
    return e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@R.add("""
with o as (select o_orderkey k, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) p, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 depth,
  first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) root, count(*) over (partition by o_custkey) n from orders)
select k node, root, depth from o where n > 1""")
def order_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as a linked list: the first order and the distance from it, by pointer doubling."""
    o = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    linked = timeline.with_neighbour(o, "o_custkey", F.year("o_orderdate"), ["o_orderdate", "o_orderkey"], {"o_orderkey": "dst"}, 1)
    return chains.positions(linked.where("dst is not null").select(F.col("o_orderkey").alias("src"), "dst"))


@R.add("""
select o_orderkey, count(l_orderkey) n_lines, min(l_linenumber) first_line, max(l_linenumber) last_line, cast(coalesce(sum(cast(l_extendedprice as decimal(14,2)) * (1 - cast(l_discount as decimal(4,2)))), 0) as double) revenue
from orders left join lineitem on o_orderkey = l_orderkey group by 1""")
def orders_with_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every order with the number, first, last and revenue of its line items. Lines are added up before the join."""
    l = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"),
        F.sum(F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("r"),
    )
    o = load(spark, folder, "orders").select("o_orderkey")
    return o.join(l, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), "first_line", "last_line", F.coalesce("r", F.lit(0.0)).alias("revenue"))


@R.add("select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 place from lineitem where l_orderkey is not null")
def lines_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item with its place in its order: the lines of an order as rows, so an order of any size is spread."""
    l = load(spark, folder, "lineitem").where("l_orderkey is not null").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("l_linenumber") / 10_000).alias("b"))
    return skew.bucketed_sequence(l, "l_orderkey", "b", ["l_linenumber", "l_partkey"], "place").drop("b")


@R.add(f"""
with {_CLASSES}, e as (select least(query, "match") a, greatest(query, "match") b, max(round(sim, 4)) weight from nb group by 1, 2),
x as (select a node, weight from e union all select b, weight from e), g as (select node, round(sum(weight), 4) degree from x group by 1),
m as (select t.k p_partkey, c.k node from t join c using (ts))
select p_partkey node, round(4 * coalesce(degree, 0) + 2.4 * log2(coalesce(p_size, 0) + 1), 4) influence from part left join m using (p_partkey) left join g using (node)""")
def part_influence(spark: SparkSession, folder: str) -> DataFrame:
    """The influence of every part: its class's degree in the graph of similar_parts, and its size on a log scale."""
    classes = _part_classes(spark, folder)
    degrees = materialize(similarity.weighted_degree(similarity.undirected(similarity.similar_texts(classes, "k", "ts", "asked"))))
    found = materialize(classes.join(skew.broadcast_if_small(degrees), F.col("k") == F.col("node")).select(F.array_join("ts", " ").alias("ts"), "degree"))
    parts = load(spark, folder, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey").isNotNull(), _part_text()).alias("ts"))
    few = skew.broadcast_if_small(found)  # few classes have an edge: then parts stay where they are
    joined = skew.lookup_join(parts, found, "ts") if few is found else parts.join(few, "ts", "left")
    return joined.select(F.col("p_partkey").alias("node"), similarity.influence_of(F.col("degree"), F.col("p_size")).alias("influence"))


@R.add("""
with m as (select *, case when lag(o_orderkey) over w is null or lag(o_orderstatus) over w is distinct from o_orderstatus then o_orderdate end moved from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_orderkey, epoch_us(max(moved) over (partition by o_custkey order by o_orderdate, o_orderkey)) changed_us from m""")
def status_since(spark: SparkSession, folder: str) -> DataFrame:
    """For each order the time since which its customer's orders have had the same status."""
    o = load(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    held = timeline.since_change(o, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", F.year("o_orderdate"))
    return held.select("o_orderkey", F.unix_micros(F.col("changed_at").cast("timestamp")).alias("changed_us"))


@R.add("select event_type, event_id, place from (select event_type, event_id, row_number() over (partition by event_type order by ts, event_id) place from events) where place <= 25")
def first_events(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 events of each type."""
    e = load(spark, folder, "events").select("event_type", "ts", "event_id")
    return skew.first_rows(e, "event_type", ["ts", "event_id"], 25).select("event_type", "event_id", "place")
