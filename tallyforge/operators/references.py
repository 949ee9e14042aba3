"""References to records that are missing, deleted or not there yet.

Direct orphans come from one lookup of every reference; a fixpoint of semi-joins down the foreign-key graph then finds
the records that hang on an orphan.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.skew import lookup_join
from tallyforge.session import materialize

#: All white space at either end, also of other scripts.
_EDGES = r"(?U)^[\s﻿]+|[\s﻿]+$"


def plain_key(key: Column) -> Column:
    """A key trimmed and in lower case; empty keys become null."""
    text = F.lower(F.regexp_replace(key, _EDGES, ""))
    return F.when(text != "", text)


@dataclass(frozen=True)
class Reference:
    """One foreign key: column `field` of table `child` names the key of table `parent`; arrays hold many."""

    child: str
    field: str
    parent: str


def lifetimes(df: DataFrame, key: str) -> DataFrame:
    """Per key its arrival (earliest loaded_at) and removal (earliest removed_at, if there is one).

    Repeated deliveries are combined before the shuffle. Rows without a key are no records.
    """
    gone = F.min("removed_at") if "removed_at" in df.columns else F.lit(None).cast("timestamp")
    return (
        df.select(plain_key(F.col(key)).alias("ref_id"), *[c for c in ("loaded_at", "removed_at") if c in df.columns])
        .where("ref_id is not null")
        .groupBy("ref_id")
        .agg(F.min("loaded_at").alias("arrived"), gone.alias("removed"))
    )


def references_of(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per distinct (child, field, ref_id); null and empty references are none.

    Repeated deliveries of a child count once, with its earliest arrival. Array columns give one row per element.
    """
    kinds = dict(df.dtypes)
    arrays = F.array(*[
        F.struct(
            F.lit(f).alias("field"),
            (F.col(f) if kinds[f].startswith("array") else F.array(F.col(f))).alias("ids"),
        )
        for f in fields
    ])
    return (
        df.select(F.col(key).alias("child_id"), "loaded_at", F.explode(arrays).alias("_f"))
        .select("child_id", "loaded_at", F.col("_f.field").alias("field"), F.explode("_f.ids").alias("_id"))
        .withColumn("ref_id", plain_key(F.col("_id")))
        .where("ref_id is not null and child_id is not null")
        .groupBy("child_id", "field", "ref_id")
        .agg(F.min("loaded_at").alias("seen"))
    )


def direct_orphans(tables: dict[str, tuple[DataFrame, str]], graph: list[Reference]) -> DataFrame:
    """Every reference without a living target: child_table, child_id, field, ref_id, kind, arrived.

    tables maps a name to (rows, key column). kind is `missing` if the target has no row, `late` if it arrived after the
    child, `deleted` if it was removed at or before the child's arrival. A child with unknown arrival can only miss.
    """
    out = None
    lives = {name: lifetimes(*tables[name]) for name in {g.parent for g in graph}}
    for child in dict.fromkeys(g.child for g in graph):
        rows, key = tables[child]
        mine = [g for g in graph if g.child == child]
        arrivals = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("child_id")).agg(F.min("loaded_at").alias("child_arrived"))
        refs = references_of(rows, key, [g.field for g in mine]).join(arrivals, "child_id")
        refs = materialize(refs)
        for parent in dict.fromkeys(g.parent for g in mine):
            fields = [g.field for g in mine if g.parent == parent]
            found = lookup_join(refs.where(F.col("field").isin(fields)), lives[parent].withColumn("_known", F.lit(True)), "ref_id")
            kind = (
                F.when(F.col("_known").isNull(), "missing")
                .when(F.col("arrived") > F.col("child_arrived"), "late")
                .when(F.col("removed") <= F.col("child_arrived"), "deleted")
            )
            part = found.select(
                F.lit(child).alias("child_table"), "child_id", "field", F.lit(parent).alias("parent_table"), "ref_id",
                kind.alias("kind"), F.col("child_arrived").alias("arrived"),
            ).where("kind is not null")
            out = part if out is None else out.unionByName(part)
    return out


def orphan_cascade(tables: dict[str, tuple[DataFrame, str]], graph: list[Reference]) -> DataFrame:
    """All direct orphan references at depth 0, and at depth n the references to records orphaned at depth n - 1.

    Returns child_table, child_id, field, ref_id, kind, arrived, depth; kind is `inherited` from depth 1 on. A record is
    orphaned once, at its least depth, so cycles in the graph end. Each round is a semi-join of all references with the
    newly orphaned keys, written to the shared folder; rounds end when no new record is orphaned.
    """
    direct = materialize(direct_orphans(tables, graph).withColumn("depth", F.lit(0)))
    edges = None
    for child in dict.fromkeys(g.child for g in graph):
        rows, key = tables[child]
        mine = [g for g in graph if g.child == child]
        to = F.element_at(F.create_map(*[F.lit(x) for g in mine for x in (g.field, g.parent)]), F.col("field"))
        part = references_of(rows, key, [g.field for g in mine]).select(
            F.lit(child).alias("child_table"), "child_id", "field", to.alias("parent_table"), "ref_id", F.col("seen").alias("arrived")
        )
        edges = part if edges is None else edges.unionByName(part)
    parents = {g.parent for g in graph}
    edges = materialize(edges.where(F.col("parent_table").isin([p for p in parents if any(g.child == p for g in graph)])))
    node = [F.col("child_table").alias("parent_table"), plain_key(F.col("child_id")).alias("ref_id")]
    seen = frontier = direct.select(*node).distinct()
    out = direct.drop("parent_table")
    for depth in count(1):
        # a frontier key is unique and narrow; a hot parent is split by the lookup
        target = frontier.select(F.concat_ws("\u0001", "parent_table", "ref_id").alias("_key")).withColumn("_orphan", F.lit(True))
        hit = lookup_join(edges.withColumn("_key", F.concat_ws("\u0001", "parent_table", "ref_id")), target, "_key", "inner")
        hit = materialize(hit.select("child_table", "child_id", "field", "ref_id", F.lit("inherited").alias("kind"), "arrived", F.lit(depth).alias("depth")))
        if hit.isEmpty():
            break
        out = out.unionByName(hit)
        frontier = materialize(hit.select(*node).distinct().join(seen, ["parent_table", "ref_id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return out


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references by child table, field, month of arrival (UTC), kind and depth."""
    return (
        orphans.groupBy("child_table", "field", F.date_format("arrived", "yyyy-MM").alias("period"), "kind", "depth")
        .agg(F.count("*").alias("n_references"))
    )
