"""Linked lists of records: roots, depths and faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialize


def faults(edges: DataFrame) -> DataFrame:
    """node, fault of nodes with several successors (`branch`) or predecessors (`merge`). edges: src, dst; nulls are no edges."""
    e = edges.where("src is not null and dst is not null").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit("branch").alias("fault"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit("merge").alias("fault"))
    return out.unionByName(into)


def positions(edges: DataFrame) -> DataFrame:
    """node, root, depth for every node of chains without faults; nodes on or behind a cycle have a null root and depth.

    Pointer doubling: each round doubles the distance that the pointers of unsettled nodes span, so chains of length n take
    log2 n equi-joins. A node is settled when its pointer meets a settled one; only unsettled nodes are joined again, and no
    two of them in a chain point to the same node, so a long chain makes no hot key. A round that settles nothing leaves
    cycles only. Each round is written to the shared folder.
    """
    back = edges.where("src is not null and dst is not null").select(F.col("dst").alias("node"), F.col("src").alias("up")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
    start = materialize(nodes.join(back, "node", "left"))
    settled = start.where("up is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    active = start.where("up is not null").select("node", "up", F.lit(1).alias("steps"))
    while True:
        known = settled.toDF("up", "_to", "_n").withColumn("_met", F.lit(True)).unionByName(active.toDF("up", "_to", "_n").withColumn("_met", F.lit(False)))
        moved = materialize(active.join(known, "up").select("node", F.col("_to").alias("up"), (F.col("steps") + F.col("_n")).alias("steps"), "_met"))
        some, all_ = moved.agg(F.bool_or("_met"), F.bool_and("_met")).first()
        if not some:
            break
        settled = settled.unionByName(moved.where("_met").select("node", F.col("up").alias("root"), F.col("steps").alias("depth")))
        active = moved.where("not _met").drop("_met")
        if all_:
            break
    return settled.unionByName(active.select("node"), allowMissingColumns=True)
