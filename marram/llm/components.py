"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.common import materialise


def _with_least(rows: DataFrame, tasks: int) -> DataFrame:
    """rows (u, v) with m, the least v of each u. A minimum that is joined back is a skewed join for a u of very many rows; of
    one task's few rows all are in its one partition already, so there a window needs no exchange."""
    if tasks == 1:
        return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return rows.join(rows.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node links its larger neighbours to the least node of its neighbourhood. a > b in all edges."""
    both = edges.coalesce(tasks).select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    return _with_least(both, tasks).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them. a > b in all edges."""
    down = _with_least(edges.coalesce(tasks).toDF("u", "v"), tasks)
    # the least neighbour's own row is the one that links the node
    return down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


#: Edges that are worth a task.
EDGES_PER_TASK = 100_000


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its least node.

    Neighbourhoods are never gathered where there are edges for several tasks: a minimum by node, combined before the
    shuffle, is joined back, so a node with very many neighbours is a skewed join that the adaptive planner can split. Each round ends in a reliable
    checkpoint; the driver sees a count and a checksum. Loops (a = b) and repeated edges do no harm, rows with a
    null end are left out, and no edges give no rows. It takes about log n rounds; it is an error, never a partial
    result, if `rounds` don't suffice.
    """
    a, b = edges.columns[:2]
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    ends = materialise(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())  # with loops; what made the edges runs once
    edges, loops = ends.where("a <> b"), ends.where("a = b").select("a")

    def mark(df: DataFrame, tasks: int) -> tuple:
        return tuple(df.coalesce(tasks).agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before, tasks = mark(edges, most), most
    for _ in range(rounds):
        if not before[0]:
            break
        # few edges take few tasks: else a round's shuffles are thousands of files with next to nothing in them. What lies in
        # one partition is grouped and joined there without an exchange: each is a job and a thread of the driver
        tasks = min(most, before[0] // EDGES_PER_TASK + 1)
        edges = materialise(_small_star(_large_star(edges, tasks), tasks).coalesce(tasks).distinct().coalesce(tasks))
        after = mark(edges, tasks)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    edges = edges.coalesce(tasks)
    found = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component"))))).distinct()
    if loops.isEmpty():
        # the last edges lie in few partitions: dealt by node, so that a join of the result isn't one task's work
        return found.repartition("node")
    alone = loops.join(found, loops["a"] == found["node"], "left_anti")
    return found.union(alone.select("a", "a")).repartition("node")
