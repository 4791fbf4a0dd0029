"""Connected components of a graph of shared keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; one is made only where none is set and the master is
    local, as in tests: elsewhere executors would not see it, so that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="marram-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table below the checkpoint folder and read again. Unlike a checkpoint it forgets what the planner inferred about the
    columns, which in a loop of joins grows faster than the rounds."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are worth a task.
ROWS_PER_TASK = 100_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most about so many rows, in no more tasks than these are worth: else a round over few rows is mostly empty files."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, min(most, rows // ROWS_PER_TASK + 1)))


def star_edges(keys: DataFrame) -> DataFrame:
    """(a, b, key): from the least member of each shared key to the others; linear in the members of a key.

    keys has the columns node and key. The least member is an aggregate joined back, so that a key that very many share
    is a skewed join, which the adaptive planner splits, and not a window over all its rows."""
    least = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").drop("most")
    return keys.join(least, "key").where("node <> a").select("a", F.col("node").alias("b"), "key").distinct()


def min_label_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that can be reached over the edges (a, b), for every row of nodes (node).

    Each round takes the least label of the neighbours and then the label's own label, so paths halve. Rounds end when no
    label changes; it is an error, never a partial result, if max_rounds are not enough."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    both = checkpointed(both)
    n = both.count()
    both = few_tasks(both, n)
    labels = checkpointed(few_tasks(both.select(F.col("a").alias("node")).distinct(), n).withColumn("component", F.col("node")))
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = lower.join(jump, "component", "left").select("node", "old", F.least("component", "further").alias("component"))
        new = checkpointed(few_tasks(new, n))
        labels = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
