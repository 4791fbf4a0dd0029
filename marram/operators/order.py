"""Global order at scale: ranks without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.operators.graph import checkpointed


def with_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its rank from 1 on in this order, in partitions that are ranges of it, each sorted.

    Rows are dealt by ranges and counted for each; a row of counts for each partition gives where it begins. The order should end in a
    unique column, or ties are ranked anyhow. No rows give no rows."""
    if not df.columns:
        return df
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # the number of a row within its partition; the checkpoint fixes both
    dealt = checkpointed(dealt.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    begins = F.broadcast(counts.select("_part", before.alias("_begin")))
    rank = F.col("_begin") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("_part", part).join(begins, "_part").select(*df.columns, rank.alias(name))
