"""Intervals by key: counts of overlaps and overlapping pairs, without a row for each day or each pair that might be.

An interval is (key, begin, end), begin before end; its end belongs to what follows it. Days are cut into buckets, so that a key with very many intervals is many
tasks' work."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.package import ship

#: Days of a bucket: far above the length of a usual interval, so that few intervals lie in two.
BUCKET_DAYS = 64


def _valid(rows: DataFrame) -> DataFrame:
    return rows.where("key is not null and end > begin").select("id", "key", F.unix_date("begin").alias("b"), F.unix_date("end").alias("e"))


def overlap_totals(asked: DataFrame, others: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(id, n): how many of the others overlap each asked interval; both (id, key, begin date, end date). Intervals without any are
    left out, and so are those that are empty or lack a key or an end.

    What overlaps has begun before the end and has not ended by the begin, so n is a difference of two running counts over the
    key's sorted days: a sweep that makes no pair. Counts run within a bucket; those of the buckets before it are added from a small table."""
    theirs, mine = _valid(others), _valid(asked)
    # on one day ends come first, then questions, then begins
    events = (
        theirs.select("key", F.col("e").alias("day"), F.lit(0).alias("turn"), F.lit(-1).alias("step"), F.lit(None).cast(mine.schema["id"].dataType).alias("id"))
        .union(theirs.select("key", "b", F.lit(2), F.lit(1), F.lit(None).cast(mine.schema["id"].dataType)))
        .union(mine.select("key", "b", F.lit(1), F.lit(-1), "id"))
        .union(mine.select("key", "e", F.lit(1), F.lit(1), "id"))
    )
    events = events.withColumn("bucket", F.floor(F.col("day") / bucket_days).cast("int"))
    counted = F.when(F.col("turn") != 1, 1).otherwise(0)
    sums = [F.sum(F.when(F.col("step") == step, counted)) for step in (1, -1)]
    of_bucket = events.groupBy("key", "bucket").agg(*[s.alias(c) for s, c in zip(sums, ("begun", "ended"))])
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = of_bucket.select("key", "bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("begun", "ended")])
    within = Window.partitionBy("key", "bucket").orderBy("day", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = events.select("*", *[F.coalesce(s.over(within), F.lit(0)).alias(c) for s, c in zip(sums, ("begun", "ended"))]).where("turn = 1")
    known = run.join(before, ["key", "bucket"])
    value = F.when(F.col("step") == 1, F.col("begun") + F.col("begun_before")).otherwise(-(F.col("ended") + F.col("ended_before")))
    return known.groupBy("id").agg(F.sum(value).alias("n")).where("n > 0")


def _sweep(bucket_days: int):
    """Rows (key, bucket, b, e, side, id) sorted by the first three -> (left, right) of the pairs whose later begin lies in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, ([], [])  # of each side a heap of (end, id)
        left, right, kinds = [], [], None

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(left, kinds), pa.array(right, kinds)], ["left_id", "right_id"])
            left.clear(), right.clear()
            return batch

        for batch in batches:
            kinds = batch.column(5).type
            for key, bucket, b, e, side, id_ in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if (key, bucket) != at:
                    at, open_ = (key, bucket), ([], [])
                for heap in open_:
                    while heap and heap[0][0] <= b:
                        heapq.heappop(heap)
                if b // bucket_days == bucket:  # else it began earlier, and those that begin here will meet it
                    others = open_[1 - side]
                    mine, theirs = (left, right) if side == 0 else (right, left)
                    mine.extend([id_] * len(others))
                    theirs.extend(x for _, x in others)
                heapq.heappush(open_[side], (e, id_))
                if len(left) >= 4096:
                    yield out()
        if left:
            yield out()

    return run


def overlapping_pairs(left: DataFrame, right: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """(left_id, right_id): the intervals of one key that overlap; both (id, key, begin date, end date), ids of one type that sorts.

    An interval lies in each bucket that it touches. A bucket is read in the order of begins, with the intervals that are still open at hand; each newcomer
    is paired with the open ones of the other side, if it begins in the bucket, so a pair is told once. The rows that are made are the pairs; memory
    is what is open at one time."""
    ship(left.sparkSession)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = _valid(left).withColumn("side", F.lit(0)).union(_valid(right).withColumn("side", F.lit(1)))
    first, last = F.floor(F.col("b") / bucket_days), F.floor((F.col("e") - 1) / bucket_days)
    placed = both.withColumn("bucket", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    rows = placed.select("key", "bucket", "b", "e", "side", "id").repartition(tasks, "key", "bucket").sortWithinPartitions("key", "bucket", "b", "side")
    kind = left.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_sweep(bucket_days), f"left_id {kind}, right_id {kind}")
