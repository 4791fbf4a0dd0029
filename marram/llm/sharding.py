"""Sharding by jump consistent hashing, with DataFrame functions only.

The shard of a key is found by the jumps of a linear congruential generator seeded with the key: no ring table, and when
one shard is added, a row either stays or goes to the new shard. All arithmetic is modulo 2**64, kept in two 32-bit halves,
since Spark's integers don't wrap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.common import broadcast_if_small, free_name, materialise

SHARDS = 8
# Fixed value: the generator's multiplier.
MULTIPLIER = 2862933555777941757
#: Jumps that are unrolled as one loop; beyond them, a loop of as many steps as there are shards finishes the rest.
USUAL_JUMPS = 64
_LOW = (1 << 32) - 1


def _times_plus_one(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of (hi, lo) * MULTIPLIER + 1 modulo 2**64; no product below exceeds 2**48."""
    m = [(MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    a, b = lo * m[0] + 1, lo * m[1]
    low = a + F.shiftleft(b.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(low, 32) + F.shiftright(b, 16)
    high = carry + lo * m[2] + F.shiftleft((lo * m[3]).bitwiseAND(0xFFFF), 16) + hi * m[0] + F.shiftleft((hi * m[1]).bitwiseAND(0xFFFF), 16)
    return high.bitwiseAND(_LOW), low.bitwiseAND(_LOW)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a long key. A null key counts as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))

    def jump(state: Column, _: Column) -> Column:
        hi, lo = _times_plus_one(state["hi"], state["lo"])
        # the next jump goes to floor((b + 1) * 2**31 / ((key >> 33) + 1))
        there = F.floor((state["j"] + 1).cast("double") * (float(1 << 31) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"), there.alias("j"))
        return F.when(state["j"] < shards, moved).otherwise(state)

    first = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(_LOW).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, USUAL_JUMPS))), first, jump)
    if shards > USUAL_JUMPS:
        state = F.when(state["j"] >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, jump))
    return state["b"].cast("int")


def assign_shards(df: DataFrame, shards: int = SHARDS, key_col: str = "doc_id") -> DataFrame:
    """df with law ('key'), shard, grown_shard (with one shard more) and slot, gapless from 0 within each shard.

    The key column and the number of shards alone decide the shard. Keys are longs; others are hashed to longs. Null keys
    count as 0. Slots number the rows of a shard in the order of the key, null first, whatever partitions they come in; rows of
    one key, which may be very many, are numbered in any order. Rows are range-partitioned by shard and key, and a partition's
    count of each shard gives the offset of the next, so no task sees more than one partition's rows, whatever key is
    frequent. Columns of df with the new names give way; no rows give no rows. df is shuffled and materialised: select
    what the shards need before.
    """
    new = {"law", "shard", "grown_shard", "slot"}
    kept = [c for c in df.columns if c.lower() not in new]
    key = F.col(f"`{key_col}`")
    if dict(df.dtypes)[key_col] not in {"tinyint", "smallint", "int", "bigint"}:
        key = F.when(key.isNotNull(), F.xxhash64(key))
    part, row = free_name(df, "part_id"), free_name(df, "row_id")
    placed = df.select(*[f"`{c}`" for c in kept], jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias(row))
    order = ["shard", f"`{key_col}`", row]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(placed.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    counts = placed.groupBy("shard", part).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row for each shard that a partition holds
    within = F.row_number().over(Window.partitionBy(part, "shard").orderBy(*order[1:])) - 1
    numbered = placed.withColumn("within", within).join(broadcast_if_small(offsets), ["shard", part])
    return numbered.select(*[f"`{c}`" for c in kept], F.lit("key").alias("law"), "shard", "grown_shard", (F.col("offset") + F.col("within")).alias("slot"))
