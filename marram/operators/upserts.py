"""Idempotent state tables: a batch is reduced to one row for each key by seq, then merged once with the state.

Each function returns the whole new state; writing it to a new path and switching to it makes a run all or nothing, and
merging the same batch twice changes nothing."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduce_batch(batch: DataFrame, keys: list[str], coalesced: list[str] = [], seq: str = "seq", firsts: list[str] = []) -> DataFrame:  # noqa: B006
    """One row for each key: the last value by seq; of `coalesced` columns the last that isn't null; of `firsts` the first."""
    rest = [c for c in batch.columns if c not in {*keys, seq}]
    last = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))) if c in coalesced else F.min_by(c, seq) if c in firsts else F.max_by(c, seq) for c in rest}
    return batch.groupBy(*keys).agg(*[v.alias(c) for c, v in last.items()])


def merge(state: DataFrame, batch: DataFrame, keys: list[str], *, coalesced: list[str] = [], kept: list[str] = [], seq: str = "seq") -> DataFrame:  # noqa: B006
    """state with the batch merged in by key: columns overwritten, but `coalesced` ones only by values, and `kept` ones never
    once set. Columns that only the state has stay as they are. A key with a null in it equals none.

    Keys are joined as one struct: where a key column is a constant on both sides, as the day of a run, the optimizer makes two different ones the
    condition false, and a full join by that compares all rows with all."""
    new = reduce_batch(batch, keys, coalesced, seq, kept)
    values = [c for c in state.columns if c not in keys]
    whole = F.when(reduce(and_, [F.col(k).isNotNull() for k in keys]), F.struct(*keys)).alias("_key")
    both = state.select("*", whole).join(new.select(whole, *[F.col(c).alias(f"new_{c}") for c in new.columns], F.lit(True).alias("_changed")), "_key", "full_outer")

    def pick(c: str):
        if c not in new.columns:
            return F.col(c)
        if c in kept:
            return F.coalesce(F.col(c), F.col(f"new_{c}")).alias(c)
        if c in coalesced:
            return F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c)
        return F.when(F.col("_changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[F.coalesce(k, f"new_{k}").alias(k) for k in keys], *[pick(c) for c in values]).select(*state.columns)


def upsert_listings(state: DataFrame, batch: DataFrame) -> DataFrame:
    """By source and listing id: first_seen stays, last_seen and facts are overwritten, links to operators and locations only
    by values, and the link to a property is never touched."""
    batch = batch.drop("property_id")
    return merge(state, batch, ["source", "source_listing_id"], coalesced=["operator_id", "location_id"], kept=["first_seen"])


def upsert_observations(state: DataFrame, batch: DataFrame) -> DataFrame:
    return merge(state, batch, ["source", "source_listing_id", "observed_on"])


def upsert_prices(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Only observations with a price."""
    return upsert_observations(state, batch.where("advertised_price is not null"))


def upsert_operators(state: DataFrame, batch: DataFrame, states: DataFrame) -> DataFrame:
    """By operator_key; contacts only by values; rows without a stated name or of unknown states are left out."""
    known = batch.where("display_name is not null").join(F.broadcast(states.select("state").distinct()), "state", "left_semi")
    return merge(state, known, ["operator_key"], coalesced=["phone", "email", "website", "instagram", "state"])


def upsert_locations(state: DataFrame, batch: DataFrame) -> DataFrame:
    return merge(state, batch, ["state", "slug"])


def upsert_registry_evidence(previous: DataFrame, probes: DataFrame) -> DataFrame:
    """New evidence of a source (key, robots, crawl_delay) beside the last human decision (status, reviewer, date,
    attribution, block reason); an unreviewed source gets a block reason; the crawl delay gives requests a minute."""
    decision = ["terms_status", "reviewed_by", "last_reviewed_at", "attribution", "blocked_reason"]
    joined = probes.join(previous.select("key", *[F.col(c).alias(f"old_{c}") for c in decision]), "key", "left")
    out = joined.select(*[c for c in probes.columns if c not in decision], *[F.col(f"old_{c}").alias(c) for c in decision])
    out = out.withColumn("rate_limit_per_minute", F.when(F.col("crawl_delay") > 0, F.floor(60 / F.col("crawl_delay")).cast("int")))
    return out.withColumns({"terms_status": F.coalesce("terms_status", F.lit("REVIEW_REQUIRED")), "blocked_reason": F.coalesce("blocked_reason", F.when(F.col("reviewed_by").isNull(), "not reviewed yet"))})
