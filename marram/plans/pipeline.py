"""The whole run: pages to listings, operators, changes, state tables, leads and the public directory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.functions.text import stable_id
from marram.operators.entities import funnel, observed_rates, operator_profiles, profiles_to_leads, resolve_operators
from marram.operators.extraction import extract_listings
from marram.operators.graph import checkpointed
from marram.operators.history import change_summary, detect_changes, listing_history
from marram.operators.leads import assess_leads, call_list, market_benchmark
from marram.operators.publish import build_directory
from marram.operators.upserts import upsert_observations
from marram.operators.validation import ingest_report, validate_listings


@dataclass
class Run:
    """What a run gives; every part is a DataFrame."""

    listings: DataFrame
    rejected: DataFrame
    report: DataFrame
    profiles: DataFrame
    funnel: DataFrame
    changes: DataFrame
    summary: DataFrame
    ledger: DataFrame
    leads: DataFrame
    calls: DataFrame
    directory: DataFrame


def run_pipeline(pages: DataFrame, ledger: DataFrame, day: str, attribution: str) -> Run:
    """pages (seq, url, html) of one day against a ledger of earlier days. Changes are taken before the ledger is merged, or the
    run would be compared with itself."""
    return run_listings(extract_listings(pages), ledger, day, attribution)


def run_listings(listings: DataFrame, ledger: DataFrame, day: str, attribution: str) -> Run:
    """The same from extracted listings. They are computed once, as six parts read them, in no fewer partitions than there are cores: what is
    made of them is more work than they are bytes."""
    cores = listings.sparkSession.sparkContext.defaultParallelism
    listings = checkpointed(listings.repartition(cores) if listings.rdd.getNumPartitions() < cores else listings)
    accepted, rejected = validate_listings(listings)
    resolved = checkpointed(resolve_operators(accepted))
    profiles = checkpointed(operator_profiles(resolved, with_lists=False))
    current = accepted.select("source", "source_listing_id", F.lit(day).cast("date").alias("observed_on"), "advertised_price", "seq")
    current = listing_history(current)
    changes = detect_changes(ledger, current, day)
    leads = profiles_to_leads(profiles, f"{day} 00:00:00")
    assessed = assess_leads(leads, market_benchmark(leads, observed_rates(resolved)), F.lit(f"{day} 00:00:00").cast("timestamp"))
    return Run(
        listings=accepted.withColumn("listing_pk", stable_id("listing", "source", "source_listing_id")), rejected=rejected, report=ingest_report(listings), profiles=profiles, funnel=funnel(accepted, profiles), changes=changes,
        summary=change_summary(changes), ledger=upsert_observations(ledger, current), leads=leads, calls=call_list(assessed), directory=build_directory(accepted, day, attribution),
    )
