
from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marram.operators import entities, pricing, reports, search, upserts
from marram.operators.graph import checkpointed
from marram.plans import queries
from marram.plans.views import table, view

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def timed(name: str, rows: int, run, **more) -> None:
    began = time.time()
    extra = run()
    seconds = time.time() - began
    print(json.dumps({"job": name, "rows": rows, "seconds": round(seconds, 2), "rows_per_second": round(rows / seconds, 1)} | more | (extra or {})), flush=True)


def done(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    lines = table(spark, SF_DIR, "lineitem").select(F.lit("s").alias("source"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_listing_id"), F.col("l_shipdate").cast("date").alias("observed_on"), F.floor(F.col("l_extendedprice") * 100).cast("long").alias("advertised_price"), F.lit(1).alias("seq"))
    for n in (583, lines.count()):
        batch = checkpointed(lines.limit(n))
        empty = batch.limit(0).drop("seq")

        def twice(batch=batch, empty=empty):
            once = checkpointed(upserts.upsert_observations(empty, batch))
            again = upserts.upsert_observations(once, batch)
            return {"changed_by_second_run": reports.parity_check(once, again, once.columns).count()}

        timed("upsert, then again", n, twice)
    timed("change detection", table(spark, SF_DIR, "events").count(), lambda: done(queries.detect_changes(spark, SF_DIR)))
    listings = queries._full_listings(spark, SF_DIR)
    n = listings.count()
    timed("connected components", n, lambda: done(entities.resolve_operators(listings)))
    hot = listings.withColumn("phone", F.when(F.col("seq") % 10 == 0, F.lit("08030000000")).otherwise(F.col("phone")))
    timed("connected components, one key with a tenth of the rows", n, lambda: done(entities.resolve_operators(hot)))
    timed("search, a batch of queries", table(spark, SF_DIR, "supplier").count(), lambda: done(queries.search_batch(spark, SF_DIR)))
    charges = table(spark, SF_DIR, "lineitem").count()
    timed("quotes and splits", charges, lambda: done(pricing.compute_splits(queries._quotes(spark, SF_DIR), 150, 10_000, 200_000)))
    timed("page extraction", table(spark, SF_DIR, "pages").count(), lambda: done(queries.extract_listings(spark, SF_DIR)))
    units = view(spark, SF_DIR, "fx_units")
    centres = units.limit(1000).select(F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), F.lit(5.0).alias("q_radius"))
    timed("radius join of 1,000 centres", 1000, lambda: done(search.radius_join(units, centres)))


if __name__ == "__main__":
    main()
