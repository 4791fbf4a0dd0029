"""Sitemaps, links, robots rules and search results from bodies that a crawler has stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.functions.text import blank_to_null
from marram.functions.web import authority, url_path
from marram.operators.extraction import absolute, all_of

SUMMARY_FIELDS = ["bedrooms", "bathrooms", "price", "area", "operator"]


def sitemap_urls(bodies: DataFrame, child: str | None = None) -> DataFrame:
    """(source, url) of sitemap bodies (source, body): `<loc>` entries, else one URL a line; child keeps those containing it."""
    locations = all_of(F.col("body"), r"(?i)<loc>\s*([^<\s]+)\s*</loc>")
    lines = all_of(F.col("body"), r"(?m)^\s*(https?://\S+)\s*$")
    found = bodies.select("source", F.explode(F.when(F.size(locations) > 0, locations).otherwise(lines)).alias("url"))
    return found if child is None else found.where(F.contains(F.col("url"), F.lit(child)))


def page_links(pages: DataFrame, pattern: str = ".*") -> DataFrame:
    """Distinct (url, link): links of pages (url, html) as absolute URLs without query and fragment whose path fits a pattern."""
    links = pages.select("url", F.explode(all_of(F.col("html"), r"""(?i)<a\s[^>]*?href=["']([^"'#][^"']*)["']""")).alias("href"))
    link = F.regexp_extract(absolute("href", "url"), "^[^?#]*", 0)
    return links.select("url", link.alias("link")).where((F.col("link") != "") & url_path("link").rlike(pattern)).distinct()


def discovery_candidates(results: DataFrame, column: str = "result") -> DataFrame:
    """Search results (JSON) as url, title, published date and the allowed summary fields; rows without a URL dropped."""
    r = F.from_json(column, "url string, title string, publishedDate string, summary map<string,string>")
    rows = results.select(r.alias("r")).select("r.url", "r.title", F.col("r.publishedDate").alias("published"), F.map_filter("r.summary", lambda k, v: k.isin(SUMMARY_FIELDS)).alias("summary"))
    return rows.where(blank_to_null("url").isNotNull())


def robots_rules(bodies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From robots.txt bodies (host, body): disallowed prefixes (host, prefix) for any agent, crawl delays (host, delay) and
    sitemaps (host, url). Consecutive agent lines form one group."""
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = bodies.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line")).select("host", "pos", F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.substr(line, F.instr(line, ":") + 1)).alias("value")).where("value <> '' or key = 'disallow'")
    rows = rows.where(F.col("key").isin("user-agent", "disallow", "crawl-delay", "sitemap"))
    order = Window.partitionBy("host").orderBy("pos")
    agent = F.col("key") == "user-agent"
    starts = agent & F.coalesce(F.lag("key").over(order) != "user-agent", F.lit(True))
    grouped = rows.withColumn("g", F.sum(starts.cast("int")).over(order))
    any_agent = grouped.where(agent & (F.col("value") == "*")).select("host", "g").distinct()
    mine = grouped.join(any_agent, ["host", "g"], "left_semi")
    disallowed = mine.where("key = 'disallow' and value <> ''").select("host", F.col("value").alias("prefix")).distinct()
    delays = mine.where("key = 'crawl-delay'").groupBy("host").agg(F.max(F.col("value").try_cast("double")).alias("delay"))
    return disallowed, delays, grouped.where("key = 'sitemap'").select("host", F.col("value").alias("url")).distinct()


def robots_admission(urls: DataFrame, disallowed: DataFrame) -> DataFrame:
    """URLs that no disallowed prefix of their host covers."""
    rows = urls.withColumn("_host", authority("url"))
    blocked = rows.join(disallowed.withColumnRenamed("host", "_host"), "_host").where(F.startswith(url_path("url"), F.col("prefix"))).select("url").distinct()
    return urls.join(blocked, "url", "left_anti")


def geography_dim(spark: SparkSession, states: list[tuple[str, str, int, list[str]]]) -> DataFrame:
    """(state, name, launch_order, status, area, demand_rank): a row for each area of states (code, name, launch order, areas)."""
    rows = spark.createDataFrame(states, "state string, name string, launch_order int, areas array<string>")
    status = F.when(F.col("launch_order") <= 1, "LIVE").otherwise("PLANNED")
    return rows.select("state", "name", "launch_order", status.alias("status"), F.posexplode_outer("areas").alias("position", "area")).withColumn("demand_rank", (F.col("position") + 1) * 10).drop("position")
