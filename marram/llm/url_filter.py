"""URL filter rules as a sort-merge range join, with DataFrame functions only.

A rule (host, path) fits the host and its subdomains if the URL's path starts with the rule's. The canonical key of a rule
is its host's labels in reverse, a zero byte and its path; URLs that it fits are those whose key, cut to as many labels,
lies in the interval from the rule's key to that key followed by a byte that no UTF-8 text has. Intervals of rules are
nested or apart. The sorted sweep: rules give boundaries, each with the stack of rules active from there on; boundaries and
URL keys are range-partitioned and sorted together, every URL takes the stack of the last boundary before it, and a
partition takes over the last stack of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.common import free_name, materialise

# Fixed values: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: What a URL gets that no rule fits.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A byte that UTF-8 never has: behind every key that starts like the one before it.
_END = b"\xff"


def host_and_path(url):
    """Host (A-Z lower-cased) and path of a URL as two columns; both empty for null and without `://`."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _key(host, labels, path):
    """The key of a host cut to its last `labels` labels, and a path, as bytes."""
    reverse = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(F.slice(reverse, 1, labels), "."), F.lit("\x00"), path).cast("binary")


def _boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): from this key on, the stack of active rules, innermost last, each (length, rule, verdict)."""
    keyed = rules.select(_key(F.col("host"), F.col("labels"), F.col("path")).alias("key"), F.struct(F.length(F.concat("host", "path")).alias("length"), "rule", "verdict").alias("own"))
    keyed = keyed.groupBy("key").agg(F.min("own").alias("own"))  # of rules with one key, the first by name
    sizes = keyed.select(F.octet_length("key").alias("size")).distinct()
    # the rules around a rule are those whose key is one of its key's prefixes, of the lengths that occur
    inner = keyed.select(F.col("key").alias("inner"), "own")
    prefixes = inner.join(F.broadcast(sizes), F.col("size") < F.octet_length("inner")).select("inner", F.col("inner").substr(F.lit(1), F.col("size")).alias("key"))
    outer = prefixes.join(keyed, "key").groupBy("inner").agg(F.array_sort(F.collect_list("own")).alias("outer"))
    stacks = inner.join(outer, "inner", "left").withColumn("outer", F.coalesce("outer", F.array().cast("array<struct<length:int,rule:string,verdict:string>>")))
    opens = stacks.select(F.col("inner").alias("key"), F.concat("outer", F.array("own")).alias("stack"))
    return opens.union(stacks.select(F.concat("inner", F.lit(_END)), F.col("outer")))


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule (host and path of the longest rule that fits; else null) and verdict (the rule's, else default).

    rules has the columns verdict, host and path. Rules are compared by the length of host and path together; of two as
    long, the one with the longer host wins. A null URL, or one without `://`, has an empty host and path and fits no
    rule; rules with a null or empty host fit nothing. Repeated rows get the same result; columns of pages with the new
    names give way; no rows or no rules are fine.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    rules = rules.where("host <> ''").select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.select("verdict", "host", "path", F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.")).alias("labels"))
    depths = sorted(r[0] for r in rules.select("labels").distinct().collect())  # at most one for each label a host can have

    new = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in new]
    row, packed = free_name(pages, "row_key"), free_name(pages, "packed")
    host, path = host_and_path(F.col(f"`{url_col}`"))
    source = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(packed), F.monotonically_increasing_id().alias(row), host.alias("host"), path.alias("path"))
    source = materialise(source)  # read twice: row keys must not change
    labels = F.size(F.split("host", r"\."))
    if not depths:
        found = source.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
        return found.select(*[F.col(f"`{packed}`.`{c}`").alias(c) for c in kept], "host", "path", "rule", "verdict")
    # a URL has a key for each number of labels that rules have
    keys = F.array(*[F.when(labels >= d, _key(F.col("host"), F.lit(d), F.col("path"))) for d in depths])
    probes = source.where("host <> ''").select(F.explode(F.array_compact(keys)).alias("key"), F.lit(1).alias("kind"), row, F.lit(None).cast("array<struct<length:int,rule:string,verdict:string>>").alias("stack"))
    stops = _boundaries(rules).select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias(row), "stack")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row id lets a key that very many URLs share be dealt to several partitions
    dealt = materialise(probes.union(stops).repartitionByRange(n, "key", "kind", row).withColumn("part", F.spark_partition_id()))
    last = dealt.where("kind = 0").groupBy("part").agg(F.max(F.struct("key", "stack")).alias("last"))  # a row for each partition at most
    spans = dealt.select("part").distinct().join(F.broadcast(last), "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("part", F.last(F.col("last")["stack"], ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind", row).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").join(F.broadcast(carried), "part")
    stack = F.coalesce("active", "carried")
    best = swept.select(row, F.element_at(F.when(F.size(stack) > 0, stack), -1).alias("best")).where("best is not null")
    # the longest of the innermost rules; a longer host sorts last among rules as long, as its path is shorter
    best = best.groupBy(row).agg(F.max(F.struct(F.col("best")["length"], F.length(F.split(F.col("best")["rule"], "/")[0]), F.col("best")["rule"].alias("rule"), F.col("best")["verdict"].alias("verdict"))).alias("best"))
    found = source.join(best, row, "left")
    return found.select(*[F.col(f"`{packed}`.`{c}`").alias(c) for c in kept], "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(F.col("best")["verdict"], F.lit(default)).alias("verdict"))
