"""Listing records, ledgers, directories, pages and registries in files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.facts import describe_factually
from marram.functions.text import blank_to_null
from marram.operators.history import listing_history
from marram.operators.order import with_rank
from marram.operators.reports import directory_counts
from marram.schemas import LISTING, OBSERVATION, PLACE, REGISTRY, names


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of Spark's own file systems."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).collect()
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def read_listing_records(spark: SparkSession, path: str, form: str = "lines") -> tuple[DataFrame, DataFrame]:
    """Listings of JSON lines, an array ('array') or a published document ('places'), and one row of counts (total, unusable).

    `source` and the listing's id are recovered from an id `source:id`; rows without an id or a URL are unusable; a missing
    name is made of facts."""
    one = f"id string, seq_in long, {LISTING.replace('seq long, ', '')}"
    if form == "places":
        rows = spark.read.schema(f"places array<struct<{one.replace(' string', ': string').replace(' long', ': long').replace(' int', ': int').replace('media array', 'media: array')}>>").option("multiLine", True).json(path).select(F.inline("places"))
    else:
        rows = spark.read.schema(one).option("multiLine", form == "array").json(path)
    rows = rows.withColumn("seq", F.coalesce("seq_in", F.monotonically_increasing_id()))
    has_colon = F.contains(F.col("id"), F.lit(":"))
    rows = rows.withColumns(
        {
            "source": F.coalesce(blank_to_null("source"), F.when(has_colon, F.split_part("id", F.lit(":"), F.lit(1)))),
            "source_listing_id": F.coalesce(blank_to_null("source_listing_id"), F.when(has_colon, F.substr("id", F.instr("id", ":") + 1)), blank_to_null("id")),
            "property_name": F.coalesce(blank_to_null("property_name"), describe_factually("bedrooms", "property_type", "area", "city")),
            "currency": F.coalesce("currency", F.lit("NGN")),
        }
    )
    usable = blank_to_null("source_listing_id").isNotNull() & blank_to_null("source_url").isNotNull()
    counts = rows.agg(F.count("*").alias("total"), F.count_if(~usable).alias("unusable"))
    return rows.where(usable).select(*names(LISTING)), counts


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The history of an append-only ledger of JSON lines or of a partitioned table; order doesn't matter, blank lines are
    skipped, the currency is NGN where none is given."""
    rows = spark.read.schema(OBSERVATION).json(path).where("source is not null and source_listing_id is not null")
    rows = rows.withColumns({"currency": F.coalesce("currency", F.lit("NGN")), "seq": F.coalesce("seq", F.monotonically_increasing_id())})
    return listing_history(rows)


def append_ledger(observations: DataFrame, path: str, run: str | None = None) -> None:
    """Adds observations to a ledger, a folder of JSON lines for each day. With a run's name it has a folder for each run, and a run
    that is written again replaces what it wrote before."""
    if run is None:
        observations.write.mode("append").partitionBy("observed_on").json(path)
    else:
        observations.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "observed_on").json(path)


def ordered_ledger(history: DataFrame) -> DataFrame:
    """A history in the ledger's order, with rank from 1 on: by day, source and listing."""
    return with_rank(history, F.col("observed_on"), F.col("source"), F.col("source_listing_id"))


def read_directory(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Published places, and whether the directory was there; a missing or malformed one is empty."""
    from marram.operators.validation import validate_places

    empty = spark.createDataFrame([], PLACE)
    if not _exists(spark, path):
        return empty, False
    raw = spark.read.schema(PLACE).option("mode", "DROPMALFORMED").json(path)
    return validate_places(raw)[0].select(*names(PLACE)), True


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Page bodies as (url, html): a table, or HTML files whose path is the URL."""
    if form == "parquet":
        return spark.read.parquet(path)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The source registry, a JSON list or {"sources": []}; an absent file is empty, so nothing is permitted."""
    if not _exists(spark, path):
        return spark.createDataFrame([], REGISTRY)
    document = spark.read.text(path, wholetext=True)
    one = REGISTRY.split("robots struct<")
    inner = one[1].split(">, reviewedBy")[0]
    fields = (one[0] + "reviewedBy" + REGISTRY.split("reviewedBy")[1]).replace(" string", ": string")
    schema = f"array<struct<{fields.rstrip(', ')}, robots: struct<{inner}>>>"
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.get_json_object("value", "$.sources"))
    return document.select(F.inline(F.from_json(listed, schema))).select(*names(REGISTRY))


def write_registry(registry: DataFrame, path: str) -> None:
    """In the order of keys, so that equal registries give equal files."""
    registry.orderBy("key").coalesce(1).write.mode("overwrite").json(path)  # some dozens of sources


def write_directory(places: DataFrame, path: str) -> None:
    """places in their order and, beside them, the counts; the same places and day give the same files."""
    ordered = places.orderBy(F.col("contact_route.kind") == "NONE", "id")
    ordered.write.mode("overwrite").json(f"{path}/places")
    directory_counts(places).write.mode("overwrite").json(f"{path}/counts")


def write_document(places: DataFrame, path: str) -> None:
    """places and their counts as one JSON document, a line for each place: the same places give the same bytes, however they are
    partitioned.

    Places are sorted and written in parallel, as ranges; then their files are put together in order, between the document's head and tail, in a
    hidden file that takes the document's place by one rename. The driver passes the bytes on in small pieces and holds none of them."""
    spark = places.sparkSession
    counts = directory_counts(places).select(F.to_json(F.struct("*")).alias("c")).first().c
    ranked = with_rank(places.select(*names(PLACE)), F.col("contact_route.kind") == "NONE", F.col("id"))
    line = F.concat(F.when(F.col("rank") == 1, " ").otherwise(","), F.to_json(F.struct(*names(PLACE))))
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    ranked.select(line.alias("value")).write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    files, target = at(path).getFileSystem(conf), at(path)
    hidden = at(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex}")
    out = files.create(hidden, True)
    try:
        out.write(bytearray(f'{{"counts":{counts},"places":[\n'.encode()))
        for f in sorted((f.getPath() for f in files.listStatus(at(parts))), key=lambda p: p.getName()):
            if f.getName().startswith("part-"):
                source = files.open(f)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
        out.write(bytearray(b"]}\n"))
    finally:
        out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    context.rename(files.makeQualified(hidden), files.makeQualified(target), overwrite)
    files.delete(at(parts), True)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The places of a document of write_document; its lines are read in parallel."""
    lines = spark.read.text(path).where(F.substring("value", 1, 2).isin(" {", ",{"))
    return lines.select(F.from_json(F.substr("value", F.lit(2)), PLACE).alias("p")).select("p.*")


def write_leads(leads: DataFrame, path: str) -> None:
    leads.write.mode("overwrite").json(path)
