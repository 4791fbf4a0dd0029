"""A corpus pipeline of four stages; each reads the documents that the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import bpe, language_id
from marram.llm.common import broadcast_if_small, materialise, shared_dir
from marram.llm.decontamination import decontaminate
from marram.llm.minhash_dedup import near_duplicates

#: A document whose best language has a lower pooled probability is rejected, as is one without a letter.
LEAST_SCORE = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _packed(docs: DataFrame) -> DataFrame:
    """docs as (row, text): all other columns in a struct, so that none of them can clash with an operator's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").alias("text"))


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language can be told, as they are; repeated ones each stay.

    Null texts, and texts without a letter, go, as do those whose best language stays under LEAST_SCORE. Without a labelled
    row to learn from, only texts without a letter go; no rows give no rows."""
    model = language_id.fit(docs)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.identify(_packed(docs), model)
    return _unpacked(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id.

    Of rows that repeat a doc_id one stays, the one with the least text; a null text gives way to any other. Rows without a doc_id can't be named and stay, as do
    texts without words, which are nobody's duplicates; no rows give no rows."""
    gone = materialise(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    left = docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    repeated = broadcast_if_small(repeated)
    again = _packed(left.join(repeated, "doc_id", "left_semi").select(*docs.columns))
    once = again.groupBy("row.doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("no_text"), "text", "row")).alias("first")).select("first.text", "first.row")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(_unpacked(once, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, as they are; repeated ones each stay, and so do null and
    empty texts. An empty benchmark drops nothing; no rows give no rows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unpacked(decontaminate(_packed(docs), items).where(~F.col("contaminated")), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids (little-endian unsigned 32-bit integers), their number, and digests of ids and decoded text.
    A null text counts as empty; every row is encoded, repeated ones too; no rows give no rows."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.round_trip(docs.select("doc_id", "text"), path)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
