"""Token counts with a digest cache: a content that was counted once under a tokenizer is never encoded again.

The cache is a folder of Parquet files of (content, n_tokens), one subfolder for each tokenizer digest. `content` is the
SHA-256 of a text's UTF-8 bytes, a null text being the empty one; nothing else is normalised, as any other change may change
the count. The tokenizer digest covers the bytes of the vocabulary file and the rule of counting, so that another file or
another rule never meets old counts. Only rows of digests are compared with the cache, and only texts that miss it are
shuffled, one of each content.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm.bpe import Bpe
from marram.llm.common import broadcast_if_small, extend, free_name, materialise

#: Part of the tokenizer digest: to be raised when counting changes for the same file.
RULE = "1"
STORED = "tokenizer string, content binary, n_tokens long"


def _counter(content: bytes, kind: str):
    """texts -> their numbers of tokens, by the vocabulary file of this content."""
    if kind == "model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    try:
        own = Bpe(content.decode())
        return lambda texts: [len(own.encode(t)) // 4 for t in texts]
    except (ValueError, KeyError, AttributeError):  # settings that bpe doesn't know: the library counts, several times slower
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(content.decode())
        library.no_truncation()
        library.no_padding()
        return lambda texts: [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


_loaded: dict = {}


def _load(broadcast, digest: str, kind: str):
    """The counter of a broadcast file; a worker makes it once."""
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = _counter(broadcast.value, kind)
    return _loaded[digest]


def tokenizer_digest(content: bytes) -> str:
    return hashlib.sha256(RULE.encode() + b"\n" + content).hexdigest()


def _stored(spark: SparkSession, cache: str, digest: str) -> DataFrame:
    """(content, n_tokens) of the cache, each content once: two runs may have appended the same one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "content binary, n_tokens long")
    rows = spark.read.schema(STORED).parquet(cache).where(F.col("tokenizer") == digest)
    return rows.groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, text_col: str = "text") -> DataFrame:
    """docs with n_bytes (of the UTF-8 text) and n_tokens (the library's count for the vocabulary file, without special tokens
    added; special strings in a text count as the library takes them by default).

    vocabulary: a file on the driver, `.model` for sentencepiece, else of the tokenizers library; it is broadcast, as it doesn't grow
    with the data. cache: a folder that driver and executors share; it is made if absent. Contents that it lacks are encoded,
    each once, and appended before the result is read; a run that fails before that leaves the cache as it was, and one that
    appends what another appended too does no harm.

    A null text counts as empty: 0 bytes, 0 tokens. Every row and other column passes through, repeated rows too; columns of docs
    with the new names give way. No rows give no rows and append nothing. Texts are whole, of any length.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        content = f.read()
    digest, kind = tokenizer_digest(content), "model" if vocabulary.endswith(".model") else "json"
    shipped = spark.sparkContext.broadcast(content)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    print_ = F.unhex(F.sha2(text, 256))

    texts = docs.select(print_.alias("content"), text.alias("text"))
    stored = _stored(spark, cache, digest)
    misses = materialise(texts.select("content").distinct().join(stored.select("content"), "content", "left_anti"))
    if not misses.isEmpty():
        # duplicates go before and after the shuffle, so a text that fills a third of the rows crosses it once for each task
        missed = texts.join(broadcast_if_small(misses), "content", "left_semi").dropDuplicates(["content"])

        def make(column: pa.Array) -> list[pa.Array]:
            return [pa.array(_load(shipped, digest, kind)(column.to_pylist()), pa.int64())]

        counted = extend(missed, "text", "n_tokens long", make).select(F.lit(digest).alias("tokenizer"), "content", "n_tokens")
        counted.write.mode("append").partitionBy("tokenizer").parquet(cache)
    key = free_name(docs, "content_print")
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens")]
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], size.alias("n_bytes"), print_.alias(key))
    # the rows of a hot content are a skewed join's streamed side, which the adaptive planner splits; counts are unique
    counts = _stored(spark, cache, digest).select(F.col("content").alias(key), "n_tokens")
    return rows.join(counts, key, "left").select(*[F.col(f"`{c}`") for c in kept], "n_bytes", "n_tokens")
