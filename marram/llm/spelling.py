"""Spelling variants: words one edit apart, found by a frontier of states that descends a distributed trie level by level.

The trie is path-compressed: its nodes are the branching prefixes, its edges are rows (node, first character, label, child).
It is built from the root down. Each level groups the words of a node by their next character; a group of several words becomes a
node at the end of their common prefix, a single word becomes a leaf. Along the way every word leaves its states without
an edit. Where a word meets another edge of its node, one character is replaced, inserted or deleted; the states that come of this,
(word, position, node, edits = 1), are joined with the edges again and again until they end in leaves: the neighbours.

Near the root a trie branches at every character. So the first edit is taken only behind the first half of a word, and a second trie of
the reversed words serves the other half; every pair differs first in the second half of one of the two readings.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marram.llm.common import broadcast_if_small, materialise, prepare, remove_folder, shared_dir

#: The root node; other nodes are named by the least id of a word below them, and their depth.
ROOT = -1
#: Rows of a level that are worth a task.
ROWS_PER_TASK = 50_000
EDGE = "node long, depth int, ch string, label string, child long, child_depth int, leaf long"
STATE = "id long, word string, half int, node long, depth int"
FOUND = "id long, word string, pos int, node long, depth int, leaf long"


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """The length of the common prefix, in code points."""
    return pd.Series([len(commonprefix(pair)) for pair in zip(a, b)], dtype="int32")


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_TASK + 1))


def _build(words: DataFrame, base: str) -> None:
    """Writes the edges and the states without an edit below base, a folder for each level. words: (id, word, half)."""
    spark = words.sparkSession
    words.select("id", "word", "half", F.lit(ROOT).cast("long").alias("node"), F.lit(0).alias("depth")).write.parquet(f"{base}/states/level=0")
    level = 0
    while rows := (states := spark.read.schema(STATE).parquet(f"{base}/states/level={level}")).count():
        tasks = _tasks(spark, rows)
        states = states.withColumn("ch", F.expr("substring(word, depth + 1, 1)"))
        groups = states.groupBy("node", "depth", "ch").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.min("word").alias("low"), F.max("word").alias("high")).coalesce(tasks)
        # equal ends are one word: most groups need no Python
        several = groups.where("n > 1").withColumn("child_depth", _common("low", "high"))
        both = several.union(groups.where("n = 1").withColumn("child_depth", F.char_length("low")))
        leaf = F.when(F.col("n") == 1, F.col("first"))
        edges = both.select("node", "depth", "ch", F.expr("substring(low, depth + 1, child_depth - depth)").alias("label"), F.col("first").alias("child"), F.col("child_depth").cast("int").alias("child_depth"), leaf.alias("leaf"))
        edges.write.parquet(f"{base}/edges/level={level}")
        inner = spark.read.schema(EDGE).parquet(f"{base}/edges/level={level}").where("leaf is null").select("node", "depth", "ch", "child", "child_depth")
        down = states.join(broadcast_if_small(inner), ["node", "depth", "ch"]).select("id", "word", "half", F.col("child").alias("node"), F.col("child_depth").alias("depth"))
        level += 1
        down.coalesce(tasks).write.parquet(f"{base}/states/level={level}")


def _edit(base: str, spark: SparkSession) -> DataFrame:
    """(id, leaf): words and the words one edit from them, where the first difference lies at `half` of the word or behind it."""
    edges = spark.read.schema(EDGE).parquet(f"{base}/edges")
    states = spark.read.schema(STATE).parquet(f"{base}/states").where("depth >= half")
    meet = states.join(edges, ["node", "depth"]).where("ch <> substring(word, depth + 1, 1)").withColumns({"rest": F.expr("substring(word, depth + 1)"), "m": F.char_length("label")})
    meet = meet.withColumns({"rest1": F.expr("substring(rest, 2)"), "label1": F.expr("substring(label, 2)")})
    # what is left of the word must go on with what is left of the label, and end with it at a leaf
    fits = "CASE WHEN leaf IS NULL THEN startswith({0}, {1}) ELSE {0} = {1} END"
    ways = F.expr(
        f"""filter(array(
        CASE WHEN ch <> '' AND rest <> '' AND {fits.format("rest1", "label1")} THEN depth + m END,
        CASE WHEN ch <> '' AND {fits.format("rest", "label1")} THEN depth + m - 1 END,
        CASE WHEN rest <> '' AND {fits.format("rest1", "label")} THEN depth + m + 1 END), x -> x IS NOT NULL)"""
    )
    first = meet.select("id", "word", F.explode(ways).alias("pos"), F.col("child").alias("node"), F.col("child_depth").alias("depth"), "leaf")
    first.write.parquet(f"{base}/found/step=0")
    step = 0
    while rows := (open_ := spark.read.schema(FOUND).parquet(f"{base}/found/step={step}").where("leaf is null").drop("leaf")).count():
        rest = F.expr("substring(word, pos + 1)")
        ahead = open_.withColumn("ch", F.expr("substring(word, pos + 1, 1)")).join(edges, ["node", "depth", "ch"]).withColumn("rest", rest)
        ahead = ahead.where(fits.format("rest", "label")).select("id", "word", (F.col("pos") + F.char_length("label")).alias("pos"), F.col("child").alias("node"), F.col("child_depth").alias("depth"), "leaf")
        step += 1
        ahead.coalesce(_tasks(spark, rows)).write.parquet(f"{base}/found/step={step}")
    return spark.read.schema(FOUND).parquet(f"{base}/found").where("leaf is not null").select("id", "leaf")


def near_words(words: DataFrame, folder: str | None = None) -> DataFrame:
    """(id, near): ids of different words that differ by exactly one inserted, deleted or replaced code point, in both directions.

    words: (id long, word), ids and words unique and not null; no rows give no rows, and the empty word is a word. Memory is bounded
    by words, not by nodes: a node has at most one edge for each character. The number of rounds is the
    depth of the compressed trie, at most the length of the longest prefix that two words share. The tries and states are
    written below folder, a new one of the shared folder by default, from which the result is read.
    """
    spark = words.sparkSession
    prepare(spark)
    base = folder or f"{shared_dir(spark)}/spelling-{uuid.uuid4().hex}"
    if words.isEmpty():
        return spark.createDataFrame([], "id long, near long")
    half = F.floor(F.char_length("word") / 2).cast("int")
    _build(words.select("id", "word", half.alias("half")), f"{base}/forward")
    _build(words.select("id", F.reverse("word").alias("word"), (F.char_length("word") - half).alias("half")), f"{base}/backward")
    return _edit(f"{base}/forward", spark).union(_edit(f"{base}/backward", spark)).toDF("id", "near").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root): the last word that is reached from id by following forms (id, form). Each round doubles the length of the
    path that was followed; counts at least double from a word to its form, so paths are short and have no loops."""
    reached = materialise(forms.toDF("id", "root"))
    while True:
        ahead = reached.select(F.col("id").alias("root"), F.col("root").alias("further"))
        joined = materialise(reached.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        reached = joined.select("id", "root")
        if joined.where("moved").isEmpty():
            return reached


def spelling_variants(counts: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of counts (word, n) that have least_length code points and occur
    least_count times.

    n_near counts the other such words at one edit. form is the near word with the largest n, of several the first in code-point
    order, if that n is at least ratio times the word's (form_n, else both null); root is what following forms ends
    at, the word itself without a form. ratio must be 2 or more, so that paths end. Repeated words are added up, null words and
    null counts are left out, other columns are ignored; no rows give no rows. Words may be of any length.
    """
    if ratio < 2:
        raise ValueError("a ratio under 2 lets forms run in circles")
    spark = counts.sparkSession
    kept = counts.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    kept = kept.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))
    folder = f"{shared_dir(spark)}/spelling-{uuid.uuid4().hex}"
    kept.select(F.monotonically_increasing_id().alias("id"), "word", "n").write.parquet(f"{folder}/words")
    words = spark.read.schema("id long, word string, n long").parquet(f"{folder}/words")
    near = near_words(words.select("id", "word"), folder)
    others = words.select(F.col("id").alias("near"), F.struct((-F.col("n")).alias("minus"), "word", "id").alias("other"))
    best = near.join(others, "near").groupBy("id").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    rows = words.join(best, "id", "left")
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    rows = materialise(rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form")))
    remove_folder(spark, folder)
    roots = _roots(rows.where("form is not null").select("id", "form.id"))
    named = roots.join(rows.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return rows.join(named, "id", "left").select("word", F.col("form.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", (-F.col("form.minus")).alias("form_n"))


#: Words in lower-cased UTF-8: ASCII letters, and U+00C0 to U+00FF, whose first byte is C3.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Different words that a task counts before it hands them on.
COUNTED = 1 << 17


def _slipped(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text is None:
                    continue
                start = None if id_ is None else zlib.crc32(f"{id_}:".encode())
                for word, n in Counter(_RUN.findall(text.lower())).items():  # of bytes, lower() takes A-Z alone
                    if start is not None and (h := zlib.crc32(word, start)) % every == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    counts[word] += n
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    return run


def slipped_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """(word, n): how often each word occurs in the whole texts, after slips of the pen that are drawn by a hash.

    Words are maximal runs of ASCII letters and U+00C0 to U+00FF, with only A-Z lower-cased. Where `every` divides the CRC-32 of
    `<id>:<word>`, the code point at that CRC modulo the word's length is deleted, which may leave the empty word; a row without an id has no
    slips. Null texts have no words. A task counts the words of its texts before they are shuffled."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return source.mapInArrow(_slipped(every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
