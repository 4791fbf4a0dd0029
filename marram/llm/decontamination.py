"""Benchmark decontamination: windows of test items looked up in every window of the training texts.

A window is 10 consecutive words of an item; an item of fewer words, but not none, is one window. Windows are hashed
to 64 bits and broadcast as a sorted hash set when their rows, one for each window and item that has it, are at most
MAX_WINDOWS with MAX_BYTES of words and ids in all; beyond that, windows of texts and items meet in a shuffled join. Either way a hit counts only if the words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.common import extend, free_name, materialise, prepare
from marram.llm.words import ALNUM, U, Words, pieces

WINDOW = 10
#: Broadcast bounds: rows of a window and an item that has it, and bytes of their words and ids.
MAX_WINDOWS = 300_000
MAX_BYTES = 64 << 20

_COLUMNS = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>, clean_text string"


def _windows(lengths: list[int] | None, whole_short: bool):
    """(id, length, start, hash, words) of the windows of each text. whole_short: texts of under WINDOW words are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, words in pieces(batch.column(1), ALNUM):
                counts = np.diff(words.bounds)
                owner = np.repeat(np.arange(end - start), counts)
                for k in lengths or range(1, WINDOW + 1):
                    hashes, starts = words.grams(k)
                    at = np.flatnonzero(starts)
                    if whole_short and k < WINDOW:
                        keep = counts[owner[at]] == k
                        hashes, at = hashes[keep], at[keep]
                    for lo in range(0, len(at), 4096):
                        part = at[lo : lo + 4096]
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).take(pa.array(start + owner[part])),
                                pa.array(np.full(len(part), k), pa.int32()),
                                pa.array(part - words.bounds[owner[part]], pa.int32()),
                                pa.array(hashes[lo : lo + 4096].view(np.int64)),
                                pa.array([b" ".join(words.text(i, i + k)) for i in part], pa.binary()),
                            ],
                            ["id", "length", "start", "hash", "words"],
                        )

    return run


class _Index:
    """The windows by length: sorted hashes behind a bit filter, and what each hash stands for."""

    def __init__(self, rows: list) -> None:
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[tuple[int, bytes], list[str]] = {}
        hashes: dict[int, set[int]] = {}
        for r in rows:
            names = self.items.setdefault((r["length"], bytes(r["words"])), [])
            if r["id"] is not None:
                names.append(r["id"])
            hashes.setdefault(r["length"], set()).add(r["hash"] & (2**64 - 1))
        for k, found in hashes.items():
            found = np.array(sorted(found), U)
            sieve = np.zeros(1 << 20, bool)
            sieve[(found & U(0xFFFFF)).astype(np.int64)] = True
            self.by_length[k] = (found, sieve)

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of every place where a window stands."""
        for k, (found, sieve) in self.by_length.items():
            hashes, starts = words.grams(k)
            maybe = np.flatnonzero(sieve[(hashes & U(0xFFFFF)).astype(np.int64)])
            if not len(maybe):
                continue
            near = np.minimum(np.searchsorted(found, hashes[maybe]), len(found) - 1)
            maybe = maybe[found[near] == hashes[maybe]]
            places = np.flatnonzero(starts)[maybe]
            for p in places.tolist():
                items = self.items.get((k, b" ".join(words.text(p, p + k))))
                if items is not None:
                    yield p, k, items


def _without(words: Words, data: bytes, base: int, spans: list[tuple[int, int]], first: int) -> str:
    """The text without the bytes from the first to the last word of each span."""
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : words.starts[first + a] - base])
        at = int(words.ends[first + b - 1] - base)
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def _scan(index):
    def make(column: pa.Array) -> list[pa.Array]:
        n_words, n_hit, items, spans, clean = [], [], [], [], []
        for start, end, words in pieces(column, ALNUM):
            mark = np.zeros(len(words.starts) + 1, np.int64)
            met: dict[int, set[str]] = {}
            hits = list(index.value.hits(words))
            for p, k, names in hits:
                mark[p] += 1
                mark[p + k] -= 1
                owner = int(np.searchsorted(words.bounds, p, "right")) - 1
                met.setdefault(owner, set()).update(names)
            hit = np.cumsum(mark[:-1]) > 0
            before = np.concatenate([[0], np.cumsum(hit)])
            n_words += np.diff(words.bounds).tolist()
            n_hit += np.diff(before[words.bounds]).tolist()
            for i in range(end - start):
                if i not in met:
                    items.append([]), spans.append([]), clean.append(None)
                    continue
                a, b = words.bounds[i], words.bounds[i + 1]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
                own = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                text = column[start + i].as_py().encode()
                base = int(words.origin[i])
                items.append(sorted(met[i]))
                spans.append([{"start": x, "stop": y} for x, y in own])
                clean.append(_without(words, text, base, own, a))
        return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(clean, pa.string())]

    return make


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (length, hash, words, id): the windows of the items, each with every id, as a string, that it comes from."""
    prepare(items.sparkSession)
    source = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInArrow(_windows(None, True), "id string, length int, start int, hash long, words binary")
    return rows.select("length", "hash", "words", "id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (ids of the items met, sorted as strings), spans of hit words, clean_text and contaminated.

    clean_text is the text without its hit spans, from the first to the last character of each; without a hit it is the
    text. Drop documents with `contaminated`, or keep clean_text. A null text has no words and stays null; texts and
    items without words hit nothing. A null item id marks words but is named nowhere. Repeated items count once by id;
    repeated documents each get their row. Columns of docs with the new names give way to them. Empty tables of either
    kind work.
    """
    windows = materialise(benchmark_windows(items, item_id_col, item_text_col))
    size = windows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("id"), F.lit(0))), F.lit(0)).alias("bytes")).first()
    if size["rows"] <= max_windows and size["bytes"] <= max_bytes:
        found = extend(docs, text_col, _COLUMNS, _scan(docs.sparkSession.sparkContext.broadcast(_Index(windows.collect()))))
        found = found.withColumn("clean_text", F.coalesce("clean_text", F.col(f"`{text_col}`")))
    else:
        found = _by_join(docs, windows, text_col)
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _by_join(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """The same by a shuffled join of all windows, for more windows than can be broadcast. Items are named from rows, so no
    window carries a list of them; a row's own list is part of the result."""
    row = free_name(docs, "row_key")
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()))  # read twice: row keys must not change
    source = keyed.select(F.col(row).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    lengths = [r[0] for r in windows.select("length").distinct().collect()]
    met = source.mapInArrow(_windows(lengths, False), "id long, length int, start int, hash long, words binary").join(windows.drop("id").distinct(), ["length", "hash", "words"])
    words_hit = met.select("id", F.explode(F.expr("sequence(start, start + length - 1)")).alias("word")).distinct()
    word_window = Window.partitionBy("id").orderBy("word")
    runs = words_hit.withColumn("run", F.col("word") - F.row_number().over(word_window)).groupBy("id", "run").agg(F.min("word").alias("a"), F.max("word").alias("b"), F.count("*").alias("n"))
    runs = runs.groupBy("id").agg(F.sum("n").alias("hit"), F.sort_array(F.collect_list(F.struct(F.col("a").alias("start"), (F.col("b") + 1).alias("stop")))).alias("found_spans"))
    of_items = windows.where("id is not null").withColumnRenamed("id", "item")
    named = met.select("id", "length", "hash", "words").distinct().join(of_items, ["length", "hash", "words"]).select("id", "item").distinct().groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("found_items"))
    per_row = runs.join(named, "id", "left").withColumnRenamed("id", row)
    base = extend(keyed, text_col, "n_words long", lambda column: [pa.array(sum((np.diff(w.bounds).tolist() for _, _, w in pieces(column, ALNUM)), []), pa.int64())])
    joined = base.join(per_row, row, "left")
    out = [c for c in joined.columns if c.lower() not in {"n_hit", "items", "spans", "clean_text", row, "hit", "found_spans", "found_items"}]
    spans = F.coalesce("found_spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)"))
    joined = joined.select(*[f"`{c}`" for c in out], F.coalesce("hit", F.lit(0)).alias("n_hit"), F.coalesce("found_items", F.expr("cast(array() as array<string>)")).alias("items"), spans.alias("spans"))
    return joined.withColumn("clean_text", _cut(f"`{text_col}`", "spans"))


def _cut(text: str, spans: str):
    """The text without its spans of words, as a column: words and what stands between them, taken apart and put together."""
    word = r"[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
    words, gaps = f"regexp_extract_all({text}, '{word}', 0)", f"split({text}, '{word}', -1)"
    joined = f"""array_join(transform({gaps}, (g, i) -> concat(
        CASE WHEN i > 0 AND NOT exists({spans}, s -> s.start <= i - 1 AND i - 1 < s.stop) THEN element_at({words}, i) ELSE '' END,
        CASE WHEN exists({spans}, s -> s.start < i AND i < s.stop) THEN '' ELSE g END)), '')"""
    return F.expr(f"CASE WHEN size({spans}) = 0 THEN {text} ELSE {joined} END")
