"""Near-duplicate documents by MinHash: universal hash minima, banding, signature verification, components.

Method. A document's set is its distinct word 5-shingles, hashed to 64 bits. 128 universal hash functions give its
signature; 32 bands of 4 minima give its buckets. At a similarity of 0.75 a pair misses all buckets with probability
(1 - 0.75**4)**32 = 5e-6. Equal sets are one node from the start. Within a bucket,

1. every node is compared with the bucket's least node (a star: as many pairs as members, never all pairs), first by the low
   bytes of their signatures, and by their sets only where these agree often enough;
2. buckets whose members are then in one component are done. The bucket is the unit of work for those left: its members
   are cut into blocks of bounded size, blocks are paired, and each pair of blocks is one bounded task that compares the
   low bytes of signatures and ties promising pairs of different components. Low bytes may show a common band too many, so
   a pair is met in the first BANDS_MET it seems to share; that so many false ones come before the first true one has a
   chance near 1e-8.
3. The promising nodes, tied into clusters, are cut into blocks again, now for each cluster once, and their sets are
   fetched: a task confirms promising pairs on whole signatures and sets and returns a spanning forest of its links.
   Blocks within one large component are not paired, so a large group of copies costs no more than its own size, and
   documents that share buckets by chance are never compared by their sets.

A pair whose signatures agree so rarely that a similarity of 0.75 is over 4.5 standard deviations away is skipped;
all others are confirmed on full sets with integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import broadcast_if_small, materialise, prepare
from marram.llm.components import connected_components
from marram.llm.words import SPACED, U, mix, pieces

SHINGLE = 5
HASHES = 128
ROWS = 4
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Common bands, as the low bytes show them, in which a pair is met.
BANDS_MET = 3
#: Members of a block; two blocks with their sets are what one task holds.
BLOCK = 512

_rng = np.random.default_rng(75_005)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _agreeing(percent: int) -> int:
    """Least number of equal minima of a pair worth confirming."""
    s = percent / 100
    return max(1, int(np.floor(HASHES * (s - 4.5 * np.sqrt(s * (1 - s) / HASHES)))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of a non-empty array of 64-bit hashes under each of the universal hash functions."""
    least = np.full(HASHES, 0xFFFFFFFF, U)
    for at in range(0, len(hashes), 256):
        part = hashes[at : at + 256]
        np.minimum(least, ((_A[:, None] * part + _B[:, None]) >> U(32)).min(1), out=least)
    return least.astype(np.uint32)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer than k words, one for them all."""
    for start, end, words in pieces(column, SPACED):
        grams, starts = words.grams(k)
        at = np.concatenate([[0], np.cumsum(starts)])[words.bounds]
        short = {}
        for length in range(1, k):
            grams_of, starts_of = words.grams(length)
            place = np.concatenate([[0], np.cumsum(starts_of)])[words.bounds]
            for i in np.flatnonzero(np.diff(words.bounds) == length):
                short[int(i)] = grams_of[place[i] : place[i + 1]]
        for i in range(end - start):
            yield short[i] if i in short else np.unique(grams[at[i] : at[i + 1]])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, signs, bands = [], [], [], []
        for hashes in shingle_sets(batch.column(1)):
            sizes.append(len(hashes))
            if not len(hashes):
                prints.append(None), signs.append(None), bands.append(None)
                continue
            signed = signature(hashes)
            prints.append(_print(hashes))
            signs.append(signed.tobytes())
            rows = signed.astype(U).reshape(-1, ROWS)
            key = np.arange(1, len(rows) + 1, dtype=U)
            for j in range(ROWS):
                key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, j])
            bands.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "print", "sign", "bands"],
        )


def _print(hashes: np.ndarray) -> bytes:
    """160 bits that tell sets apart: two sums over the set and its size."""
    return np.array([mix(hashes).sum(), mix(hashes ^ U(0xA5A5A5A5A5A5A5A5)).sum()], U).tobytes() + len(hashes).to_bytes(4, "little")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = 64  # small batches, as sets of long texts are large
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            sets = list(shingle_sets(part.column(1)))
            keep = pa.array([len(x) > 0 for x in sets], pa.bool_())
            sets = [x for x in sets if len(x)]
            signs = [signature(x) for x in sets]
            columns = [map(_print, sets), (x.tobytes() for x in signs), (x.astype(np.uint8).tobytes() for x in signs), (x.tobytes() for x in sets)]
            yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), *(pa.array(list(c), pa.binary()) for c in columns)], ["node", "print", "sign", "low", "set"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _hopeful(percent: int):
    """Of pairs (a, b, low_a, low_b) those whose low bytes agree as often as the minima of a link must."""
    least = _agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, HASHES) for i in (2, 3)]
            keep = pa.array((low[0] == low[1]).sum(1) >= least, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], ["a", "b"])

    return run


def _confirm(percent: int):
    least = _agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keep = []
            for sa, sb, a, b in zip(*(columns[c] for c in ("sign_a", "sign_b", "set_a", "set_b"))):
                agree = int((np.frombuffer(sa.as_buffer(), np.uint32) == np.frombuffer(sb.as_buffer(), np.uint32)).sum())
                keep.append(agree >= least and _linked(np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U), percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([columns["a"].filter(keep), columns["b"].filter(keep)], ["a", "b"])

    return run


_KEYS = ["bucket", "band", "i", "j"]  # of a task; after the first pass, bucket is a cluster and band is 0


def _each_task(judge):
    """Streams rows sorted by _KEYS, one task after another: judge(columns, key, from, to) gets numpy arrays of a few whole
    tasks and the place of one. A task is two blocks at most, so what waits for its end is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = {n: table.column(n).combine_chunks() for n in table.schema.names}
            columns = {n: c if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for n, c in columns.items()}
            name, kind = ("sign", np.uint32) if "sign" in columns else ("low", np.uint8)
            columns["minima"] = np.stack([np.frombuffer(x.as_buffer(), kind) for x in columns[name]])
            found = [judge(columns, tuple(columns[k][lo] for k in _KEYS), lo, hi) for lo, hi in zip(edges[:-1], edges[1:])]
            yield from (x for x in found if x is not None)

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            change = np.zeros(max(table.num_rows - 1, 0), bool)
            for k in _KEYS:
                column = table.column(k).to_numpy()
                change |= column[1:] != column[:-1]
            edges = np.concatenate([[0], np.flatnonzero(change) + 1])
            if len(edges) > 1:
                yield from done(table.slice(0, edges[-1]), edges)
            held = table.slice(edges[-1])
        if held is not None and held.num_rows:
            yield from done(held, np.array([0, held.num_rows]))

    return run


def _promising(columns: dict, key: tuple, lo: int, hi: int, least: int, met: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows, best first) of the pairs of a task whose minima agree in `least` places and that are in different
    components; with met, only those to which this bucket's band is one of the first `met` common ones."""
    block, component, minima = columns["block"], columns["component"], columns["minima"]
    left, right = lo + np.flatnonzero(block[lo:hi] == key[2]), lo + np.flatnonzero(block[lo:hi] == key[3])
    for i in left:
        others = right[right > i] if key[2] == key[3] else right
        others = others[component[others] != component[i]]
        if not len(others):
            continue
        same = minima[others] == minima[i]
        agree = same.sum(1)
        good = agree >= least
        if met is not None and good.any():
            common = same.reshape(len(others), -1, ROWS).all(2)
            good &= common[:, key[1]] & (common[:, : key[1]].sum(1) < met)
        good = np.flatnonzero(good)
        if len(good):
            yield i, others[good[np.argsort(-agree[good], kind="stable")]]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch | None:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], ["a", "b"]) if found else None


class _Forest:
    """Trees over numbers from 0 on."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were in two trees, which are one now."""
        x, y = self.find(x), self.find(y)
        self.parent[x] = y
        return x != y


def _ties(percent: int):
    """A spanning forest of a task's promising pairs."""
    least = _agreeing(percent)

    def judge(columns: dict, key: tuple, lo: int, hi: int) -> pa.RecordBatch | None:
        nodes, trees, out = columns["node"], _Forest(hi - lo), []
        for i, others in _promising(columns, key, lo, hi, least, BANDS_MET):
            out += [(nodes[i], nodes[j]) for j in others if trees.join(i - lo, j - lo)]
        return _edges(out)

    return _each_task(judge)


def _links(percent: int):
    """A spanning forest of a task's links between components."""
    least = _agreeing(percent)

    def judge(columns: dict, key: tuple, lo: int, hi: int) -> pa.RecordBatch | None:
        names, root = np.unique(columns["component"][lo:hi], return_inverse=True)
        trees = _Forest(len(names))
        sets = [np.frombuffer(x.as_buffer(), U) for x in columns["set"][lo:hi]]
        nodes, out = columns["node"], []
        for i, others in _promising(columns, key, lo, hi, least):
            for j in others:
                x, y = trees.find(root[i - lo]), trees.find(root[j - lo])
                if x != y and _linked(sets[i - lo], sets[j - lo], percent):
                    trees.join(x, y)
                    out.append((nodes[i], nodes[j]))
        return _edges(out)

    return _each_task(judge)


def _block_pairs(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """members (bucket, band, component, node) with their block, and the sides (bucket, band, i, j, block) of the pairs of
    blocks to compare.

    A component of over `block` members has blocks of its own; smaller ones share blocks by hash, whole."""
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= block).groupBy("bucket").agg(F.sum("n").alias("m"))
    sizes = sizes.join(small, "bucket", "left").select(
        "bucket", "component", (F.col("n") > block).alias("own"),
        F.ceil(F.when(F.col("n") > block, F.col("n")).otherwise(F.col("m")) / (block // 2)).alias("parts"),
    )
    spread = F.xxhash64(F.when(F.col("own"), F.col("node")).otherwise(F.col("component")))
    name = F.when(F.col("parts") == 1, F.lit(0)).otherwise(F.pmod(spread, F.col("parts")))
    placed = materialise(members.join(sizes, ["bucket", "component"]).select("bucket", "band", "component", "node", F.xxhash64(F.when(F.col("own"), F.col("component")), name).alias("block"), F.when(F.col("own"), F.col("component")).alias("large")))  # read three times: a plan with all of it three times over takes the driver's memory
    blocks = placed.select("bucket", "band", "block", "large").distinct()
    other = blocks.select("bucket", F.col("block").alias("j"), F.col("large").alias("large_j"))
    pairs = blocks.withColumnRenamed("block", "i").join(other, "bucket").where((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("large") == F.col("large_j"), F.lit(False)))
    return placed.drop("large", "band"), pairs.select(*_KEYS, F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))


def hopeful_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose signatures allow a link, by their low bytes: chance buckets end here, before any set or
    whole signature is shuffled. No link is lost, as equal minima have equal low bytes. sets: (node, low)."""
    low = [sets.select(F.col("node").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab"]
    sided = pairs.join(low[0], "a").join(low[1], "b").select("a", "b", "low_a", "low_b")
    return materialise(sided.mapInArrow(_hopeful(percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (least id reachable by links), kept (doc_id = component_id).

    Null and empty texts, and texts of white space, have the empty set: n_shingles 0, linked with nothing. A null id
    can't be a component's name: such a row gets component_id null, is kept, and links nothing. Repeated rows are
    returned as often as they come, each with the same result; rows that share an id but not a text are one node,
    linked by either text. Other columns of docs, whatever their names, are not read. No rows give no rows.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(source.mapInArrow(_sign, "doc_id long, n_shingles long, print binary, sign binary, bands array<long>"))
    with_id = signed.where("doc_id is not null and print is not null")
    classes = materialise(with_id.groupBy("print").agg(F.min("doc_id").alias("node")))

    reps = with_id.select("print", F.col("doc_id").alias("node"), "bands").join(classes, ["print", "node"], "left_semi")
    rows = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("anchor"), F.max("node").alias("last")).where("anchor <> last")
    members = materialise(rows.join(shared, "bucket").select("bucket", "band", "anchor", "node").distinct())

    wanted = materialise(members.select("node").distinct())
    texts = source.where("doc_id is not null").join(broadcast_if_small(wanted.withColumnRenamed("node", "doc_id")), "doc_id", "left_semi")
    # repeated rows are met once; of an id with several texts, each has its set
    sets = materialise(texts.mapInArrow(_sets, "node long, print binary, sign binary, low binary, set binary").dropDuplicates(["node", "print"]).drop("print"))

    star = members.where("node <> anchor").select(F.col("node").alias("a"), F.col("anchor").alias("b")).distinct()
    star = hopeful_pairs(star, sets, percent)
    star = star.join(sets.select(F.col("node").alias("a"), F.col("sign").alias("sign_a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("sign").alias("sign_b"), F.col("set").alias("set_b")), "b")
    links = materialise(star.mapInArrow(_confirm(percent), "a long, b long").distinct())

    labels = connected_components(links)
    named = members.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
    open_ = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    named = materialise(named.join(open_, "bucket", "left_semi"))
    in_tasks = lambda placed, sides, more: placed.join(sides, ["bucket", "block"]).join(more, "node").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    ties = in_tasks(*_block_pairs(named, block), sets.select("node", "low")).mapInArrow(_ties(percent), "a long, b long").distinct()
    clusters = connected_components(ties).withColumnRenamed("component", "bucket")
    hopeful = named.select("node", "component").distinct().join(clusters, "node").select("bucket", F.lit(0).alias("band"), "component", "node")
    more = in_tasks(*_block_pairs(materialise(hopeful), block), sets.drop("low")).mapInArrow(_links(percent), "a long, b long")

    final = connected_components(links.union(more)).toDF("node", "least")
    found = classes.join(final, "node", "left").select("print", F.coalesce("least", "node").alias("least"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce(F.col("least"), F.col("doc_id")))
    return (
        signed.select("doc_id", "n_shingles", "print")
        .join(found, "print", "left")
        .select("doc_id", "n_shingles", component.cast("long").alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    )
