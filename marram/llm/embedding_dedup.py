"""Near-duplicate vectors by binary codes of a random rotation with stored correction factors.

A vector of unit length is rotated at random and coded by its signs. With f, the inner product of the rotated vector and
its code, kept beside the code, <q, code> / f estimates the inner product with any q without bias, and its error stays
within EPSILON * sqrt((1 - f^2) / f^2 / (D - 1)) but for a chance below one in a million. A query is kept in one byte for
each dimension, and what the rounding took from it, the sum of its errors, is a second correction factor that widens the bound.

Equal vectors are one node with a weight. The nodes of a label are dealt into blocks of bounded size, and each pair of
blocks is a task, twice. The first time it holds codes, rounded queries and factors, and tells which nodes have a partner whose
upper bound, by the estimates of both sides, reaches the threshold. The second time it holds the vectors of just these
nodes and computes in double precision, so that no link rests on an estimate. A task returns a line for each node that has
links there: how many, and the least node it is joined with in this task. So a label's pairs are compared but never made rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import materialise, prepare
from marram.llm.components import connected_components

THRESHOLD = 0.93
EPSILON = 5.0
#: Nodes of a block.
BLOCK = 2048
#: Pairs recomputed at once.
PAIRS_AT_ONCE = 1 << 15


@lru_cache(4)
def rotation(size: int) -> np.ndarray:
    """A random rotation, the same for the same size."""
    q, r = np.linalg.qr(np.random.default_rng(10_000 + size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows brought to unit length; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction factors of unit vectors (rows)."""
    return _encode(x @ rotation(x.shape[1]).T)


def _encode(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(1) / np.sqrt(y.shape[1])


def rounded(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors (rows) in signed bytes, the unit of each, and the sum of the absolute errors of each."""
    unit = np.abs(y).max(1) / 127
    q = np.rint(y / unit[:, None])
    return q.astype(np.int8), unit, np.abs(y - q * unit[:, None]).sum(1)


def _estimates(y: np.ndarray, loss: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated vectors y (rows), each short of the truth by errors of the sum `loss`, with coded
    ones (columns), and the bound of each error."""
    size = y.shape[1]
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1
    share = 1 / (np.sqrt(size) * factors)
    found = y.astype(np.float32) @ (signs * share[:, None]).astype(np.float32).T
    bound = EPSILON * np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / max(1, size - 1)) + loss[:, None] * share
    return found, bound.astype(np.float32) + np.float32(1e-5)


def estimates(q: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit vectors q (rows) with coded ones (columns), and the bounds of the errors."""
    return _estimates(q @ rotation(q.shape[1]).T, np.zeros(len(q)), codes, factors)


def estimates_of_rounded(q: np.ndarray, unit: np.ndarray, loss: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of queries as `rounded` gives them."""
    return _estimates(q * unit[:, None], loss, codes, factors)


_CODE = pa.struct([("code", pa.binary()), ("query", pa.binary()), ("factor", pa.float64()), ("unit", pa.float64()), ("loss", pa.float64())])
_CODED = "vec_id long, label string, key binary, size int, vector binary, code struct<code:binary,query:binary,factor:double,unit:double,loss:double>"


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            n = part.num_rows
            vectors: list = [None] * n
            keys, sizes, raw, codes = [None] * n, [None] * n, [None] * n, [None] * n
            for i, (label, v) in enumerate(zip(part.column(1), part.column(2))):
                if label.is_valid and v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy()
                    if np.isfinite(x).all() and x.any():
                        vectors[i] = x + 0  # -0.0 becomes 0.0
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(vectors):
                if x is not None:
                    by_size.setdefault(len(x), []).append(i)
            for size, own in by_size.items():
                y = _units(np.stack([vectors[i] for i in own]).astype(np.float64)) @ rotation(size).T
                bits, f = _encode(y)
                for i, b, q, *factors in zip(own, bits, *(lambda q, unit, loss: (q, f, unit, loss))(*rounded(y))):
                    data = vectors[i].astype(np.float64).tobytes() if vectors[i].dtype != np.float32 else vectors[i].tobytes()
                    label = part.column(1)[i].as_py().encode()
                    keys[i] = hashlib.blake2b(len(label).to_bytes(4, "little") + label + data, digest_size=16).digest()
                    sizes[i], raw[i], codes[i] = size, data, {"code": b.tobytes(), "query": q.tobytes(), **dict(zip(("factor", "unit", "loss"), map(float, factors)))}
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary()), pa.array(codes, _CODE)],
                ["vec_id", "label", "key", "size", "vector", "code"],
            )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component under the pairs (a, b) of nodes 0 to n - 1."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _candidates(threshold: float):
    """The nodes of two blocks that may have a partner there, from codes alone."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes, queries = (np.stack([np.frombuffer(c, kind) for c in rows[name]]) for name, kind in (("code", np.uint8), ("query", np.int8)))
        factor, unit, loss = (rows[c].to_numpy() for c in ("factor", "unit", "loss"))
        block = rows["block"].to_numpy()
        left, right = np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3])
        met = np.zeros(len(rows), bool)
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            found, bound = estimates_of_rounded(queries[own], unit[own], loss[own], codes[right], factor[right])
            back, wide = estimates_of_rounded(queries[right], unit[right], loss[right], codes[own], factor[own])
            near = (found + bound >= threshold) & (back + wide >= threshold).T
            near &= own[:, None] != right
            met[own] |= near.any(1)
            met[right] |= near.any(0)
        return pd.DataFrame({"label": key[0], "size": key[1], "i": key[2], "j": key[3], "block": block[met], "node": rows["node"].to_numpy()[met]})

    return run


def _compare(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        size = int(rows["size"].iloc[0])
        kind = np.float32 if len(rows["vector"].iloc[0]) == 4 * size else np.float64
        units = _units(np.stack([np.frombuffer(v, kind) for v in rows["vector"]]).astype(np.float64))
        weights, block = rows["weight"].to_numpy(), rows["block"].to_numpy()
        left, right = np.flatnonzero(block == key[2]), np.flatnonzero(block == key[3])
        links = np.zeros(len(rows), np.int64)
        pairs_a, pairs_b = [], []
        for at in range(0, len(left), 256):
            own = left[at : at + 256]
            # the product may differ in its last digits with the shape of its sides; the sum of a pair alone decides
            i, j = np.nonzero(units[own] @ units[right].T >= threshold - 1e-9)
            i, j = own[i], right[j]
            if key[2] == key[3]:
                i, j = i[i < j], j[i < j]
            for lo in range(0, len(i), PAIRS_AT_ONCE):
                a, b = i[lo : lo + PAIRS_AT_ONCE], j[lo : lo + PAIRS_AT_ONCE]
                near = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
                pairs_a.append(a[near]), pairs_b.append(b[near])
        a, b = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (pairs_a, pairs_b))
        np.add.at(links, a, weights[b])
        np.add.at(links, b, weights[a])
        root, met = _roots(len(rows), a, b), links > 0
        nodes = rows["node"].to_numpy()
        return pd.DataFrame({"node": nodes[met], "links": links[met], "root": nodes[root[met]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links (other vectors with a cosine of threshold or more and the same label), component_id (least
    vec_id reachable by links), kept (vec_id = component_id).

    Labels that are null, and vectors that are null, empty, zero or hold a null or non-finite component, link with nothing,
    and vectors of different lengths never do; a null id can't be named, so its row has n_links 0, component_id null, is
    kept and counts for nobody. Repeated rows (same id, label and vector) are one vector and are returned as often as they
    come. Other columns are not read; no rows give no rows. Comparing codes within a label grows with the square of its
    vectors, in blocks; a vector itself travels once for each block in which it has a candidate.
    """
    prepare(vectors.sparkSession)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    coded = materialise(source.mapInArrow(_code, _CODED))
    valid = coded.where("vec_id is not null and key is not null")
    classes = materialise(valid.select("key", "vec_id").distinct().groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    reps = valid.join(classes.withColumn("vec_id", F.col("node")), ["key", "vec_id"]).dropDuplicates(["key"])
    counts = reps.groupBy("label", "size").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = reps.join(counts, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")))
    pair = ["label", "size", "i", "j"]
    tasks = placed.select("label", "size", "node", "code.*", "block", F.inline(others))
    candidates = tasks.groupBy(*pair).applyInPandas(_candidates(threshold), "label string, size int, i int, j int, block int, node long")
    found = candidates.join(reps.select("node", "weight", "vector"), "node").groupBy(*pair).applyInPandas(_compare(threshold), "node long, links long, root long")
    found = materialise(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.select("node", "root"))
    by_class = classes.join(links, "node", "left").join(components, "node", "left").select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("least"))
    named = F.col("vec_id").isNotNull()
    component = F.when(named, F.coalesce("least", "vec_id"))
    joined = coded.select("vec_id", "key").join(by_class, "key", "left")
    return joined.select("vec_id", F.when(named, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
