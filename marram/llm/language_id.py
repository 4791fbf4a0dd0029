"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes from both ends, labels every position and pools the positions' probabilities
over the document. It is trained on the driver in numpy by backpropagation through time, on a bounded sample of
labelled rows: at most `per_language` rows of each language, chosen by a hash of id and text, and of each row SNIPPETS
pieces from anywhere in its text, drawn in the executors. Prediction runs in the executors over every window of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marram.llm.common import broadcast_if_small, extend, materialise, prepare
from marram.llm.words import _offsets

WINDOW = 48
HIDDEN = 8
#: Bound of the training sample: rows of a language.
PER_LANGUAGE = 400
#: What the driver gets of such a row: so many pieces of so many bytes, from which windows are drawn.
SNIPPETS = 12
SNIPPET = 2 * WINDOW
#: The network has an output for each language; labels of more kinds than this are no languages.
MOST_LANGUAGES = 1000
STEPS = 160
BATCH = 192
#: What a text without a letter gets.
UNKNOWN = "und"
#: Windows that a task runs at once; always so many, so that a window's result is the same wherever it stands.
AT_ONCE = 2048
#: A window's probabilities are rounded to this unit before they are summed, so that the sum doesn't depend on its order.
UNIT = 2.0**-20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    """Weights by name, and the languages in the order of the outputs. `in_f`, `in_b`: gate inputs by byte, 256 x 3H."""

    weights: dict[str, np.ndarray]
    languages: list[str]


def _windows(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (WINDOW, n) of bytes from `begins` on, and which places lie before `ends`; beyond them stands 0."""
    places = begins + np.arange(WINDOW)[:, None]
    inside = places < ends
    return np.where(inside, data[np.minimum(places, len(data) - 1)], np.uint8(0)), inside


def _start(languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    w = {}
    for d in "fb":
        w[f"in_{d}"] = rng.normal(0, 0.3, (256, 3 * h))
        w[f"gate_{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 2 * h))
        w[f"new_{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, h))
        w[f"out_{d}"] = rng.normal(0, 0.3, (h, languages))
    w["bias"] = np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _states(w: dict[str, np.ndarray], d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of one direction over windows x (T, B) of bytes. keep: gets what training needs."""
    h2, t_all = 2 * HIDDEN, len(x)
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((*x.shape, HIDDEN), np.float32)
    table, gate, new = w[f"in_{d}"], w[f"gate_{d}"], w[f"new_{d}"]
    for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
        g = table[x[t]]
        zr = _sigmoid(g[:, :h2] + h @ gate)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        rh = r * h
        n = np.tanh(g[:, h2:] + rh @ new)
        if keep is not None:
            keep.append((t, h, z, r, rh, n))
        h = n + z * (h - n)
        out[t] = h
    return out


def _softmax(s: np.ndarray) -> np.ndarray:
    """Over the last axis, in place. Scores of this network stay far below where exp overflows; they are clipped to be sure."""
    np.clip(s, -60, 60, out=s)
    np.exp(s, out=s)
    s /= s @ np.ones((s.shape[-1], 1), np.float32)
    return s


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of the labelled positions, by backpropagation through time."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = {d: _states(w, d, x, kept[d]) for d in "fb"}
    p = _softmax(states["f"] @ w["out_f"] + states["b"] @ w["out_b"] + w["bias"])
    p[:, np.arange(len(y)), y] -= 1
    p *= (mask / max(1, mask.sum()))[:, :, None].astype(np.float32)
    grads = {"bias": p.sum((0, 1))}
    h2 = 2 * HIDDEN
    flat = p.reshape(-1, p.shape[-1])
    for d in "fb":
        grads[f"out_{d}"] = states[d].reshape(-1, HIDDEN).T @ flat
        d_in, d_gate, d_new = (np.zeros_like(w[f"{k}_{d}"]) for k in ("in", "gate", "new"))
        from_out = p @ w[f"out_{d}"].T
        carried = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, h, z, r, rh, n in reversed(kept[d]):
            dh = from_out[t] + carried
            dn = dh * (1 - z) * (1 - n * n)
            d_new += rh.T @ dn
            d_rh = dn @ w[f"new_{d}"].T
            d_zr = np.concatenate([dh * (h - n) * z * (1 - z), d_rh * h * r * (1 - r)], 1)
            d_gate += h.T @ d_zr
            np.add.at(d_in, x[t], np.concatenate([d_zr, dn], 1))
            carried = dh * z + d_rh * r + d_zr @ w[f"gate_{d}"].T
        grads |= {f"in_{d}": d_in, f"gate_{d}": d_gate, f"new_{d}": d_new}
    return grads


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 9) -> Model:
    """A model of the labelled texts; the same texts give the same model. Languages are drawn equally often, so are the texts
    of a language, and so are the places of a text."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y_all = np.array([languages.index(x) for x in labels])
    by_language = [np.flatnonzero(y_all == i) for i in range(len(languages))]
    data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    w = _start(len(languages), rng)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(own, BATCH // len(languages) + 1) for own in by_language])
        begins = ends[pick] - sizes[pick] + (rng.random(len(pick)) * np.maximum(sizes[pick] - WINDOW // 2, 1)).astype(np.int64)
        x, inside = _windows(data, begins, ends[pick])
        grads = _gradients(w, x, inside & _LETTER[x], y_all[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.03 * min(1, 2 * (1 - (step - 1) / steps))
        for k, g in grads.items():
            g *= min(1, 1 / max(norm, 1e-9))
            m[k] += 0.1 * (g - m[k])
            v2[k] += 0.01 * (g * g - v2[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(w, languages)


def _scores(w: dict[str, np.ndarray], d: str, x: np.ndarray) -> np.ndarray:
    """What one direction adds to the outputs, (T, languages, B); the same recurrence as _states without allocation.

    With the gates' weights halved, a sigmoid is (tanh + 1) / 2. Products are sums in one order for every column: the last bits of a
    BLAS product depend on where in the batch a column stands, and equal texts would differ."""
    half, product = np.float32(0.5), "ij,jk->ik"
    hid, h2, size = HIDDEN, 2 * HIDDEN, x.shape[1]
    table = w[f"in_{d}"].T.copy()
    table[:h2] *= half
    gate, new, out = (np.ascontiguousarray(m.T) for m in (w[f"gate_{d}"] * half, w[f"new_{d}"], w[f"out_{d}"]))
    g = np.empty((3 * hid, size), np.float32)
    zr, n, tmp = (np.empty((k, size), np.float32) for k in (h2, hid, hid))
    h = np.zeros((hid, size), np.float32)
    scores = np.empty((len(x), len(out), size), np.float32)
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        np.take(table, x[t], axis=1, out=g, mode="clip")
        np.einsum(product, gate, h, out=zr)
        zr += g[:h2]
        np.tanh(zr, out=zr)
        zr += np.float32(1)
        zr *= half
        np.multiply(zr[hid:], h, out=tmp)
        np.einsum(product, new, tmp, out=n)
        n += g[h2:]
        np.tanh(n, out=n)
        h -= n
        h *= zr[:hid]
        h += n
        np.einsum(product, out, h, out=scores[t])
    return scores


def pooled(model: Model, column: pa.Array) -> np.ndarray:
    """Mean probabilities (texts x languages) of the letter positions of each whole text; zeros where there is none."""
    offsets, data = _offsets(column)
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins, ends = offsets[:-1][owner] + nth * WINDOW, offsets[1:][owner]
    total = np.zeros((len(sizes), len(model.languages)))
    letters = np.zeros(len(sizes))
    for at in range(0, len(owner), AT_ONCE):
        own = owner[at : at + AT_ONCE]
        spare = np.zeros(AT_ONCE - len(own), np.int64)  # windows of nothing fill the last batch
        x, inside = _windows(data, np.concatenate([begins[at : at + AT_ONCE], spare]), np.concatenate([ends[at : at + AT_ONCE], spare]))
        mask = inside & _LETTER[x]
        p = _scores(model.weights, "f", x)
        p += _scores(model.weights, "b", x)
        p += model.weights["bias"][:, None]
        np.clip(p, -60, 60, out=p)
        np.exp(p, out=p)
        p *= (mask.astype(np.float32) / p.sum(1))[:, None]
        by_window = np.rint(p.sum(0)[:, : len(own)].astype(np.float64) / UNIT)
        for k, of_language in enumerate(by_window):
            total[:, k] += np.bincount(own, of_language, len(sizes))
        letters += np.bincount(own, mask[:, : len(own)].sum(0), len(sizes))
    return total * UNIT / np.maximum(letters, 1)[:, None]


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, key, print and SNIPPETS pieces of at most SNIPPET bytes from places of the whole text that the row's key draws."""
    for batch in batches:
        found = []
        for key, text in zip(batch.column(1).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
            places = np.random.default_rng(key).random(SNIPPETS) * max(len(text) - WINDOW // 2, 1)
            found.append([text[p : p + SNIPPET] for p in places.astype(np.int64)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.binary()))], ["lang", "key", "print", "snippets"])


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, list[bytes]]]:
    """(lang, snippets) of the sample: of the labelled rows outside the held-out fifth, repeated ones being one, the per_language
    of each language with the least hashes of id and text. A language with fewer rows gives all it has.

    The driver gets SNIPPETS times SNIPPET bytes of a row, drawn from its whole text in the executors, so at most
    per_language * SNIPPETS * SNIPPET bytes of a language, however long texts are. More than MOST_LANGUAGES languages are an error."""
    prepare(docs.sparkSession)
    print_ = F.sha2(F.col(text_col), 256)
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col).cast("string"), print_), F.lit(2**62)).alias("key"), print_.alias("print"), F.col(text_col).alias("text"))
    # the rank is bounded, so every task keeps the least rows of each language before any are shuffled
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "print"))
    chosen = materialise(labelled.select("lang", "key", "print").distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank"))
    if chosen.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    texts = labelled.join(broadcast_if_small(chosen), ["lang", "key", "print"], "left_semi").select("lang", "key", "print", "text")
    found = texts.mapInArrow(_snippets, "lang string, key long, print string, snippets array<binary>").dropDuplicates(["lang", "key", "print"])
    return [(r["lang"], [bytes(x) for x in r["snippets"]]) for r in sorted(found.collect(), key=lambda r: (r["lang"], r["key"], r["print"]))]


def held_out(id_col: str):
    """Whether a row is held out of training: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, steps: int = STEPS) -> Model | None:
    """A model from the rows that are not held out; None if no such row has a text and a language."""
    rows = [(lang, text) for lang, snippets in training_rows(docs, id_col, text_col, lang_col, per_language) for text in snippets if _LETTER[np.frombuffer(text, np.uint8)].any()]
    return train([text for _, text in rows], [lang for lang, _ in rows], steps) if rows else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, the pooled probability of lang_pred (0 to 1).

    A text that is null or has no letter gets `und` and score 0, and so does every text without a model. Ties go to the
    first language by name. Columns of docs with the new names give way; all rows, repeated ones too, and all other
    columns pass through. A window is scored in batches of one size and its probabilities are summed as whole units, so that
    equal texts get equal results.
    """

    def make(column: pa.Array) -> list[pa.Array]:
        if model is None:
            return [pa.array([UNKNOWN] * len(column)), pa.array([0.0] * len(column))]
        p = pooled(model, column)
        best = p.argmax(1)
        return [pa.array([model.languages[i] for i in best], pa.string()), pa.array(np.clip(p[np.arange(len(best)), best], 0, 1), pa.float64())]

    found = extend(docs, text_col, "lang_pred string, score double", make)
    letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    return found.withColumns({"lang_pred": F.when(letter, F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(letter, F.col("score")).otherwise(0.0)})
