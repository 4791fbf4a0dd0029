"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and decoding.

The vocabulary file is in the format of the tokenizers library. It is read once by the driver and broadcast: a file of a
few megabytes that doesn't grow with the data. Tasks keep the ids of pieces (words with their leading space) they have
met in a bounded table, so that merging runs once for most pieces.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marram.llm.common import extend

#: Pieces that a task remembers before it starts anew.
REMEMBERED = 1 << 18
#: Characters of a text that are handled at once; longer texts are cut where a piece must begin.
SEGMENT = 1 << 20

# Fixed value: the splitting pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


# The settings of a tokenizer file under which this module encodes as the file says.
SETTINGS = {
    "normalizer": None, "post_processor": None, "pre_tokenizer.type": "ByteLevel", "pre_tokenizer.add_prefix_space": False, "pre_tokenizer.use_regex": True, "decoder.type": "ByteLevel", "model.type": "BPE", "model.dropout": None,
    "model.unk_token": None, "model.continuing_subword_prefix": None, "model.end_of_word_suffix": None, "model.byte_fallback": False, "model.ignore_merges": False,
}
# What a file that leaves a setting out means, where that isn't null.
DEFAULTS = {"pre_tokenizer.add_prefix_space": True, "pre_tokenizer.use_regex": True, "model.byte_fallback": False, "model.ignore_merges": False, "model.type": "BPE"}


def refuse_other_settings(spec: dict) -> None:
    """Raises ValueError for a file with settings that would give other ids than this module does."""
    for name, wanted in SETTINGS.items():
        at, _, key = name.rpartition(".")
        found = ((spec.get(at) or {}) if at else spec).get(key, DEFAULTS.get(name))
        if found != wanted:
            raise ValueError(f"{name} is {found!r}; only {wanted!r} is supported")
    for token in spec.get("added_tokens") or []:
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added token {token['content']!r} has flags that aren't supported")


class Bpe:
    """A vocabulary with its merges, read from the text of a tokenizer file; files with other settings are refused."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        refuse_other_settings(spec)
        letters = _byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.added.items():
            self.strings[i] = token.encode()
        self.splitter = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.safe = regex.compile(r"(?<=\S) (?=\S)")
        self.known = _Known(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece. The queue holds (rank, place, ids seen there); an entry whose ids have changed is stale."""
        ids = [self.byte_ids[b] for b in piece]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, joined = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((joined, ids[k])):
                    heapq.heappush(queue, (r[0], i, joined, ids[k], r[1]))
            h = before[i]
            if h >= 0 and (r := ranks.get((ids[h], joined))):
                heapq.heappush(queue, (r[0], h, ids[h], joined, r[1]))
        return [i for i in ids if i >= 0]

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(segment, None), or (an added token, its id)."""
        at = 0
        for m in self.splitter.finditer(text) if self.splitter else ():
            yield from ((x, None) for x in self._cut(text[at : m.start()]))
            yield m.group(), self.added[m.group()]
            at = m.end()
        yield from ((x, None) for x in self._cut(text[at:] if at else text))

    def _cut(self, text: str) -> Iterator[str]:
        while len(text) > SEGMENT and (m := self.safe.search(text, SEGMENT)):
            yield text[: m.start()]
            text = text[m.start() :]
        if text:
            yield text

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for segment, added in self.segments(text):
            if added is not None:
                out.append(added.to_bytes(4, "little"))
            else:
                out.append(b"".join(map(self.known.__getitem__, self.pattern.findall(segment))))
                if len(self.known) > REMEMBERED:
                    self.known.clear()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, put together; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Known(dict):
    def __init__(self, bpe: Bpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.bpe.merge(piece.encode()), "<u4").tobytes()
        return ids


_loaded: dict[int, Bpe] = {}


def _load(broadcast) -> Bpe:
    """The vocabulary of a broadcast file; a worker parses it once."""
    key = hash(broadcast.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(broadcast.value)
    return _loaded[key]


def _read(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """df with ids (binary: little-endian unsigned 32-bit integers) and n_tokens.

    vocabulary is the path of the tokenizer file on the driver. A null text counts as empty and has no ids. Columns of df
    called ids or n_tokens give way. Every row gets its result, repeated rows too; no rows give no rows.
    """
    content = _read(df, vocabulary)

    def make(column: pa.Array) -> list[pa.Array]:
        bpe = _load(content)
        ids = [bpe.encode(t or "") for t in column.to_pylist()]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

    return extend(df, text_col, "ids binary, n_tokens long", make)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded, the text of the ids in ids_col (null ids: null). A column of df called decoded gives way."""
    content = _read(df, vocabulary)

    def make(column: pa.Array) -> list[pa.Array]:
        bpe = _load(content)
        return [pa.array([None if x is None else bpe.decode(x) for x in column.to_pylist()], pa.string())]

    return extend(df, ids_col, "decoded string", make, kind="binary")


def round_trip(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """df with ids, n_tokens and decoded: encode and then decode in one pass, so that a task needs one Python worker."""
    content = _read(df, vocabulary)

    def make(column: pa.Array) -> list[pa.Array]:
        bpe = _load(content)
        ids = [bpe.encode(t or "") for t in column.to_pylist()]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())]

    return extend(df, text_col, "ids binary, n_tokens long, decoded string", make)
