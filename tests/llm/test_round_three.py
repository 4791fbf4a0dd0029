"""Periodic runs, spelling variants and token counts."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marram.llm import periodic_runs, queries, spelling, token_cache
from marram.llm.common import shared_dir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] == words[i + q]:
                j = i
                while j + q < len(words) and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(6, 4 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs_of(texts):
    """find_runs on lists of small numbers, as a list of (start, length, period) for each."""
    ids = np.array([x for w in texts for x in w], np.int64)
    found = periodic_runs.find_runs(ids, np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64))
    return [[tuple(map(int, r[1:])) for r in found if r[0] == i] for i in range(len(texts))]


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rnd = random.Random(seed)
    texts = []
    for k in range(900):
        letters = rnd.choice([1, 2, 2, 3, 5])
        if k % 3 == 0:
            words = [rnd.randrange(letters) for _ in range(rnd.randrange(60))]
        elif k % 3 == 1:
            words = []
            while len(words) < rnd.randrange(1, 200):
                unit = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 12))]
                words += unit * rnd.randrange(1, 9) + unit[: rnd.randrange(len(unit) + 1)]
        else:  # units that are themselves nearly periodic, with an end cut off
            unit = [0] * rnd.randrange(1, 15) + [1] * rnd.randrange(3) + [0] * rnd.randrange(9)
            words = [rnd.randrange(2) for _ in range(rnd.randrange(9))] + unit * rnd.randrange(3, 8) + unit[: rnd.randrange(len(unit))] + [rnd.randrange(2) for _ in range(rnd.randrange(9))]
        texts.append(words)
    for at in range(0, len(texts), 90):
        part = texts[at : at + 90]
        assert runs_of(part) == [brute_runs(w) for w in part]


def test_runs_of_long_periods_and_many_equal_words():
    rnd = random.Random(3)
    unit = [rnd.randrange(1000) for _ in range(777)]
    assert runs_of([[5, *unit * 4, *unit[:10], -1 + 2000]])[0] == [(1, 777 * 4 + 10, 777)]
    assert runs_of([[1] * 100_000])[0] == [(0, 100_000, 1)]
    assert runs_of([[1, 2, 3] * 30_000, [1, 2, 3]]) == [[(0, 90_000, 3)], []]
    assert runs_of([[1] * 5, [1] * 6, [1, 2] * 3, [1, 2] * 4, []]) == [[], [(0, 6, 1)], [], [(0, 8, 2)], []]


def test_wavelet_tree():
    rnd = np.random.default_rng(5)
    values = rnd.integers(0, 37, 300)
    tree = periodic_runs._WaveletTree(values)
    for low, high in [(0, 300), (10, 11), (50, 200), (7, 7)]:
        a, b = np.array([low]), np.array([high])
        for limit in (0, 1, 20, 36, 37, 64, 1000):
            assert tree.below(a, b, np.array([limit]))[0] == (values[low:high] < limit).sum()
        for n in range(0, high - low, 7):
            assert tree.nth(a, b, np.array([n]))[0] == np.sort(values[low:high])[n]


def test_periodic_runs_in_spark(spark):
    rows = [
        (1, "x a b a b a b a b y", "k"),
        (1, "x a b a b a b a b y", "k"),
        (2, None, "k"),
        (3, "", "k"),
        (4, " \t\n ", "k"),
        (None, "A a A a A a A a", "k"),
        (5, "z z z z z z z z z z z z", "k"),
        (6, "a a a a a a b b b b b b", "k"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, Runs string")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r["runs"]], r.collapsed) for r in periodic_runs.periodic_runs(df).collect()]
    assert got == [
        (1, 10, [(1, 8, 2)], "x a b y"),
        (1, 10, [(1, 8, 2)], "x a b y"),
        (2, 0, [], ""),
        (3, 0, [], ""),
        (4, 0, [], ""),
        (None, 8, [(0, 8, 2)], "A a"),
        (5, 6, [(0, 6, 1)], "z z"),
        (6, 12, [(0, 6, 1), (6, 6, 1)], "a b"),
    ]
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def brute_op11(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed, kept = "".join(f"{a},{n},{q}\n" for a, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(listed), digest(kept))


def test_op11_query_matches_brute_force_and_sql(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choice(["la", "Di", "dä", "x,"]) for _ in range(rnd.choice([1, 9, 40, 120])))) for i in range(150)] + [(200, None), (201, ""), (202, "word"), (203, " \n")]
    rows += [(i, None if i % 2 else " ") for i in range(300, 340)]  # texts without words that are due to be looped
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op11_periodic_runs(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(brute_op11(*r) for r in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(queries.OP11_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(tuple(r[names.index(c)] for c in df.columns) for r in found) == got


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(counts, least_length=5, least_count=3):
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    near = {w: [t for t in words if t != w and one_edit(w, t)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda t: (-words[t], t), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items()))


def variants_of(spark, counts, **options):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n if r.form_n is not None else -1) for r in spelling.spelling_variants(df, **options).collect())


def test_variants_match_brute_force(spark):
    rnd = random.Random(12)
    counts = {}
    for _ in range(700):
        base = "".join(rnd.choice("abà") for _ in range(rnd.randrange(1, 9)))
        counts[base] = rnd.choice([1, 3, 4, 9, 30, 200])
    for w in ["stone", "stones", "stne", "atone", "stonee", "sstone", "tone", "shone"]:
        counts[w] = rnd.choice([3, 9, 40])
    counts |= {"x" * 3000 + "y" + "z" * 2000: 5, "x" * 3000 + "z" * 2000: 50, "x" * 2999 + "y" + "z" * 2000: 6}
    assert variants_of(spark, counts) == brute_variants(counts)
    assert variants_of(spark, counts, least_length=0, least_count=1) == brute_variants(counts, 0, 1)


def test_chains_of_forms_end_at_the_root(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 50}
    got = {r[0]: r[2] for r in variants_of(spark, counts)}
    assert set(got.values()) == {"bbbbb", "bbbbbb"} and got["aaaaa"] == "bbbbb" and got["bbbbbb"] == "bbbbbb"


def test_one_prefix_of_very_many_words(spark):
    """A third of the words and more share a prefix; a word meets only the edges of its own node."""
    rnd = random.Random(13)
    counts = {"commonprefix" + "".join(rnd.choice("abcdefgh") for _ in range(4)): rnd.randrange(3, 50) for _ in range(600)}
    counts |= {"".join(rnd.choice("abcdefgh") for _ in range(6)): rnd.randrange(3, 50) for _ in range(300)}
    assert variants_of(spark, counts) == brute_variants(counts)


def test_odd_rows_of_words(spark):
    df = spark.createDataFrame([("hello", 2, "z"), ("hello", 1, "z"), (None, 9, "z"), ("hallo", None, "z"), ("hullo", 7, "z"), ("", 9, "z")], "word string, n long, id string")
    assert sorted((r.word, r.n, r.form, r.n_near) for r in spelling.spelling_variants(df).collect()) == [("hello", 3, "hullo", 1), ("hullo", 7, None, 1)]
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(df, ratio=1)


def test_op12_query_matches_brute_force_and_sql(spark, tmp_path):
    rnd = random.Random(14)
    names = ["Garden", "gardens", "Straße", "straßen", "naïve", "houses", "horses", "×÷×÷×", "ÀÉÎÕÜ", "ab", "l"]
    rows = [(i, " ".join(rnd.choice(names) + rnd.choice(["", ",", "3", "_", "Ā"]) for _ in range(60))) for i in range(120)] + [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op12_spelling_variants(spark, str(tmp_path))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n if r.form_n is not None else -1) for r in df.collect())
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] = counts.get(w, 0) + 1
    assert got == brute_variants(counts)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(queries.OP12_SQL).fetchall()
    at = [[d[0] for d in con.description].index(c) for c in df.columns]
    assert sorted((r[at[0]], r[at[1]] or "", r[at[2]], r[at[3]], r[at[4]], -1 if r[at[5]] is None else r[at[5]]) for r in found) == got


TEXTS = ["", None, "Hello world", "Hello world", "a<|endoftext|>b", "é" * 50, "x" * 200_000, "  \n\t ", "नमस्ते", "Hello  world", "don't 12345!!"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(2, "Hello world", 2), (None, "no id", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int")


def cached(spark, cache):
    return spark.read.parquet(cache).select("tokenizer", F.hex("content").alias("content"), "n_tokens").collect()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, docs, tmp_path, name):
    path = public_tokenizers.path(name)
    got = {r.text: (r.n_bytes, r.n_tokens) for r in token_cache.count_tokens(docs, path, f"{tmp_path}/cache").collect()}
    if name.endswith(".model"):
        import sentencepiece

        count = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t))
    else:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert got == {t: (len((t or "").encode()), count(t or "")) for t in [*TEXTS, "no id"]}


def test_every_content_is_encoded_once(spark, docs, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/cache"
    first = token_cache.count_tokens(docs, path, cache)
    assert first.columns == ["doc_id", "text", "n_bytes", "n_tokens"] and first.count() == docs.count()
    rows = cached(spark, cache)
    assert len(rows) == len({t or "" for t in TEXTS} | {"no id"}) == len({r.content for r in rows})
    # a warm cache is used as it stands: what it says is taken, and nothing is appended
    content = hashlib.sha256(b"Hello world").digest()
    digest = rows[0].tokenizer
    spark.createDataFrame([(digest, bytearray(hashlib.sha256(b"only in the cache").digest()), 777), (digest, bytearray(content), 2)], token_cache.STORED).write.mode("append").partitionBy("tokenizer").parquet(cache)
    more = spark.createDataFrame([(1, "only in the cache"), (2, "Hello world"), (3, "quite new")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_cache.count_tokens(more, path, cache).collect()}
    assert got == {1: 777, 2: 2, 3: 2}
    assert len(cached(spark, cache)) == len(rows) + 3


def test_another_tokenizer_never_meets_old_counts(spark, docs, tmp_path):
    cache = f"{tmp_path}/cache"
    a = token_cache.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), cache).where("doc_id = 8").first().n_tokens
    b = token_cache.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), cache).where("doc_id = 8").first().n_tokens
    assert a != b and len({r.tokenizer for r in cached(spark, cache)}) == 2
    changed = tmp_path / "changed.json"
    changed.write_text(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read() + "\n", encoding="utf-8")
    token_cache.count_tokens(docs, str(changed), cache).count()
    assert len({r.tokenizer for r in cached(spark, cache)}) == 3


def test_no_rows_and_misses_beyond_the_broadcast(spark, docs, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_cache.count_tokens(docs.limit(0), path, f"{tmp_path}/none").count() == 0
    monkeypatch.setattr(token_cache, "broadcast_if_small", lambda df: df)
    got = token_cache.count_tokens(docs.drop("N_Tokens"), path, f"{tmp_path}/cache").collect()
    assert len(got) == docs.count() and all(r.n_tokens is not None for r in got)


def test_op13_query(spark, tmp_path):
    rows = [(1, "a b c"), (2, None), (3, "word " * 600), (4, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    assert got == [(1, 5, 3, False), (2, 0, 0, False), (3, 3000, 601, True), (4, 5, 3, False)]
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/token-counts-*")
    assert not spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).globStatus(folder)


def test_collapsing_keeps_what_another_run_starts_with():
    texts = [b"a a a a a a a b", b"q"]
    column = periodic_runs._make(pa.array([t.decode() for t in texts]))
    assert column[2].to_pylist() == ["a b", "q"]
