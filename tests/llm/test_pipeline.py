"""The corpus pipeline against brute force, and its stages on odd rows."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_duplicates import brute
from tests.llm.test_text_scans import brute_hits

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(0, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (1, None), (2, "short item")]


@pytest.fixture
def sf_dir(spark, tmp_path):
    rnd = random.Random(9)
    words = {"en": "the of and to in is that for it was on with as be by".split(), "de": "der die und das ist nicht ein zu den mit sich auf für im".split()}
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        body = [rnd.choice(words[lang]) for _ in range(rnd.randint(1, 60))]
        if i % 11 == 0:
            body[1:1] = ITEMS[0][1].upper().split()
        rows.append((i, " ".join(body), lang, "s", 0))
    rows += [(200 + i, rows[i * 5][1], "en", "s", 0) for i in range(12)]
    rows += [(300 + i, rows[i * 7][1] + " tail", "en", None, None) for i in range(12)]
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, "12 -- 34", None, "s", 0), (403, "a short item here", "en", "s", 0), (404, "der die und", None, "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_run_matches_brute_force(spark, sf_dir):
    path, rows = sf_dir
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    found = brute([r[:2] for r in kept])
    kept = [r for r in kept if found[r[0]][1] == r[0]]
    kept = [r for r in kept if not brute_hits(r[1], ITEMS)[1]]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in kept:
        ids = library.encode(r[1], add_special_tokens=False).ids
        want[r[0]] = (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, path).collect()}
    assert got == want and 20 < len(want) < len(rows)


def test_stages_on_odd_rows(spark, sf_dir):
    path, rows = sf_dir
    odd = [*[(*r, 1.0, True, 5, "x") for r in rows[:40]], (None, "the of and to in is", "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (7, rows[7][1], "en", "s", 0, 2.0, False, 6, "y"), (7, "zz other", "en", "s", 0, 2.0, False, 6, "y"), (500, "the " * 60_000, "en", "s", 0, 0.0, True, 0, "z")]
    schema = DOCS + ", score double, kept boolean, N_Hit int, lang_pred string"
    docs = spark.createDataFrame(odd, schema).checkpoint()
    by_stage = dict(corpus_pipeline.STAGES)
    told = by_stage["language_id"](spark, docs, path)
    assert told.columns == docs.columns and told.count() == len(odd) - 1
    assert sorted(map(str, told.collect())) == sorted(str(r) for r in docs.where("text is not null").collect())
    unique = by_stage["minhash_dedup"](spark, docs, path).collect()
    ids = [r.doc_id for r in unique]
    assert ids.count(None) == 2 and ids.count(7) == 1 and ids.count(500) == 1
    assert {r.score for r in unique if r.doc_id is not None and r.doc_id < 40 and r.doc_id != 7} == {1.0}
    clean = by_stage["decontamination"](spark, docs, path)
    assert clean.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {0, 11, 22, 33}
    assert by_stage["bpe"](spark, docs, path).count() == len(odd)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0).select(*[c.split()[0] for c in DOCS.split(", ")]), path).count() == 0, name
