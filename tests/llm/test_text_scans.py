"""Decontamination, licence scan, BPE and language ID."""

import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marram.llm import bpe, language_id, license_scan, queries
from marram.llm.decontamination import decontaminate
from marram.llm.license_scan import scan_licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(text, items):
    ws, hit, names = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        grams = {tuple(iw[i : i + 10]) for i in range(len(iw) - 9)} if len(iw) >= 10 else ({tuple(iw)} if iw else set())
        for g in grams:
            for p in range(len(ws) - len(g) + 1):
                if tuple(ws[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    if name is not None:
                        names.add(str(name))
    return len(ws), len(hit), sorted(names)


@pytest.mark.parametrize("most, most_bytes", [(1_000, 1_000_000), (0, 1_000_000), (1_000, 100)])
def test_decontamination_matches_brute_force(spark, most, most_bytes):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["aa", "bb", "cc", "dé", "e1"])
    items = [(i, rnd.choice([" ", ", "]).join(word() for _ in range(rnd.choice([2, 5, 12, 15, 30])))) for i in range(12)] + [(None, "zz yy xx"), (50, None), (51, "..."), (3, "aa bb")]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(rnd.randint(0, 40)))
        if i % 3 == 0:
            text += "; " + (items[rnd.randrange(12)][1]).upper() + " -end"
        docs.append((i, text, "keep"))
    docs += [(100, None, "n"), (101, "", "e"), (102, "ZZ yy. xx!", "s"), (5, docs[5][1], "again")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string, N_Hit string"), spark.createDataFrame(items, "item_id long, text string"), max_windows=most, max_bytes=most_bytes).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"])) == brute_hits(r.text, items), r
        assert r.contaminated == (r.n_hit > 0)
        if r.text is None:
            assert r.clean_text is None
        else:
            ws, gone = words(r.text), {p for s in r.spans for p in range(s.start, s.stop)}
            assert len(gone) == r.n_hit
            assert "".join(words(r.clean_text)) == "".join(w for p, w in enumerate(ws) if p not in gone)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(docs, items.limit(0)).first().n_hit == 0
    assert decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate(docs, items).first()["items"] == ["1"]


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and any associated documentation files, to deal in the Software without restriction"
    docs = [
        (0, "Released UNDER the  MIT-License. under the mit license", 9),
        (1, "cc by-nc, Apache License (Version 2)!", 9),
        (2, "under the mit", 9),
        (3, f"Text before. {mit} and after", 9),
        (4, None, 9),
        (5, "", 9),
        (6, "cc by nc cc by nc cc", 9),
        (7, "cé under\u212a the mit license", 9),
        (0, "Released UNDER the  MIT-License. under the mit license", 9),
    ]
    got = scan_licenses(spark.createDataFrame(docs, "doc_id long, text string, Score int")).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert (by[0].n_words, by[0].n_base, by[0].first_word, by[0].last_word, by[0].base_labels, by[0].score) == (9, 2, 1, 5, "mit", 1.0)
    assert (by[1].n_base, by[1].base_labels, by[1].first_word, by[1].last_word) == (2, "apache-2,cc-by-nc", 0, 3)
    assert (by[2].n_base, by[2].base_labels, by[2].first_word) == (0, "", None)
    assert (by[3].n_base, by[3].labels) == (0, "mit") and 0.7 <= by[3].score < 1
    assert [(s.start, s.label) for s in by[3].spans] == [(2, "mit")]
    assert [(r.n_words, r.n_base, r.labels, r.score) for r in (by[4], by[5])] == [(0, 0, "", 0.0)] * 2
    assert (by[6].n_base, by[6].first_word, by[6].last_word) == (2, 0, 3)
    assert by[7].n_base == 0
    assert scan_licenses(spark.createDataFrame(docs[:1], "doc_id long, text string, Score int").limit(0)).count() == 0


def brute_licenses(text, phrases=license_scan.PHRASES, notices=license_scan.NOTICES):
    """(n_base, starts, labels, score) from the rules: phrases word by word; of a notice, the longest chain of equal grams, in order
    in text and notice, whose shifts differ by NEAR at most."""
    ws = words(text)
    starts, labels, score = [], set(), 0.0
    for label, phrase in phrases:
        pw = words(phrase)
        for p in range(-len(pw), len(ws)):
            same = sum(0 <= p + i < len(ws) - 2 and ws[p + i : p + i + 3] == pw[i : i + 3] for i in range(len(pw) - 2))
            score = max(score, same / (len(pw) - 2))
            if ws[max(p, 0) : p + len(pw)] == pw:
                starts.append(p), labels.add(label)
    for label, notice in notices:
        nw = words(notice)
        pairs = sorted((p, t) for p in range(len(ws) - 2) for t in range(len(nw) - 2) if ws[p : p + 3] == nw[t : t + 3])
        for low in {p - t for p, t in pairs}:
            best = {}
            for p, t in (x for x in pairs if low <= x[0] - x[1] <= low + license_scan.NEAR):
                best[p, t] = 1 + max((n for (q, u), n in best.items() if q < p and u < t), default=0)
            share = max(best.values()) / (len(nw) - 2)
            score = max(score, share)
            if share >= license_scan.COVERAGE:
                labels.add(label)
    return len(starts), (min(starts, default=None), max(starts, default=None)), ",".join(sorted(labels)), score


def test_license_scan_matches_brute_force(spark):
    rnd = random.Random(11)
    templates = [words(t) for _, t in [*license_scan.PHRASES, *license_scan.NOTICES]]
    texts = ["licensed under the " * 6, "gnu general public " * 5, "licensed under the gnu general public " * 3, "to deal in the software without restriction " * 9, None, "", "a b"]
    for _ in range(60):
        out = []
        for _ in range(rnd.randint(1, 3)):
            ws = list(rnd.choice(templates))
            for _ in range(rnd.choice([0, 1, 2, 5])):
                at = rnd.randrange(len(ws) + 1)
                if rnd.random() < 0.5:
                    ws[at:at] = [rnd.choice(["x", "the", "license"])] * rnd.randint(1, 6)
                else:
                    del ws[at : at + rnd.randint(1, 4)]
            out += ws[: rnd.choice([4, 99, 99])] + ["y"] * rnd.randint(0, 2)
        texts.append(" ".join(out))
    docs = [(i, t) for i, t in enumerate(texts)]
    for listed in (license_scan.LISTED_GRAMS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(license_scan, "LISTED_GRAMS", listed)
            got = scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert len(got) == len(docs)
        for r in got:
            n, ends, labels, score = brute_licenses(texts[r.doc_id])
            assert (r.n_base, (r.first_word, r.last_word), r.labels, r.score) == (n, ends, labels, pytest.approx(score)), texts[r.doc_id]
            assert {s.label for s in r.spans} == set(filter(None, r.labels.split(",")))
    assert [brute_licenses(t)[2] for t in texts[:2]] == ["", ""]  # one gram, however often, is no notice


def test_license_scan_sql_equals_the_query(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    notice = license_scan.NOTICES[4][1]
    texts = ["licensed under the " * 6, f"x {notice} y {notice}", "licensed under the gnu general public x license", "under the mit license cc by nc", None, "gnu general public license by the " * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_license_scan(spark, str(tmp_path)).orderBy("doc_id")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = base.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.OP3_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in got.collect()] == want


def test_license_scan_of_one_long_text_costs_as_much_as_of_many(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["licensed under the", "under", "the", "license", "alpha", "beta"])
    parts = [" ".join(word() for _ in range(10_000)) for _ in range(16)]

    def seconds(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).cache()
        df.count()
        began = time.time()
        scan_licenses(df).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(parts)  # compiled
    assert seconds([" ".join(parts)]) < 2 * seconds(parts) + 2


@pytest.fixture(scope="module")
def vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


TEXTS = ["", " ", "Hello  world\n\n it's  'LL we'll 123,456", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "éçß 日本語 \u00a0\u2003x \x1c\x85y", "😀👍🏽 zzz\t\t", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


def test_bpe_equals_the_library(vocabulary):
    own, library = bpe.Bpe(open(vocabulary, encoding="utf-8").read()), Tokenizer.from_file(vocabulary)
    rnd = random.Random(4)
    texts = TEXTS + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x500), 32, 10])) for _ in range(80)) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, t
        assert own.decode(own.encode(t)) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_cuts_long_texts_where_pieces_begin(vocabulary, monkeypatch):
    own = bpe.Bpe(open(vocabulary, encoding="utf-8").read())
    text = "The word, it's  here 12 34\n\n and   there. " * 50
    whole = own.encode(text)
    monkeypatch.setattr(bpe, "SEGMENT", 7)
    assert own.encode(text) == whole


def test_bpe_refuses_files_with_other_settings(vocabulary):
    import json

    spec = json.loads(open(vocabulary, encoding="utf-8").read())
    bpe.refuse_other_settings(spec)
    changes = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}, {"model": {**spec["model"], "ignore_merges": True}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}]
    for change in changes:
        with pytest.raises(ValueError):
            bpe.refuse_other_settings({**spec, **change})


def test_bpe_in_spark(spark, vocabulary):
    rows = [(i, t, b"x") for i, t in enumerate(TEXTS)] + [(99, None, None), (0, TEXTS[0], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Ids binary")
    got = bpe.decode(bpe.encode(df, vocabulary), vocabulary).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.decoded == (r.text or "") and r.n_tokens * 4 == len(r.ids)
    once = bpe.round_trip(df, vocabulary).select("doc_id", "ids", "n_tokens", "decoded").collect()
    assert sorted(map(str, once)) == sorted(str(r) for r in bpe.decode(bpe.encode(df, vocabulary), vocabulary).select("doc_id", "ids", "n_tokens", "decoded").collect())
    assert bpe.encode(df.limit(0), vocabulary).count() == bpe.round_trip(df.limit(0), vocabulary).count() == 0


def test_language_id_learns_without_the_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs)
    found = language_id.identify(docs, model).select("*", language_id.held_out("doc_id").alias("held_out")).collect()
    for r in found[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    tested = [r for r in found if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(tested) > 100
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_language_id_edge_rows(spark):
    model = language_id.train([b"the of and to in", b"der die und das", b"the is on", b"und der"], ["en", "de", "en", "de"], steps=20)
    rows = [(1, "the of and", "q"), (2, None, "q"), (3, "", "q"), (4, "12 -- 34", "q"), (5, "ж", "q"), (1, "the of and", "q")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, Score string"), model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (2, 3, 4)] == ["und"] * 3
    a, b = (r for r in got if r.doc_id == 1)
    assert a.lang_pred == b.lang_pred and a.score == pytest.approx(b.score, abs=1e-5)
    assert {r.lang_pred for r in got if r.doc_id in (1, 5)} <= {"en", "de"}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.fit(empty) is None
    assert language_id.identify(empty, None).count() == 0


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in language_id._start(3, rng).items()}
    x, y = rng.integers(97, 105, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    mask = np.ones_like(x, bool)

    def loss(weights):
        states = {d: language_id._states(weights, d, x) for d in "fb"}
        p = language_id._softmax(states["f"].astype(np.float64) @ weights["out_f"] + states["b"].astype(np.float64) @ weights["out_b"] + weights["bias"])
        return -np.log(p[:, np.arange(5), y]).mean()

    grads = language_id._gradients({k: v.astype(np.float32) for k, v in w.items()}, x, mask, y)
    for name in ("gate_f", "new_b", "out_f"):
        at = (1, 1)
        up, down = {**w, name: w[name].copy()}, {**w, name: w[name].copy()}
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        f32 = lambda ws: {k: v.astype(np.float32) for k, v in ws.items()}
        assert grads[name][at] == pytest.approx((loss(f32(up)) - loss(f32(down))) / 2e-2, rel=0.05, abs=1e-4)


def test_pooled_is_by_whole_text():
    model = language_id.train([b"aaaa", b"bbbb"], ["a", "b"], steps=30)
    long = "a" * 1000 + "b" * 3000
    one, two = language_id.pooled(model, pa.array([long, None, ""])), language_id.pooled(model, pa.array([long]))
    assert np.allclose(one[0], two[0]) and one[0][1] > one[0][0] and not one[1].any()


def test_scores_equal_a_plain_loop():
    """The recurrence one byte at a time, with Python's own floats."""
    model = language_id.train([b"the of and to in", b"der die und das", b"le la les"], ["en", "de", "fr"], steps=15)
    w, hid = {k: v.astype(float).tolist() for k, v in model.weights.items()}, language_id.HIDDEN
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def states(d, window):
        h, out = [0.0] * hid, []
        for b in window if d == "f" else reversed(window):
            g = w[f"in_{d}"][b]
            gates = [sigmoid(g[i] + sum(h[k] * w[f"gate_{d}"][k][i] for k in range(hid))) for i in range(2 * hid)]
            new = [math.tanh(g[2 * hid + i] + sum(gates[hid + k] * h[k] * w[f"new_{d}"][k][i] for k in range(hid))) for i in range(hid)]
            h = [new[i] + gates[i] * (h[i] - new[i]) for i in range(hid)]
            out.append(h)
        return out if d == "f" else out[::-1]

    for text in ("the die la 12, é", "Und so weiter, und so fort; the rest is in another window of this text, la fin.", "x"):
        data, total, letters = text.encode(), [0.0] * 3, 0
        for at in range(0, len(data), language_id.WINDOW):
            window = data[at : at + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
            f, b = states("f", window), states("b", window)
            for t, byte in enumerate(data[at : at + language_id.WINDOW]):
                if language_id._LETTER[byte]:
                    s = [w["bias"][k] + sum(f[t][i] * w["out_f"][i][k] + b[t][i] * w["out_b"][i][k] for i in range(hid)) for k in range(3)]
                    e = [math.exp(x) for x in s]
                    total, letters = [a + x / sum(e) for a, x in zip(total, e)], letters + 1
        assert language_id.pooled(model, pa.array([text]))[0] == pytest.approx([x / letters for x in total], abs=1e-5)


def test_equal_texts_get_equal_results():
    model = language_id.train([b"the of and to in", b"der die und das"], ["en", "de"], steps=10)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "und", "of", "die", "xy"]) for _ in range(rnd.choice([3, 30, 900]))) for _ in range(60)]
    alone = [language_id.pooled(model, pa.array([t]))[0].tolist() for t in texts]
    order = rnd.sample(range(60), 60) * 2
    assert [x.tolist() for x in language_id.pooled(model, pa.array([texts[i] for i in order]))] == [alone[i] for i in order]


def test_training_sample_is_bounded(spark):
    rows = [(1, f"the same row of {'x' * 300}", "en")] * 400 + [(1, f"text {i} of one id", "en") for i in range(50)] + [(i, f"row {i}", "en") for i in range(2, 100)] + [(i, f"zeile {i}", "de") for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.training_rows(docs, "doc_id", "text", "lang", 40)
    assert sum(lang == "en" for lang, _ in found) == 40
    assert {snippets[0][-1:] for lang, snippets in found if lang == "de"} == {str(i).encode() for i in range(2, 9) if zlib.crc32(str(i).encode()) % 5}
    assert found == language_id.training_rows(docs.repartition(3), "doc_id", "text", "lang", 40)


def test_no_language_is_dropped_from_the_sample(spark):
    """All rows of a language may share an id; long texts send no more to the driver than short ones."""
    rows = [(9005, f"texte numéro {i} " + "mot " * 400, "fr") for i in range(6000)] + [(i, f"row {i}", "en") for i in range(600)] + [(9006, "ein einziger Satz", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.training_rows(docs, "doc_id", "text", "lang", 400)
    assert {x: sum(lang == x for lang, _ in found) for x in ("fr", "en", "de")} == {"fr": 400, "en": 400, "de": 1}
    assert all(len(snippets) == language_id.SNIPPETS and max(map(len, snippets)) <= language_id.SNIPPET for _, snippets in found)
    assert language_id.fit(docs, steps=2).languages == ["de", "en", "fr"]
    plan = docs.sparkSession._jvm.org.apache.spark.sql.internal.SQLConf.get().getConfString("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    assert int(plan) >= language_id.PER_LANGUAGE


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(9)], "doc_id long, text string, lang string"))


def test_held_out_null_id(spark):
    assert spark.range(1).select(language_id.held_out("id").alias("x")).count() == 1
    assert spark.createDataFrame([(None,)], "id long").select(language_id.held_out("id").alias("x")).first().x is True
    assert F is not None
