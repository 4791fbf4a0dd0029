"""Sharding, URL rules, pages, archives and vectors."""

import io
import random
import struct
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from marram.llm import embedding_dedup, html_extraction, queries, sharding, warc
from marram.llm.embedding_dedup import near_duplicate_vectors
from marram.llm.html_extraction import extract_text, page_lines, shared_lines
from marram.llm.sharding import assign_shards, jump_hash
from marram.llm.url_filter import RULES, filter_urls


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 42, 256, 0xDEAD10CC, 2**63 - 1, -1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 9, 57, 100, 666):
        got = {r.k: r.s for r in df.select("k", jump_hash(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k % 2**64, n) for k in keys}, n
    assert jump(42, 57) == 43 and jump(256, 1024) == 520  # published values


def test_shards(spark):
    rows = [(i, f"t{i}", "x") for i in range(3000)] + [(7, "t7", "x")] * 500 + [(None, "n", "x")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, Slot string").repartition(7)
    got = assign_shards(df, 8).collect()
    assert len(got) == len(rows)
    by_shard = {}
    for r in assign_shards(df.distinct(), 8).collect():
        by_shard.setdefault(r.shard, []).append((r.slot, r.doc_id is not None, r.doc_id))
    assert all([x[1:] for x in sorted(s)] == sorted((d is not None, d) for _, _, d in s) for s in by_shard.values())  # slots follow the key
    by_shard = {}
    for r in got:
        key = (r.doc_id or 0) % 2**64
        assert (r.shard, r.grown_shard, r.law) == (jump(key, 8), jump(key, 9), "key")
        assert r.grown_shard in (r.shard, 8)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert assign_shards(df.limit(0), 8).count() == 0
    text_keys = assign_shards(df.select(F.col("text").alias("k")), 8, "k")
    assert text_keys.count() == len(rows)


def test_op4_query(spark, tmp_path):
    df = spark.createDataFrame([(1, "aé"), (2, None), (3, "")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op4_sharding(spark, str(tmp_path)).collect()}
    assert [(got[i].size, got[i].text_crc32) for i in (1, 2, 3)] == [(4, zlib.crc32("aé".encode())), (1, 0), (1, 0)]


def test_op4_sql_equals_the_query(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(12)
    spark.createDataFrame([(rnd.randrange(-(2**63), 2**63) if i % 2 else i, rnd.choice([None, "", "aé\u65e5😀", "x" * i])) for i in range(120)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_sharding(spark, str(tmp_path))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(base.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.OP4_SQL})").fetchall())


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_url_rules_match_brute_force(spark):
    rnd = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "example.com", "EXAMPLE.com", "xexample.com", "net", "c.net", "org"]
    paths = ["", "/", "/en/", "/en/7", "/en/77/x", "/de/8", "/de", "/es/é", "/en?/de/"]
    urls = [f"{rnd.choice(['http', 'https', 'x'])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=/en/', '#f'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", "http:///en/", "a://b://com/en/", "http://\u212a.com/en/"] + ["http://a.com/en/7"] * 50
    extra = [*RULES, ("allow", "a.com", ""), ("block", "b.a.com", "/en"), ("allow", "net", "/de/8/x"), ("block", "", "/"), ("block", None, "/")]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, Rule string")
    for rules, table in ((RULES, None), (extra, spark.createDataFrame(extra, "verdict string, host string, path string"))):
        got = filter_urls(pages, table).collect()
        assert len(got) == len(urls)
        for r in got:
            rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
            cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
            rule, verdict = brute_rule(host, path, rules)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r
    assert filter_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in filter_urls(pages, spark.createDataFrame([], "verdict string, host string, path string")).collect()} == {"allow"}


def test_op5_rules_are_the_contracts(spark, tmp_path):
    """Each rule's word is written out here, not read from RULES, for the query and for its SQL."""
    duckdb = pytest.importorskip("duckdb")
    want = {
        "http://com/en/": ("com/en/", "block"), "http://a.com/en/7": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"), "http://w.example.com/en/77": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://a.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://w.example.net/de/8/x": ("example.net/de/8", "block"),
        "http://org/es/": ("org/es/", "block"), "http://a.org/es/9": ("org/es/", "block"),
        "http://com/de/": (None, "allow"), "http://net/en/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = [(i, *r) for i, r in enumerate(want.values())]
    got = queries.op5_url_filter(spark, str(tmp_path)).select("page_id", "rule", "verdict")
    assert sorted(map(tuple, got.collect())) == rows
    base = duckdb.connect()
    base.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(base.sql(f"SELECT page_id, rule, verdict FROM ({queries.OP5_SQL})").fetchall()) == rows


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";x()</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">A</a><li>B</ul></nav><!-- ad --><div class="ad-box">Buy</div>
<article><h1>Head&nbsp;line</h1><p><b>First   line<br>goes on<p>Second &lt;b&gt; &eacute;<ul><li>one<li>two</ul><aside>Side</aside><form>F</form>
<div id="comments"><p>Nice!</p></div></article><footer>&copy; me</footer>"""


def test_article(spark):
    text = "Head line\nFirst line goes on\nSecond <b> é\none\ntwo"
    rows = [(1, "http://h/a", PAGE), (2, None, None), (3, "x", ""), (4, "http://h/b", PAGE), (1, "http://h/a", PAGE), (5, "http://h/c", "<article>cut sh")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    assert all((r.text, r.n_chars) == (text, len(text)) for r in got if r.page_id in (1, 4))
    assert all((r.text, r.n_chars) == ("", 0) for r in got if r.page_id in (2, 3))
    assert [r.text for r in got if r.page_id == 5] == ["cut sh"]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_pages_without_markup_lose_what_their_neighbour_shares(spark, parts):
    page = lambda *body: "<body><div>Welcome to the site</div>" + "".join(f"<p>{b}</p>" for b in body) + "<div>All rights</div></body>"
    rows = [(1, "http://h.com/x/1", page("alpha one", "beta")), (2, "http://h.com/x/2", page("gamma", "alpha two")), (3, "http://h.com/x/3", page("delta")), (4, "http://other.com/x/1", page("alone"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    df = df.checkpoint()
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    assert got == {1: "alpha one\nbeta", 2: "gamma\nalpha two", 3: "delta", 4: "Welcome to the site\nalone\nAll rights"}


@pytest.mark.parametrize(
    ("html", "main"),
    [
        ('<body class="comments-open has-sidebar"><article class="has-comments">a</article>', ["a"]),
        ('<html class="no-ads"><div class="with-sidebar"><main id="comment-page"><article id="related">a</article></main></div>', ["a"]),
        ('<article><h2 id="social-impact">a</h2><p class="notice">b</p><section class="related-work">c</section><div id="menu">d</div></article>', list("abcd")),
        ('<main><h2 id="share">a</h2><span class="social-policy">b</span><section id="widget"><p>c</p></section></main>', list("abc")),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", ["so x=2 holds"]),
        ('<article><p>a</p><div class="ad">x</div><div class="shareButtons big">x</div><div id="disqus_thread">x</div><p hidden>x</p></article>', ["a"]),
        ('<article><p>a</p><article class="comment-body odd"><p>x</p></article></article><article class="comment"><p>x</p></article>', ["a"]),
        ("<head><title>x</title></head><article><p>a <script>x</script>b<svg><text>x</text></svg></p></article>", ["a b"]),
        ('<div class="top-banner">x</div><div id="mainMenu">x</div><article>a</article>', ["a"]),
    ],
)
def test_class_and_id_words_drop_no_main_text(html, main):
    lines = page_lines(html)
    assert [t for t, kind in lines if kind == "main"] == main and all(kind == "frame" for t, kind in lines if t == "x")


@pytest.mark.parametrize("parts", [1, 2, 5, 11])
def test_copies_of_pages_without_markup_keep_their_text(spark, parts):
    page = lambda *body: "<body><div>Welcome</div>" + "".join(f"<p>{b}</p>" for b in body) + "<div>All rights</div></body>"
    copies = [f"http://h.com/x/2{end}" for end in ("", "", "?q=1", "#top", "/")] * 9
    rows = [(1, "http://h.com/x/1", page("one")), *[(10 + i, url, page("alpha", "beta")) for i, url in enumerate(copies)], (2, "http://h.com/x/3", page("three"))]
    rows += [(60 + i, f"http://h.com/y/{i}", page("gamma")) for i in range(9)]
    rows += [(80 + i, "http://alone.com/", page("alone")) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).checkpoint()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.page_id: r.text for r in extract_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    whole = "Welcome\nalone\nAll rights"
    assert got == {1: "one", 2: "three"} | {10 + i: "alpha\nbeta" for i in range(45)} | {60 + i: "gamma" for i in range(9)} | {80 + i: whole for i in range(9)}


def test_differencing_removes_frame_lines_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = extract_text(pages, report=True).collect()
    assert len(found) == pages.count()
    assert sum(r.n_differenced for r in found) > 0
    assert all(r.n_differenced + r.n_protected <= r.n_lines for r in found)


def test_report_counts_what_differencing_does(spark):
    page = lambda *body: "<nav>Home</nav><article>" + "".join(f"<p>{b}</p>" for b in body) + "</article><footer>Bye</footer>"
    rows = [(1, "http://h/1", page("same", "a"), 5), (2, "http://h/2", page("same", "b"), 5), (3, "http://h/2", page("same", "b"), 5), (4, None, None, 5)]
    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, N_Lines int"), report=True).collect()}
    assert {i: (r.text, r.n_lines, r.n_differenced, r.n_protected) for i, r in got.items()} == {1: ("same\na", 4, 2, 1), 2: ("same\nb", 4, 2, 1), 3: ("same\nb", 4, 2, 1), 4: ("", 0, 0, 0)}


def test_very_long_pages(spark):
    page = lambda x: "<body><div>Welcome</div>" + "".join(f"<p>{x} {i}</p>" for i in range(20_000)) + "<div>Bye</div>"
    got = {r.page_id: r for r in extract_text(spark.createDataFrame([(1, "http://h/1", page("a")), (2, "http://h/2", page("b"))], "page_id long, url string, html string")).collect()}
    assert got[1].text.split("\n") == [f"a {i}" for i in range(20_000)] and got[2].text.startswith("b 0\nb 1\n")


def test_longest_common_subsequence():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        places = shared_lines(a, b)
        assert len(places) == table[-1][-1] and places == sorted(set(places))
        rest = iter(b)
        assert all(a[i] in rest for i in places)


@pytest.mark.parametrize("bits", [3, 4096])
def test_alignment_of_pages_with_many_equal_lines(monkeypatch, bits):
    monkeypatch.setattr(html_extraction, "BITS", bits)
    rnd = random.Random(9)
    for _ in range(150):
        a, b = ([rnd.choice("aab") for _ in range(rnd.randint(0, 60))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert html_extraction._lengths(a, b) == table[-1]
        places, rest = shared_lines(a, b), iter(b)
        assert len(places) == table[-1][-1] and places == sorted(set(places)) and all(a[i] in rest for i in places)


def test_alignment_of_very_many_equal_lines_is_quick():
    rnd = random.Random(10)
    n = 30_000
    same = ["Reply"] * n
    few = [[rnd.choice(["Reply", "Like", "Share", f"line {rnd.randrange(40_000)}"]) for _ in range(n)] for _ in range(2)]
    for a, b, least in [(same, ["Top", *same, "End"], n), (["x", *same], [*same, "y"], n), (*few, n // 2)]:
        began = time.process_time()
        assert len(shared_lines(a, b)) >= least
        assert time.process_time() - began < (1 if least == n else 8)


def plain_alignment(a, b):
    """How long a longest common subsequence is, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1]


def test_given_pages_without_articles_are_told_apart_by_differencing(spark):
    """The pages' articles become plain blocks, so that nothing but their neighbours tells main text from frame."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("html", F.regexp_replace("html", "(?i)</?(article|main)[^>]*>", "<div></div>")).checkpoint()
    found = {r.page_id: r for r in extract_text(pages, report=True).collect()}
    rows = {r.page_id: [x for x in page_lines(r.html)] for r in pages.collect()}
    assert all(kind != "main" for lines in rows.values() for _, kind in lines)
    assert sum(r.n_differenced for r in found.values()) > 0
    kept = 0
    for page_id, lines in rows.items():
        free = [t for t, kind in lines if kind == "free"]
        left = found[page_id].text.split("\n") if found[page_id].text else []
        rest = iter(free)
        assert all(x in rest for x in left)  # in page order, nothing added
        kept += len(left)
        assert len(free) - len(left) <= found[page_id].n_differenced
        if found[page_id].n_differenced:
            others = [[t for t, _ in x] for i, x in rows.items() if i != page_id]
            # what went is as long as the alignment with one of the other pages
            assert any(plain_alignment([t for t, _ in lines], other) == found[page_id].n_differenced for other in others)
    assert kept > 10 * len(found) / 2


def test_lines_keep_kinds():
    kinds = {t: k for t, k in page_lines(PAGE)}
    assert kinds["Head line"] == "main" and kinds["Nice!"] == kinds["Site"] == kinds["© me"] == "frame"
    assert html_extraction.page_lines("plain text") == [("plain text", "free")]


def test_archives_round_trip(spark):
    long = "é" * 80
    rows = [(3, "http://a/ b\r\nc", long), (1, "http://a/1", long), (2, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "x" * 300_000), (1, "http://a/1", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = warc.archive_folder(pages)
    archives = warc.write_archives(pages, folder)
    got = warc.read_archives(archives, folder).collect()
    assert len(got) == len(rows) and sum(r.records for r in archives.collect()) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1)] + [(i, "response", None) for i in range(4, 9)]
    import hashlib

    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == html[r.page_id])
    files, root = warc.fs.FileSystem.from_uri(folder)
    heads = [h for f in files.get_file_info(warc.fs.FileSelector(root)) for h, _ in warc.read_records(files.open_input_stream(f.path))]
    named = {h["warc-record-id"]: h.get("warc-target-uri") for h in heads}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert revisits and all(named[h["warc-refers-to"]] == h["warc-refers-to-target-uri"] for h in revisits)  # other readers can follow them
    empty = pages.limit(0)
    assert warc.read_archives(warc.write_archives(empty, folder), folder).count() == 0


def test_archives_are_removed(spark):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    folder = warc.archive_folder(pages)
    warc.write_archives(pages, folder)
    warc.remove_archives(folder)
    files, root = warc.fs.FileSystem.from_uri(folder)
    assert files.get_file_info(root).type == warc.fs.FileType.NotFound


def archive(*frames, dictionary=b"0123456789" * 20):
    d = zstandard.ZstdCompressionDict(dictionary)
    return struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + b"".join(zstandard.ZstdCompressor(dict_data=d).compress(f) for f in frames)


def test_broken_archives_are_errors():
    good = warc._record(1, "u", b"payload", "d" * 64, None)
    assert len(list(warc.read_records(io.BytesIO(archive(good, good))))) == 2
    for bad in (good.replace(b"Content-Length: 9", b"Content-Length: 8"), good[:-2], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"payload", b"paXload"), b"junk"):
        if bad == good:
            continue
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(archive(bad))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(archive(good)[:-5])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(b"\x00" * 16)))


def brute_vectors(rows, threshold=0.93):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unique = list({(i, label, None if v is None else tuple(v)) for i, label, v in rows})
    links, least = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}
    edges = []
    for a in range(len(unique)):
        for b in range(a):
            (i, l1, x), (j, l2, y) = unique[a], unique[b]
            if l1 == l2 and l1 is not None and ok(x) and ok(y) and len(x) == len(y) and i is not None and j is not None:
                if np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    edges.append((i, j))
                    links[i] += 1
                    links[j] += 1
    for _ in range(len(rows)):
        for i, j in edges:
            least[i] = least[j] = min(least[i], least[j])
    return links, least


@pytest.mark.parametrize("block", [5, 2048])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 7))):
                rows.append((n, label, [float(np.float32(x)) for x in centre + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25])]))
                n += 1
    rows += [(900, 1, None), (901, 1, [0.0] * 16), (902, None, rows[0][2]), (903, 1, [float("nan")] * 16), (904, 1, []), (905, 1, rows[0][2]), (905, 1, rows[0][2]), (906, 1, [1.0, 2.0]), (907, 1, [2.0, 4.0]), (908, 1, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    got = near_duplicate_vectors(df, block=block).collect()
    links, least = brute_vectors(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], least[r.vec_id], least[r.vec_id] == r.vec_id), r
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    nameless = near_duplicate_vectors(spark.createDataFrame([(None, 1, [1.0]), (1, 1, [2.0])], "vec_id long, label int, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in nameless) == [("1", 0, True), ("None", 0, True)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50] + rng.normal(size=(50, 64)) * 0.05
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    codes, factors = embedding_dedup.encode(x)
    found, bound = embedding_dedup.estimates(q, codes, factors)
    error = found - q @ x.T
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound).all()
    rounded = embedding_dedup.rounded(q @ embedding_dedup.rotation(64).T)
    found, bound = embedding_dedup.estimates_of_rounded(*rounded, codes, factors)
    assert (np.abs(found - q @ x.T) <= bound).all() and rounded[0].nbytes * 8 == q.nbytes


def test_one_label_of_many_blocks_with_a_large_group(spark):
    """A third of the vectors are near copies of one, in one label that fills many blocks."""
    rng = np.random.default_rng(5)
    one = rng.normal(size=64)
    rows = [(i, 1, [float(np.float32(v)) for v in (one + rng.normal(size=64) * 0.05 if i % 3 == 0 else rng.normal(size=64))]) for i in range(600)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), block=32).collect()
    links, least = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (links[i], least[i]) for i in links}


def test_codes_spare_vectors():
    """Of vectors of many dimensions that aren't near each other, the first pass leaves none."""
    import pandas as pd

    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 384))
    x[1] = x[0] + rng.normal(size=384) * 0.1
    y = embedding_dedup._units(x) @ embedding_dedup.rotation(384).T
    (code, factor), (query, unit, loss) = embedding_dedup._encode(y), embedding_dedup.rounded(y)
    rows = pd.DataFrame({"code": [c.tobytes() for c in code], "query": [q.tobytes() for q in query], "factor": factor, "unit": unit, "loss": loss, "block": 0, "node": range(400)})
    assert embedding_dedup._candidates(0.93)(("a", 384, 0, 0), rows)["node"].tolist() == [0, 1]
