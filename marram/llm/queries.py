"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import bpe, language_id, warc
from marram.llm.common import materialise, remove_folder, shared_dir
from marram.llm.decontamination import decontaminate
from marram.llm.embedding_dedup import near_duplicate_vectors
from marram.llm.html_extraction import extract_text
from marram.llm.license_scan import COVERAGE, GRAM, NEAR, NOTICES, PHRASES, scan_licenses
from marram.llm.minhash_dedup import near_duplicates
from marram.llm.periodic_runs import periodic_runs
from marram.llm.sharding import SHARDS, assign_shards
from marram.llm.spelling import slipped_words, spelling_variants
from marram.llm.token_cache import count_tokens
from marram.llm.url_filter import DEFAULT, RULES, filter_urls

Query = Callable[[SparkSession, str], DataFrame]

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS a, x AS b FROM edges UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.c, d.doc_id)::BIGINT AS component_id, coalesce(least.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.a = d.doc_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = f"regexp_extract_all({_LOWER}, {_ALNUM})"
OP2_SQL = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 10 THEN [ws] ELSE list_transform(range(1, len(ws) - 8), lambda i: ws[i:i + 9]) END) AS win FROM b),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
k AS (SELECT DISTINCT len(win) AS k FROM v),
g AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS p, ws FROM d, k WHERE len(ws) >= k),
hits AS (SELECT g.doc_id, g.p, g.k, v.item_id FROM g JOIN v ON ws[p:p + k - 1] = v.win AND len(v.win) = g.k),
marked AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(m.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.names, '')) AS items_sha256, coalesce(m.n, 0) > 0 AS contaminated
FROM d LEFT JOIN marked m USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


_TEMPLATES = ", ".join(f"({i}, {base}, '{label}', '{text}')" for i, (base, label, text) in enumerate([*((True, *p) for p in PHRASES), *((False, *n) for n in NOTICES)]))
OP3_SQL = rf"""
WITH RECURSIVE t AS (SELECT template, base, label, {_WORDS} AS ws FROM (VALUES {_TEMPLATES}) v(template, base, label, text)),
tg AS (SELECT template, base, label, len(ws) - {GRAM - 1} AS grams, p AS tpos, ws[p:p + {GRAM - 1}] AS gram FROM t, unnest(range(1, len(ws) - {GRAM - 2})) u(p)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dg AS (SELECT doc_id, p AS pos, ws[p:p + {GRAM - 1}] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {GRAM - 2})) AS p FROM d)),
votes AS (SELECT doc_id, template, base, label, grams, pos, tpos FROM dg JOIN tg USING (gram)),
phrases AS (SELECT doc_id, label, pos - tpos AS start, count(*)::DOUBLE / any_value(grams) AS share FROM votes WHERE base GROUP BY doc_id, template, label, pos - tpos),
-- a span holds the votes of neighbouring diagonals; a chain goes forward in the text and in the notice
spans AS (SELECT doc_id, template, label, grams, pos, tpos, unnest(range(pos - tpos - {NEAR}, pos - tpos + 1)) AS anchor FROM votes WHERE NOT base),
chains AS (SELECT *, 1 AS n FROM spans
  UNION SELECT s.doc_id, s.template, s.label, s.grams, s.pos, s.tpos, s.anchor, c.n + 1 FROM chains c JOIN spans s ON s.doc_id = c.doc_id AND s.template = c.template AND s.anchor = c.anchor AND s.pos > c.pos AND s.tpos > c.tpos),
shares AS (SELECT doc_id, true AS base, label, start, share FROM phrases UNION ALL SELECT doc_id, false, label, NULL, max(n)::DOUBLE / any_value(grams) FROM chains GROUP BY doc_id, template, label, anchor),
r AS (SELECT doc_id, count(*) FILTER (base AND share >= 1) AS n_base, min(start) FILTER (base AND share >= 1) AS f, max(start) FILTER (base AND share >= 1) AS l,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND share >= 1) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((base AND share >= 1) OR (NOT base AND share >= {COVERAGE})) AS al, max(share) AS score FROM shares GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word, coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    docs = _table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    return assign_shards(docs, SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


OP4_SQL = f"""
WITH RECURSIVE steps AS (SELECT i AS byte, i::BIGINT AS c, 0 AS n FROM range(256) r(i) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE n = 8),
jump AS (SELECT doc_id, n, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS k, (-1)::BIGINT AS b, 0::BIGINT AS j FROM documents, (VALUES ({SHARDS}), ({SHARDS + 1})) v(n)
  UNION ALL SELECT doc_id, n, x, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((x // 8589934592)::BIGINT + 1)::DOUBLE))::BIGINT FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS x FROM jump) WHERE j < n),
s AS (SELECT doc_id, max(b) FILTER (n = {SHARDS}) AS shard, max(b) FILTER (n = {SHARDS + 1}) AS grown FROM jump GROUP BY doc_id),
d AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown::INT AS grown_shard,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
FROM d JOIN s USING (doc_id), crc
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rhost, rpath) AS (VALUES {", ".join(map(str, RULES))}),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS v FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


#: The tokenizer file, as installed on the driver.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.round_trip(docs, VOCABULARY)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


OP7_SQL = r"""
WITH a AS (SELECT page_id, url, string_agg(b, chr(10) ORDER BY k) AS t FROM (
  SELECT page_id, url, k, trim(regexp_replace(b, '\s+', ' ', 'g')) AS b FROM (
    SELECT page_id, url, unnest(bs) AS raw, generate_subscripts(bs, 1) AS k,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS b
    FROM (SELECT page_id, url, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:h1|p)>') AS bs FROM pages))
  ) WHERE b <> '' GROUP BY page_id, url)
SELECT p.page_id, p.url, coalesce(a.t, '') AS text, length(coalesce(a.t, ''))::BIGINT AS n_chars FROM pages p LEFT JOIN a ON a.page_id = p.page_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    found = warc.read_archives(warc.write_archives(pages, folder), folder, payloads=False)
    found = materialise(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    warc.remove_archives(folder)
    return found


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN least = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN least <> page_id THEN least END AS refers_to FROM q
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT x AS a, x AS b FROM links UNION SELECT r.a, l.y FROM reach r JOIN links l ON l.x = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c, e.vec_id)::BIGINT AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN least ON least.a = e.vec_id
"""


def looped_tails(docs: DataFrame) -> DataFrame:
    """docs, a tenth of them (by the CRC-32 of doc_id, null never) with a tail that repeats its own first words, three times or more."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.withColumn("h", crc).withColumn("ws", F.expr(r"CASE WHEN h % 10 = 0 THEN regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0) END"))
    cut = cut.withColumn("n", F.when(F.size("ws") > 0, F.size("ws"))).withColumn("a", F.expr("h div 10 % n")).withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    tail = "array_join(transform(ws, (w, i) -> CASE WHEN i >= a THEN ws[int(a + (i - a) % p)] ELSE w END), ' ')"
    return cut.select("doc_id", F.expr(f"CASE WHEN n IS NOT NULL THEN {tail} ELSE text END").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: CRC-32 in SQL: a table of 256 remainders, and a fold over the hexadecimal digits of a text in UTF-8.
_CRC_TABLE = """steps AS (SELECT i AS byte, i::BIGINT AS c, 0 AS n FROM range(256) r(i) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE n = 8)"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(hex(encode({text}))), 2), lambda i: ('0x' || hex(encode({text}))[i:i + 1])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT"""


OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, {_crc("doc_id::VARCHAR")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents, crc),
e AS (SELECT doc_id, ws, h % 10 = 0 AND len(ws) > 0 AS looped, (h // 10) % greatest(len(ws), 1) AS a, len(ws) AS n, h // 10 AS g FROM d),
w AS (SELECT doc_id, n, i, CASE WHEN looped AND i >= a THEN ws[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] ELSE ws[1 + i] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM e)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
isles AS (SELECT doc_id, q, min(i) AS a, max(i) + 1 + q AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM same) GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, a, b - a AS len, min(q) AS q FROM isles WHERE b - a >= greatest(6, 4 * q) GROUP BY doc_id, a, b),
gone AS (SELECT DISTINCT doc_id, unnest(range(a + q, a + len)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS c FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || len || ',' || q || chr(10), '' ORDER BY a, q) AS listed, min(struct_pack(l := -len, a := a, q := q)) AS best FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.a::BIGINT AS start, -best.l::BIGINT AS length, best.q::BIGINT AS period, (1000 * -best.l // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(slipped_words(_table(spark, sf_dir, "documents").select("doc_id", "text")))


OP12_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each_ AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("doc_id || ':' || run")} AS h FROM each_, crc),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
cuts AS (SELECT DISTINCT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word AS w, b.word AS t FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cuts c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM cuts c JOIN v ON v.word = c.rest),
best AS (SELECT w, count(*) AS n_near, min(struct_pack(m := -v.n, t := t)) AS b FROM near JOIN v ON v.word = t GROUP BY w),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * v.n THEN b.t END AS form, CASE WHEN -b.m >= 2 * v.n THEN -b.m END AS form_n FROM v LEFT JOIN best ON best.w = v.word),
walk AS (SELECT word, word AS place FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.place WHERE f.form IS NOT NULL),
root AS (SELECT walk.word, place AS root FROM walk JOIN f ON f.word = walk.place WHERE f.form IS NULL)
SELECT f.word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN root USING (word)
"""


#: A document with more tokens than this is over the limit.
TOKEN_LIMIT = 512


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache of this call's own, so that no run profits from what another one counted."""
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    found = count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY, cache)
    found = materialise(found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")))
    remove_folder(spark, cache)
    return found


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_decontamination": op2_decontamination,
        "op3_license_scan": op3_license_scan,
        "op4_sharding": op4_sharding,
        "op5_url_filter": op5_url_filter,
        "op6_bpe": op6_bpe,
        "op7_html_extraction": op7_html_extraction,
        "op8_warc": op8_warc,
        "op9_language_id": op9_language_id,
        "op10_embedding_dedup": op10_embedding_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_token_counts": op13_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": OP1_SQL,
        "op2_decontamination": OP2_SQL,
        "op3_license_scan": OP3_SQL,
        "op4_sharding": OP4_SQL,
        "op5_url_filter": OP5_SQL,
        "op7_html_extraction": OP7_SQL,
        "op8_warc": OP8_SQL,
        "op10_embedding_dedup": OP10_SQL,
        "op11_periodic_runs": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
    }
