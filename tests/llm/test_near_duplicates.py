"""MinHash near-duplicates and components against brute force, and the empty, null and repeated cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from marram.llm import minhash_dedup
from marram.llm.components import connected_components
from marram.llm.minhash_dedup import near_duplicates


def brute(rows):
    """Per (doc_id, text): (n_shingles, component) by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    least = [d for d, _ in rows]
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            if least[i] != low or least[j] != low:
                least[i] = least[j] = low
                changed = True
    return {d: (len(s), c) for (d, _), s, c in zip(rows, sets, least)}


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(3))
    base = [[word() for _ in range(rnd.randint(3, 60))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = word()
        text = rnd.choice([" ", "  ", "\n"]).join(words)
        rows.append((i * 3 % (3 * n + 1), text.upper() if rnd.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_matches_brute_force(spark, block):
    rows = corpus() + [(1001, None), (1002, ""), (1003, " \t "), (1004, "one two"), (1005, "ONE  two"), (1006, "two")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_chains_in_a_shared_bucket_are_one_component(spark):
    """Near copies that differ from the least of them but not from each other: found by the blocks, not the star."""
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base)
        for p in range(0, 4 * (i % 5) + 1):
            words[(p * 7 + i) % 200] = f"x{i % 5}{p}"
        rows.append((i, " ".join(words)))
    rnd.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()}
    assert got == {d: c for d, (_, c) in brute(rows).items()}


def test_chance_buckets_cost_no_more_than_themselves(spark):
    """Thousands of documents tied into one chain by buckets that neighbours share though their sets differ: what is compared
    stays near the sum over the buckets, and a true pair of the chain that the star misses is found."""
    rng = np.random.default_rng(7)
    n, met = 3000, []
    signs = rng.integers(0, 1 << 32, (n, minhash_dedup.HASHES), dtype=np.uint32)
    for i in range(1, n):  # neighbours share one band, now the one and now the other
        signs[i, 4 * (i % 2) : 4 * (i % 2) + 4] = signs[i - 1, 4 * (i % 2) : 4 * (i % 2) + 4]
    rows = [(i, int(b), f"{b}-{signs[i, 4 * b : 4 * b + 4].tobytes().hex()}") for i in range(n) for b in (0, 1)]
    members = spark.createDataFrame([(hash(k) % (1 << 60), i, i) for i, b, k in rows], "bucket long, component long, node long").selectExpr("bucket", "0 AS band", "component", "node")
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    placed, sides = minhash_dedup._block_pairs(members.join(shared, "bucket"), 512)
    sizes = placed.groupBy("bucket", "block").count()
    pairs = sides.select("bucket", "i", "j").distinct()
    compared = pairs.join(sizes.withColumnsRenamed({"block": "i", "count": "n"}), ["bucket", "i"]).join(sizes.withColumnsRenamed({"block": "j", "count": "m"}), ["bucket", "j"]).selectExpr("sum(n * m)").first()[0]
    assert compared <= 4 * n, compared
    for band in range(32):
        rows = {"bucket": [1] * 3, "band": [band] * 3, "i": [0] * 3, "j": [0] * 3, "block": [0] * 3, "component": [1, 2, 3], "node": [1, 2, 3], "low": [signs[i].astype(np.uint8).tobytes() for i in (0, 0, 2)]}
        for cut in (1, 3):
            met += [(cut, *e.values()) for out in minhash_dedup._ties(75)(iter(pa.Table.from_pydict(rows).to_batches(max_chunksize=cut))) for e in out.to_pylist()]
    assert met == [(1, 1, 2), (3, 1, 2)] * minhash_dedup.BANDS_MET  # in the first bands alone


def test_sets_are_fetched_for_hopeful_pairs_only(spark):
    """Of a star of chance buckets only the pairs whose signatures allow a link go on to where sets are joined."""
    rng = np.random.default_rng(8)
    signs = rng.integers(0, 1 << 32, (400, minhash_dedup.HASHES), dtype=np.uint32)
    signs[1:, :4] = signs[0, :4]  # all share a bucket with node 0
    signs[1:4] = signs[0]
    signs[1:4, 100:] += 1  # 100 of 128 minima agree
    sets = spark.createDataFrame([(i, bytearray(s.astype(np.uint8).tobytes())) for i, s in enumerate(signs)], "node long, low binary")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 400)] * 2, "a long, b long")
    assert sorted(tuple(r) for r in minhash_dedup.hopeful_pairs(pairs, sets).collect()) == [(1, 0), (2, 0), (3, 0)]
    assert minhash_dedup.hopeful_pairs(pairs.limit(0), sets).count() == 0


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a b c d e f", "z"), (2, "A b c d e f", None), (None, None, None)], "doc_id long, text string, Kept string")
    got = sorted(near_duplicates(df).collect(), key=str)
    assert len(got) == 5
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 1] == [(1, True)] * 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 2] == [(1, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    agree = (minhash_dedup.signature(a) == minhash_dedup.signature(b)).mean()
    assert abs(agree - 600 / 1400) < 0.17


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(5)
    n = 80
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(50, i) for i in range(n)], "random": [(rnd.randrange(200), rnd.randrange(200)) for _ in range(110)]}[shape]
    parent = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            if (parent[a], parent[b]) != (low, low):
                parent[a] = parent[b] = low
                changed = True
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(parent.items())


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert [tuple(r) for r in connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).collect()] == [(3, 3)]


def jobs_of(spark, name, run):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        run()
    finally:
        for key in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(key, None)
    return len(context.statusTracker().getJobIdsForGroup(name))


def test_components_run_their_input_once_and_few_jobs(spark):
    """Each shuffle or broadcast is a job and a thread of the driver, whose memory many rounds of them use up."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 120, 3)], "a long, b long").mapInArrow(counted, "a long, b long")
    found = []
    jobs = jobs_of(spark, "components", lambda: found.extend(connected_components(edges).collect()))
    assert sorted(map(tuple, found)) == sorted((n, i) for i in range(0, 120, 3) for n in (i, i + 1))
    assert made.value == 40
    assert jobs <= 12, jobs


def test_components_of_several_tasks(spark, monkeypatch):
    """Rounds by joins give what rounds in one task give."""
    rnd = random.Random(9)
    edges = spark.createDataFrame([(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(7, 7), (999, 999), (None, 3), (3, None)], "a long, b long")
    one = sorted(map(tuple, connected_components(edges).collect()))
    monkeypatch.setattr("marram.llm.components.EDGES_PER_TASK", 40)
    assert sorted(map(tuple, connected_components(edges).collect())) == one
    assert (999, 999) in one and not any(None in r for r in one)


def test_plans_of_near_duplicates_are_small(spark):
    """What is compared in blocks is read from one stored table, not planned anew for each of its uses."""
    members = spark.createDataFrame([(1, 0, i, i) for i in range(9)], "bucket long, band int, component long, node long")
    placed, sides = minhash_dedup._block_pairs(members, 4)
    plan = placed.join(sides, ["bucket", "block"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 9, plan
