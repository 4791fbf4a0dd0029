"""Streams give what the batch operators give on the same rows, whatever the batches are."""

import datetime as dt
import pathlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marram.operators import history
from marram.operators.upserts import merge
from marram.streaming import ledger as L
from marram.streaming.tables import BucketTable

OBS = "source string, source_listing_id string, observed_at timestamp, advertised_price long, seq long"
at = lambda d, h=12: dt.datetime(2026, 9, d, h)


def stream(spark, tmp_path, batches, schema):
    """A stream that reads one file a batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"b{n}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "b*"))


def test_first_observation_of_a_day(spark, tmp_path):
    batches = [[("s", "a", at(1, 9), 5, 0)], [("s", "a", at(1, 10), 6, 1), ("s", "a", at(2), 6, 2)], [("s", "a", at(1, 8), 9, 3)]]
    out = L.run_to_table(L.dedupe_observations(stream(spark, tmp_path / "in", batches, OBS)), str(tmp_path / "cp"))
    assert sorted((r.observed_on.day, r.advertised_price) for r in out.collect()) == [(1, 5), (2, 6)]


def test_upsert_equals_batch_history(spark, tmp_path):
    batches = [[("s", "a", at(1), 5, 0), ("s", "b", at(1), 7, 1)], [("s", "a", at(1), 6, 2), ("s", "a", at(3), 8, 3)], [("s", "a", at(2), 9, 4), ("s", "b", at(1), 1, 5)]]
    rows = stream(spark, tmp_path / "in", batches, OBS).select("source", "source_listing_id", F.to_date("observed_at").alias("observed_on"), "advertised_price", "seq")
    state, keys = str(tmp_path / "state"), ["source", "source_listing_id", "observed_on"]
    assert L.read_state(spark, state) is None
    L.stream_upsert(rows, state, keys, str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, L.read_state(spark, state).select(*keys, "advertised_price").collect()))
    all_ = spark.createDataFrame([r for b in batches for r in b], OBS).withColumn("observed_on", F.to_date("observed_at"))
    assert got == sorted(map(tuple, history.listing_history(all_).select(*keys, "advertised_price").collect()))
    L.stream_upsert(rows, state, keys, str(tmp_path / "cp")).awaitTermination()  # nothing new: nothing changes
    assert got == sorted(map(tuple, L.read_state(spark, state).select(*keys, "advertised_price").collect()))


def in_runs(spark, tmp_path, parts, schema, make, columns, **trigger):
    """The rows that a stream gives when each part comes in a run of its own, from the checkpoint of the run before."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"b{n}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "b*"))
        make(source).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(**(trigger or {"availableNow": True})).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()), key=str)


def plain_changes(rows, closed, grace=7):
    """rows (source, listing, time, price, seq), any order, in a plain loop; days before `closed` are over."""
    out, days = [], {}
    for s, k, t, price, seq in rows:
        if (s, k, t.date()) not in days or days[s, k, t.date()][1] < seq:
            days[s, k, t.date()] = (price, seq)
    for key in {(s, k) for s, k, _ in days}:
        last = None
        for day in sorted(d for s, k, d in days if (s, k) == key and d < closed):
            price = days[(*key, day)][0]
            if last and (day - last[0]).days > grace + 1:
                out.append((*key, last[0], "delisted", None, last[1]))
            moved = last is not None and None not in (last[1], price) and last[1] != price
            out.append((*key, day, "price_change" if moved else "unchanged" if last else "new_listing", last[1] if moved else None, price))
            last = (day, price)
        if last and (closed - last[0]).days > grace + 1:
            out.append((*key, last[0], "delisted", None, last[1]))
    return sorted(out, key=str)


CHANGED = ["source", "source_listing_id", "observed_on", "change", "previous", "current"]


def test_changes_of_batches_out_of_order_over_restarts(spark, tmp_path):
    rnd = random.Random(4)
    rows = [("s", rnd.choice("abcdefg"), at(rnd.randrange(1, 29), rnd.randrange(24)), rnd.choice([None, 5, 5, 6]), n) for n in range(60)]
    rows += [("s", "a", at(1, 3), 7, 100), ("s", "h", at(2), 5, 101), ("s", "h", at(20), 6, 102), ("s", "i", at(1), 5, 103)]
    dealt = rnd.sample(rows, len(rows))
    parts = [dealt[i::3] for i in range(3)]  # each over all days
    beat = [[("s", "beat", dt.datetime(2026, 10, 29), 1, 900)], [("s", "beat", dt.datetime(2026, 10, 29, 1), 1, 901)]]
    got = in_runs(spark, tmp_path, [*parts, *beat], OBS, lambda x: L.detect_changes_stream(x, delay="30 days"), CHANGED)
    assert [r for r in got if r[1] != "beat"] == plain_changes(rows, dt.date(2026, 9, 29))


def test_changes_are_told_while_the_watermark_moves(spark, tmp_path):
    parts = [
        [("s", "a", at(1), 5, 0), ("s", "b", at(1), 5, 1)],
        [("s", "a", at(3), 6, 3), ("s", "z", at(4), 1, 4)],
        [("s", "a", at(2, 13), 9, 2), ("s", "a", at(3), 7, 9)],  # a day late, and a second one of a day
        [("s", "z", at(14), 1, 6)],
        [("s", "z", at(15), 1, 7), ("s", "b", at(15), 8, 8)],
        [("s", "z", at(19), 1, 10)],
        [("s", "z", at(19, 13), 1, 11)],
    ]
    got = in_runs(spark, tmp_path, parts, OBS, lambda x: L.detect_changes_stream(x, delay="2 days"), CHANGED)
    day = lambda d: dt.date(2026, 9, d)
    assert [r[1:] for r in got if r[1] != "z"] == [
        ("a", day(1), "new_listing", None, 5),
        ("a", day(2), "price_change", 5, 9),
        ("a", day(3), "delisted", None, 7),
        ("a", day(3), "price_change", 9, 7),
        ("b", day(1), "delisted", None, 5),
        ("b", day(1), "new_listing", None, 5),
        ("b", day(15), "price_change", 5, 8),
    ]


HOLD = "hold_id string, status string, at timestamp"


def test_holds_expire(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 9, 1, 10, m)
    parts = [[("h1", "ACTIVE", t(0)), ("h2", "CONVERTED", t(5))], [("h2", "ACTIVE", t(0)), ("h4", "RELEASED", t(9)), ("x", "ACTIVE", t(9))], [("x", "RELEASED", t(30))], [("x", "ACTIVE", t(45))], [("x", "RELEASED", t(46))]]
    got = in_runs(spark, tmp_path, parts, HOLD, lambda x: L.expire_holds(x, delay="10 minutes"), ["hold_id", "status", "at"])
    assert [r for r in got if r[0] != "x"] == sorted([("h1", "ACTIVE", t(0)), ("h1", "EXPIRED", t(15)), ("h2", "ACTIVE", t(0)), ("h2", "CONVERTED", t(5)), ("h4", "RELEASED", t(9))], key=str)
    assert ("x", "EXPIRED", t(24)) in got


def test_late_conversion_in_the_same_batch(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 9, 1, 10, m)
    parts = [
        [("h1", "ACTIVE", t(0)), ("h1", "CONVERTED", t(15)), ("h2", "ACTIVE", t(0)), ("h2", "CONVERTED", t(14)), ("h3", "ACTIVE", t(0)), ("h3", "ACTIVE", t(10)), ("h3", "ACTIVE", t(10))],
        [("h3", "RELEASED", t(24)), ("x", "ACTIVE", t(50))],
        [("x", "ACTIVE", t(51))],
    ]
    got = in_runs(spark, tmp_path, parts, HOLD, L.expire_holds, ["hold_id", "status", "at"])
    assert [(r[0], r[2]) for r in got if r[1] == "EXPIRED"] == [("h1", t(15))] and len([r for r in got if r[0] != "x"]) == 9


def test_webhooks_without_a_time_once(spark, tmp_path):
    parts = [[("p", "s1", 1), ("p", "s1", 1)], [("p", "s1", 1), ("q", "s1", 2)]]
    got = in_runs(spark, tmp_path, parts, "processor string, signature string, amount int", L.dedupe_webhooks_by_clock, ["processor", "signature", "amount"], once=True)
    assert got == [("p", "s1", 1), ("q", "s1", 2)]


def files_of(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in pathlib.Path(path).rglob("*") if f.is_file()}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=32, keep=2)
    rows = lambda ks, v: spark.createDataFrame([(k, v, v) for k in ks], "k long, v long, seq long")
    change = lambda before, batch: merge(batch.limit(0).drop("seq") if before is None else before, batch, ["k"])
    assert table.read() is None
    table.update(0, rows(range(1000), 0), change)
    first = table.snapshot()
    touched = table.update(1, rows(range(10), 1), change)
    second = table.snapshot()
    assert 0 < len(touched) <= 10 and {b for b, v in second.buckets.items() if v == 1} == set(touched)
    assert {b: v for b, v in second.buckets.items() if b not in touched} == {b: v for b, v in first.buckets.items() if b not in touched}
    assert {r.k: r.v for r in table.read().collect()} == {k: int(k < 10) for k in range(1000)}
    assert {r.k: r.v for r in table.read(below=1).collect()} == dict.fromkeys(range(1000), 0)
    before = files_of(tmp_path / "t")
    assert table.update(1, rows(range(10), 77), change) == [] and files_of(tmp_path / "t") == before  # a replay
    # a crash between data and pointer: the old state stands, and the batch runs again
    broken = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=32)
    broken._publish = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        broken.update(2, rows([3], 2), change)
    assert {r.v for r in table.read().where("k = 3").collect()} == {1}
    table.update(2, rows([3], 2), change)
    table.update(3, rows([4], 3), change)
    assert {r.k: r.v for r in table.read().where("k < 6").collect()} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 1}
    # expired: only the last two snapshots are left, and no data but what they name
    assert sorted(f for f in files_of(tmp_path / "t") if f.startswith("snapshots/") and not f.endswith(".crc")) == ["snapshots/2.json", "snapshots/3.json"]
    named = {f"data/v={v}/bucket={b}" for n in (3, 4) for b, v in table.snapshot(below=n).buckets.items()}
    assert {f.rpartition("/")[0] for f in files_of(tmp_path / "t") if f.endswith(".parquet")} == named


def test_buckets_that_become_empty(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    rows = spark.createDataFrame([(k,) for k in range(40)], "k long")
    table.update(0, rows, lambda before, batch: batch)
    table.update(1, rows.where("k < 40"), lambda before, batch: before.limit(0))
    assert table.read().count() == 0 and table.read().columns == ["k"]


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_rebuild_equal_the_batch_in_any_order(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [("s", rnd.choice("abcde"), dt.date(2026, 9, rnd.randrange(1, 20)), rnd.choice([None, 5, 6, 7]), n) for n in range(40)] + [("s", "n", None, 5, 99)]
    rnd.shuffle(rows)
    schema = "source string, source_listing_id string, observed_on date, advertised_price long, seq long"
    base = str(tmp_path / "base")
    assert L.read_changes(spark, base) is None and L.read_late(spark, base).count() == 0
    for n in range(4):
        spark.createDataFrame(rows[n::4], schema).coalesce(1).write.json(str(tmp_path / "in" / f"b{n}"))
        source = spark.readStream.schema(schema).json(str(tmp_path / "in" / "b*"))
        L.stream_history(source, base, str(tmp_path / "cp"), delay_days=2, buckets=8).awaitTermination()
    all_ = spark.createDataFrame(rows, schema)
    want = sorted((tuple(r) for r in L.history_changes(history.listing_history(all_)).select(*CHANGED).collect()), key=str)
    assert sorted((tuple(r) for r in L.read_changes(spark, base).select(*CHANGED).collect()), key=str) == want
    times = [(r[0], r[1], dt.datetime.combine(r[2], dt.time(1)), r[3], r[4]) for r in rows if r[2]]
    assert want == plain_changes(times, dt.date(2027, 1, 1), grace=10_000)
    late, newest = set(), None
    for n in range(4):
        late |= {r[4] for r in rows[n::4] if newest and r[2] and (newest - r[2]).days > 2}
        newest = max([r[2] for r in rows[n::4] if r[2]] + ([newest] if newest else []))
    assert {r.seq for r in L.read_late(spark, base).collect()} == late and late


def test_webhooks_once(spark, tmp_path):
    schema = "processor string, signature string, received_at timestamp"
    batches = [[("p", "s1", at(1)), ("p", "s1", at(1))], [("p", "s1", at(2)), ("q", "s1", at(2))]]
    out = L.run_to_table(L.dedupe_webhooks(stream(spark, tmp_path / "in", batches, schema)), str(tmp_path / "cp"))
    assert sorted((r.processor, r.signature) for r in out.collect()) == [("p", "s1"), ("q", "s1")]


@pytest.mark.parametrize("end, want", [("2026-09-01", 1), ("2026-08-31", 0)])
def test_late_rows(spark, end, want):
    rows = spark.createDataFrame([("s", "a", at(1), 5, 0), ("s", "a", at(2), 5, 1)], OBS)
    assert L.late_observations(rows, end).count() == want


class Counted:
    """A bucket's state and timers in memory, that counts what is asked of it."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def getListState(self, name, schema):
        return self.State(self)

    getValueState = getMapState = getListState

    class State:
        def __init__(self, handle):
            self.handle, self.rows = handle, []

        def _counted(self, rows):
            self.handle.calls += 1
            self.rows = rows

        def appendList(self, rows):
            self._counted(self.rows + rows)

        def put(self, rows):
            self._counted(list(rows))

        def update(self, row):
            self._counted(row)

        def clear(self):
            self._counted([])

        def exists(self):
            self._counted(self.rows)
            return bool(self.rows)

        def get(self):
            self._counted(self.rows)
            return self.rows if isinstance(self.rows, tuple) else iter(self.rows)


def judged(processor, frames, watermarks):
    """What a processor gives for one bucket's frames, each followed by a watermark, and how much it asked of its state."""
    handle, out = Counted(), []
    processor.init(handle)
    for frame, now in zip(frames, watermarks):
        out += processor.handleInputRows((0,), iter([frame]), None)
        for ms in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(ms)
            at_ = type("T", (), {"getCurrentWatermarkInMs": lambda self: now, "getExpiryTimeInMs": lambda self: ms})()  # noqa: B023
            out += processor.handleExpiredTimer((0,), at_, at_)
    return [tuple(r) for f in out for r in f.astype(object).itertuples(index=False)], handle.calls


def test_the_state_of_many_holds_is_asked_a_few_times():
    rows = pd.DataFrame([(f"h{i}", i * 1000, "ACTIVE") for i in range(1000)], columns=["hold_id", "ms", "status"])
    ended = pd.DataFrame([(f"h{i}", i * 1000 + 60_000, "CONVERTED") for i in range(0, 1000, 2)], columns=["hold_id", "ms", "status"])
    got, calls = judged(L._Holds(15), [ended, rows], [-1, 10_000_000])
    assert sorted((h, s) for h, s, _ in got) == sorted((f"h{i}", s) for i in range(1000) for s in ("ACTIVE", "EXPIRED" if i % 2 else "CONVERTED"))
    assert calls < 30


def test_the_state_of_many_listings_is_asked_a_few_times():
    rnd = random.Random(3)
    rows = [("s", f"l{i}", dt.datetime(2026, 9, 1) + dt.timedelta(rnd.randrange(25)), rnd.choice([None, 5, 6, (1 << 53) + 1]), n) for n, i in enumerate(rnd.randrange(200) for _ in range(3000))]
    day = lambda d: (d.date() - dt.date(1970, 1, 1)).days
    frame = lambda part: pd.DataFrame({"source": [r[0] for r in part], "source_listing_id": [r[1] for r in part], "day": [day(r[2]) for r in part], "seq": [r[4] for r in part], "price": pd.Series([r[3] for r in part], dtype=object)})
    ends = [-1, L.DAY_MS * day(dt.datetime(2026, 10, 20))]
    got, calls = judged(L._Changes(7), [frame(rows[::2]), frame(rows[1::2])], ends)
    got = [tuple(None if v is pd.NA else v for v in r) for r in got]
    assert sorted(got, key=str) == plain_changes(rows, dt.date(2026, 10, 20)) and calls < 30
