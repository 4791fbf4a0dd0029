"""Keyed state tables for streams: buckets by key hash, of which a batch rewrites only those it touches.

A table is a folder. `data/v=<batch>/bucket=<k>` holds the buckets that a batch wrote, `snapshots/<batch>.json` says which batch each bucket was
last written by. A snapshot appears by one rename after all its data is there, so a reader sees the state before a batch or behind it and a
crash in between leaves the old one. A batch that has its snapshot is never written again. Old snapshots, and
the data that only they name, are removed once enough newer ones are there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Snapshot:
    """What a batch left: by bucket the batch that wrote it last, the columns (as JSON), and facts that its writer keeps."""

    batch: int
    buckets: dict[int, int]
    schema: str
    facts: dict = field(default_factory=dict)


class BucketTable:
    """A table of rows by key. keys: its key columns; buckets: how many, fixed by the first batch; keep: snapshots that stay.

    The driver holds a number for each bucket. Writers of one table go one after another, as the batches of a stream do."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.buckets, self.keep = spark, path, keys, buckets, max(1, keep)
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _batches(self) -> list[int]:
        folder = self._at("snapshots")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def snapshot(self, below: int | None = None) -> Snapshot | None:
        """The last snapshot, or the last of a batch before `below`; None without any."""
        found = [b for b in self._batches() if below is None or b < below]
        if not found:
            return None
        stream = self._fs.open(self._at(f"snapshots/{found[-1]}.json"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(said["batch"], {int(k): v for k, v in said["buckets"].items()}, said["schema"], said["facts"])

    def done(self, batch: int) -> bool:
        return self._fs.exists(self._at(f"snapshots/{batch}.json"))

    def read(self, below: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows of the last snapshot, or of the last before a batch; only: of these buckets. None before the first batch."""
        last = self.snapshot(below)
        if last is None:
            return None
        schema = T.StructType.fromJson(json.loads(last.schema))
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(last.buckets.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of these rows lie in."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def commit(self, batch: int, rows: DataFrame, touched: list[int], facts: dict | None = None) -> None:
        """Makes rows the whole content of the touched buckets; rows must lie in these. Does nothing if the batch has been committed."""
        if self.done(batch):
            return
        before = self.snapshot()
        tasks = max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        placed = rows.withColumn("bucket", self.bucket()).repartition(tasks, "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={batch}")
        written = {int(f.getPath().getName()[7:]) for f in self._fs.listStatus(self._at(f"data/v={batch}")) if f.getPath().getName().startswith("bucket=")}
        buckets = {b: v for b, v in (before.buckets if before else {}).items() if b not in touched} | dict.fromkeys(written, batch)
        said = {"batch": batch, "buckets": buckets, "schema": rows.schema.json(), "facts": facts or {}}
        self._publish(f"snapshots/{batch}.json", json.dumps(said, sort_keys=True))
        self._expire()

    def _publish(self, name: str, text: str) -> None:
        hidden, final = self._at(f"_{name.replace('/', '-')}"), self._at(name)
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(hidden, final):
            raise RuntimeError(f"{final} could not be put in place")

    def _expire(self) -> None:
        """Old snapshots go first, then the data of batches that no snapshot names any more."""
        batches = self._batches()
        for b in batches[: -self.keep]:
            self._fs.delete(self._at(f"snapshots/{b}.json"), False)
        kept = batches[-self.keep :]
        named = {(v, b) for k in kept for b, v in self.snapshot(k + 1).buckets.items()}
        for folder in self._fs.listStatus(self._at("data")):
            v = int(folder.getPath().getName()[2:])
            if v <= kept[-1]:  # a later one may be on its way
                for sub in self._fs.listStatus(folder.getPath()):
                    name = sub.getPath().getName()
                    if name.startswith("bucket=") and (v, int(name[7:])) not in named:
                        self._fs.delete(sub.getPath(), True)
                if v not in {x for x, _ in named}:
                    self._fs.delete(folder.getPath(), True)

    def update(self, batch: int, rows: DataFrame, change: Callable[[DataFrame | None, DataFrame], DataFrame], facts: dict | None = None) -> list[int]:
        """Writes change(rows of the touched buckets before this batch, rows) as the new content of the buckets that rows touch, and returns
        these. change gets None before the first batch."""
        if self.done(batch):
            return []
        touched = self.touched(rows)
        before = self.read(below=batch, only=touched)
        self.commit(batch, change(before, rows), touched, facts)
        return touched
