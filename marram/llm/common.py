"""What the operators of this subpackage share: checkpoints, checked broadcasts, row keys."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if it has at most so many rows; every caller's rows are of a bounded width.
BROADCAST_ROWS = 200_000
#: Rows that a Python function handles at once.
SLICE_ROWS = 512
#: Rows of an Arrow batch. Texts are long: at Spark's default a batch takes tens of megabytes on both sides of the pipe.
BATCH_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is the session's; one is made only where none is set and the master is
    local, as in tests: elsewhere executors would not see it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="marram-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that was written for one use, wherever Spark's file systems keep it; an absent one does no harm."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame) -> DataFrame:
    """df computed once, with its lineage cut by a reliable checkpoint: a lost executor costs a reread, not a new run."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once for a context, so that their Python finds it wherever the driver does.

    A package that is no folder, as one sent with --py-files, is there already."""
    import marram

    context, folder = spark.sparkContext, Path(marram.__file__).parent
    if getattr(context, "_marram_sent", False) or not folder.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="marram-package-")) / "marram_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(folder.rglob("*.py")):
            z.write(f, f.relative_to(folder.parent))
    context.addPyFile(str(target))
    context._marram_sent = True


def prepare(spark: SparkSession) -> None:
    """Readies a session for Python in tasks: the package is sent, and Arrow batches are lowered to BATCH_ROWS rows where they
    are larger."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front until no column of df is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def extend(df: DataFrame, text_col: str, columns: str, make, kind: str = "string") -> DataFrame:
    """df with more columns, made from the Arrow array of one column (cast to `kind`) by make(array) -> arrays.

    Every row and column passes through; a column of df that has the name of a new one, in any case, gives way to it.
    """
    spark = df.sparkSession
    prepare(spark)
    added = spark.createDataFrame([], columns).schema
    names = {f.name.lower() for f in added}
    kept = [c for c in df.columns if c.lower() not in names]
    same = text_col in kept and df.schema[text_col].dataType.simpleString() == kind  # then it need not travel twice
    extra = [] if same else [F.col(f"`{text_col}`").cast(kind).alias(free_name(df, "text_in"))]
    source = df.select(*[F.col(f"`{c}`") for c in kept], *extra)
    schema = T.StructType([*source.schema.fields[: len(kept)], *added.fields])
    last, at_text, titles = len(kept), kept.index(text_col) if same else len(kept), [*kept, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *make(part.column(at_text))], names=titles)

    return source.mapInArrow(run, schema)
