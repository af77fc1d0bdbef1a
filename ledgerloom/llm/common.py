"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every operator here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of an Arrow batch where the session has Spark's own 10,000, and its bytes where it has 64 MB: whole texts and blocks of rows are held by Spark, outside its heap, and by Python at a time.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. The session's Arrow batches become smaller, unless it has its own size for them."""
    for setting, default, own in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        name_of = f"spark.sql.execution.arrow.{setting}"
        if spark.conf.get(name_of) == default:
            spark.conf.set(name_of, own)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, and not only when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like the given one that no frame has, whatever the case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Tables pinned inside scratch() blocks, the innermost block last.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What is pinned inside goes at the end, but for tables pinned with keep=True."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        unpin(*_SCRATCH.pop())


def pin(df: DataFrame, by: str | None = None, keep: bool = False) -> DataFrame:
    """Cuts lineage: writes df once as a Parquet table in the shared folder and reads it back.

    Later passes read the same rows even if executors are lost, which generated row ids
    and sampled range bounds need. `by` names the step in the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{by or 'step'}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pinned_at = path
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(out)
    return out


def unpin(*frames: DataFrame | None) -> None:
    """Removes pinned tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_pinned_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def lower_ascii(c: Column) -> Column:
    """A-Z only, as the contracts ask; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Words of a text as a long; null: 0."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_interval(*cols: Column) -> Column:
    """A hash of the columns as an integer in [0, 2^31)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 33)


def give_back() -> None:
    """Free memory of this process goes back to the system: workers wait for their next task beside others, and allocators keep what a task has freed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Rows that a function on texts gets at a time, so that a worker holds few texts and results besides the batch it reads.
SLICE_ROWS = 256


def map_slices(df: DataFrame, start: Callable[[], Callable[..., list[tuple]]], schema: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """df through a function that makes rows of `schema` from the column lists of a few rows at a time.

    start() is called once a task and returns that function, so it can hold caches.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    types = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                rows = work(*[c.to_pylist() for c in part.columns])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=target.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=target)
        del work
        give_back()

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, start: Callable[[], Callable[..., Iterator[list[pa.Array]]]], schema: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Like map_slices, but the function gives Arrow columns for many rows at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                for columns in work(*batch.slice(at, slice_rows).columns):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)
        del work
        give_back()

    return df.mapInArrow(run, schema)
