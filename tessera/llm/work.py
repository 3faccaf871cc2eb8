"""The shared work folder, and small helpers that every operator here uses.

Intermediate tables are cut off their lineage by writing them as Parquet below the folder in ``spark.checkpoint.dir``,
which the driver and all executors share, so a lost executor costs at most the tasks that it held.  Only where that
setting is missing in a local session (tests, a laptop) a temporary folder takes its place; a cluster without it raises.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_SETTLED: dict[int, tuple[weakref.ref, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where a local session leaves it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:  # with its scheme, as a path without one means the cluster's default store
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return (whole if "://" in whole else whole.replace("file:/", "file:///", 1)).rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _FALLBACK:
        _FALLBACK[key] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _FALLBACK[key]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh URI in the shared folder."""
    return f"{shared_folder(spark)}/tessera/{label}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a statement as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage and its shuffle files end here."""
    spark = df.sparkSession
    uri = scratch(spark, label)
    schema = df.schema
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(uri)
    finally:
        spark.conf.set(_CLEAN, before)
    found = spark.read.schema(schema).parquet(uri)
    _SETTLED[id(found)] = (weakref.ref(found), uri)
    return found


#: Spark's limit on what goes to and from Python at once; 64 MB by default, of which a task holds several copies.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """From here on the session's Arrow batches have about ``size`` bytes at most, unless it has set a limit of its own."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, size)


def discard(*settled: DataFrame) -> None:
    """Deletes settled tables.  Only for those that no frame still to be computed reads: later tables are written by then."""
    for df in settled:
        ref, uri = _SETTLED.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def put_bytes(uri: str, *parts: bytes) -> None:
    """Writes one object whole: under another name first, then renamed, so that no reader sees half of it."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    partial = f"{path}.{uuid.uuid4().hex}.partial"
    with store.open_output_stream(partial) as out:
        for part in parts:
            out.write(part)
    store.move(partial, path)


def get_bytes(uri: str) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as source:
        return source.read()


def mapped(uri: str) -> pa.Buffer:
    """A file's bytes: mapped into memory where the store is a local one, else read."""
    store, path = fs.FileSystem.from_uri(uri)
    with pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path) as source:
        return source.read_buffer()


def local_file(uri: str) -> tuple[str, bool]:
    """A path that can be memory-mapped: the file itself, or a copy where the store is not a local one (true then)."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return path, False
    handle, copy = tempfile.mkstemp(prefix="tessera-")
    with store.open_input_stream(path) as source, os.fdopen(handle, "wb") as out:
        while block := source.read(1 << 22):
            out.write(block)
    return copy, True


def row_key(*names: str) -> Column:
    """A 64-bit key of a row's contents; equal rows share it, null ids included."""
    return F.xxhash64(*names)


def smallest_hashes(rows: DataFrame, key: str, n: int, total: int, by: str | None = None, most: int = 1) -> DataFrame:
    """(by, key): of each value of ``by`` the distinct keys with the smallest hashes, n at most and total / values at most.

    Estimated numbers of distinct keys give a bound on the hashes that leaves about four times as many keys of each value,
    so no task ranks more, however common a value is; some are missing with a chance below 1e-100.  Only the ``most`` values
    with most keys count; the driver holds a row for each.  Without ``by`` all rows are one group.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))
    estimate = F.approx_count_distinct(key).alias("d")
    if by is None:
        bound = (4.0 * n + 100) / max(rows.agg(estimate).first()["d"], 1)
        near = rows.where(place <= F.lit(bound)).select(key).distinct()
        return near.orderBy(F.xxhash64(key), key).limit(min(n, total))
    sizes = rows.groupBy(by).agg(estimate).orderBy(F.desc("d"), by).limit(most).collect()
    n = max(1, min(n, total // max(len(sizes), 1)))
    bounds = rows.sparkSession.createDataFrame([(r[by], (4.0 * n + 100) / r["d"]) for r in sizes], f"of {rows.schema[by].dataType.simpleString()}, bound double")
    near = rows.join(F.broadcast(bounds), F.col(by) == F.col("of")).where(place <= F.col("bound")).select(by, key).distinct()
    order = Window.partitionBy(by).orderBy(F.xxhash64(key), key)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(by, key)


@contextmanager
def without_gc() -> Iterator[None]:
    """No rounds of the cycle collector inside: for code that makes many small objects and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def private(label: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case of theirs."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = f"tessera_{label}"
    while name in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
