"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ_BATCH = "spark.sql.parquet.columnarReaderBatchSize"
SIEVE_BITS = 1 << 24


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may name none, as in tests: a temporary folder stands in.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tagloom.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("tagloom.shared.dir", path)
    return path.rstrip("/")


_left: dict[str, set[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _left.get(spark.sparkContext.applicationId, set()).discard(path)


def clear(spark: SparkSession) -> int:
    """Delete all that the operators of this session have written and not deleted yet, and tell how much; results that read it are void."""
    paths = list(_left.get(spark.sparkContext.applicationId, ()))
    for path in paths:
        delete(spark, path)
    return len(paths)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files at its end instead of when the driver next collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, True)
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside reads from files, and hands to Python, at most so many rows at once, for rows that may be large."""
    before = {c: spark.conf.get(c) for c in (BATCH, READ_BATCH)}
    spark.conf.set(BATCH, rows)
    spark.conf.set(READ_BATCH, min(rows, int(before[READ_BATCH])))
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def in_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on in this session at most so many rows go to Python at once, since texts may be long."""
    spark.conf.set(BATCH, min(rows, int(spark.conf.get(BATCH))))


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote; nothing may read these tables any more."""
    for t in tables:
        delete(t.sparkSession, t.scratch_path)


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``size`` bytes of the strings in ``column``; a longer string is in a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def sieve(keys: DataFrame, key: str, bits: int = SIEVE_BITS) -> DataFrame:
    """A bitmap of ``bits`` bits in which the hash of every key is set: at most ``bits`` / 64 rows (word, held), whatever the number of keys."""
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    held = keys.select(bit.alias("b")).select(F.expr("b div 64").alias("__word"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("one"))
    return held.groupBy("__word").agg(F.bit_or("one").alias("__held"))


def sifted(rows: DataFrame, key: str, bitmap: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """``rows`` with ``__may``: false where ``key`` is surely none of the keys of the bitmap, which is broadcast (its size is bounded)."""
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(bits))
    met = rows.withColumn("__bit", bit).withColumn("__word", F.expr("__bit div 64")).join(F.broadcast(bitmap), "__word", "left")
    return met.withColumn("__may", F.coalesce(F.expr("getbit(__held, cast(__bit % 64 as int)) = 1"), F.lit(False))).drop("__word", "__bit", "__held")


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is none of ``ids`` (a table of that one column); only rows that the ids' bitmap lets through are shuffled."""
    met = sifted(rows, key, sieve(ids, key))
    some = met.where("__may").join(ids.hint("merge"), key, "left_anti")
    return met.where("not __may").unionByName(some).drop("__may")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: F.Column) -> F.Column:
    """The fold that no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int = 64_000_000) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, and ``most_bytes`` of whole texts, chosen by a hash of doc_id.

    Both bound what training collects: texts are taken in the order of the hash as long as they fit, longer ones
    are passed over. The choice is the same at any partitioning.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(*order).limit(rows)
    )
    of_id = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # rows that share a doc_id count once, so that ``rows`` bounds the rows as well
    once = of_id.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    # no more than ``rows`` rows, in one window
    fits = once.select("doc_id", size.alias("size")).where(F.col("size") <= most_bytes).withColumn("total", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return once.join(F.broadcast(fits.where(F.col("total") <= most_bytes).select("doc_id")), "doc_id", "left_semi")
