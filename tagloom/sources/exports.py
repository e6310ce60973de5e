"""Exports that are rebuilt only where they are older than what they are made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _times(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """part, time: when a file of each partition was last written; only the listing is read. None if there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
    return files.groupBy(F.regexp_extract("path", f"/{key}=([^/]+)/", 1).alias("part")).agg(F.max("modificationTime").alias("time"))


def stale_parts(spark: SparkSession, source: str, target: str, key: str) -> list[str]:
    """The values of the partition column whose export is missing or older than a file of its source."""
    made, there = _times(spark, source, key), _times(spark, target, key)
    if there is not None:
        made = made.join(there.withColumnRenamed("time", "done"), "part", "left").where("done is null or done < time")
    return [r.part for r in made.select("part").orderBy("part").collect()]


def refresh(spark: SparkSession, source: str, target: str, key: str, build: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Rebuild the stale partitions of ``target`` by ``build`` and leave the others alone; what was rebuilt.

    Both are folders of Parquet, partitioned by ``key``, a column that ``build`` must keep. Where nothing is stale
    nothing is read or written. A run that breaks off leaves the partitions that it had not committed stale.
    """
    stale = stale_parts(spark, source, target, key)
    if stale:
        rows = spark.read.parquet(source).where(F.col(key).cast("string").isin(*stale))
        build(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(target)
    return stale
