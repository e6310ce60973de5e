"""A store of jobs as versioned snapshots, written by batches of events that may come more than once.

An event inserts a job, updates those fields that it supplies, or deletes a job. The store keeps of every
field the last value with its time, so that events may come in any order and again: a snapshot is a
fold of structs by greatest time, and folding an event twice changes nothing. A batch writes a snapshot beside
the old one and then marks it as current by creating one empty file, which either happens or does not: a
crash before leaves the old snapshot current, and a batch that is run again after it is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = {"status": "string", "progress": "bigint", "message": "string"}
MARK = "current-"


def empty_state(spark: SparkSession, fields: dict[str, str] = FIELDS) -> DataFrame:
    at = "struct<ts:timestamp,id:bigint>"
    values = ", ".join(f"{f} struct<at:{at},value:{kind}>" for f, kind in fields.items())
    return spark.createDataFrame([], f"job_id bigint, inserted {at}, deleted {at}, updated {at}, {values}")


def as_state(events: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """Events (event_id, job_id, event_ts, event and the fields) in the form of the state."""
    at = F.struct(F.col("event_ts").alias("ts"), F.col("event_id").alias("id"))
    only = lambda kind: F.when(F.col("event") == kind, at)
    given = lambda f, kind: F.when(F.col(f).isNotNull() & (F.col("event") != "delete"), F.struct(at.alias("at"), F.col(f).cast(kind).alias("value")))
    return events.select("job_id", only("insert").alias("inserted"), only("delete").alias("deleted"), at.alias("updated"), *[given(f, kind).alias(f) for f, kind in fields.items()])


def fold(states: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    return states.groupBy("job_id").agg(*[F.max(c).alias(c) for c in ("inserted", "deleted", "updated", *fields)])


def live(state: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """job_id, created_at, updated_at and the fields of the jobs that were inserted after they were last deleted; what came before counts no more."""
    here = F.col("inserted").isNotNull() & (F.col("deleted").isNull() | (F.col("inserted") > F.col("deleted")))

    def value(f: str) -> Column:
        return F.when(F.col(f)["at"] >= F.col("inserted"), F.col(f)["value"])

    return state.where(here).select("job_id", F.col("inserted.ts").alias("created_at"), F.col("updated.ts").alias("updated_at"), *[value(f).alias(f) for f in fields])


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, path: str) -> int | None:
    """The number of the current snapshot, which is that of the batch that wrote it."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return max((int(n.removeprefix(MARK)) for n in names if n.startswith(MARK)), default=None)


def read_state(spark: SparkSession, path: str, fields: dict[str, str] = FIELDS) -> DataFrame:
    at, none = version(spark, path), empty_state(spark, fields)
    return none if at is None else spark.read.schema(none.schema).parquet(f"{path}/v={at}")


def apply_batch(spark: SparkSession, path: str, events: DataFrame, batch: int, fields: dict[str, str] = FIELDS, keep: int = 2) -> bool:
    """Fold a batch of events into the store; False if it was folded in before. The last ``keep`` snapshots stay."""
    at = version(spark, path)
    if at is not None and at >= batch:
        return False
    fold(read_state(spark, path, fields).unionByName(as_state(events, fields)), fields).write.mode("overwrite").parquet(f"{path}/v={batch}")
    fs, mark = _files(spark, f"{path}/{MARK}{batch}")
    fs.create(mark, True).close()
    for status in fs.listStatus(mark.getParent()):
        name = status.getPath().getName()
        number = name.removeprefix("v=").removeprefix(MARK)
        if number.isdigit() and int(number) <= batch - keep:
            fs.delete(status.getPath(), True)
    return True


def upsert_stream(events: DataFrame, path: str, checkpoint: str, late: str = "1 day", fields: dict[str, str] = FIELDS):
    """Fold a stream of events into the store until it is drained; an event that comes again within ``late`` is dropped before."""
    once = events.withColumn("event_ts", F.col("event_ts").cast("timestamp")).withWatermark("event_ts", late).dropDuplicatesWithinWatermark(["event_id"])
    put = lambda rows, number: apply_batch(rows.sparkSession, path, rows, number, fields)
    return once.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
