"""Job progress, in batch and as a stream that is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import store
from tagloom.operators.jobs import status_now
from tagloom.operators.joins import work_path
from tagloom.plans.registry import query
from tagloom.plans.track_queries import TRACKS_SQL, moving_boxes
from tagloom.sources.adapters import VIEWS, view
from tagloom.streaming.jobs import follow_jobs, follow_stream, write_once

_STATUS = (
    "with l as (select job_id, arg_max(status, event_ts) as s, arg_max(progress, event_ts) as p, arg_max(status, event_ts) filter (where progress > 0 or status <> 'queued') as rs, arg_max(progress, event_ts) filter (where progress > 0 or status <> 'queued') as rp from job_events group by 1) "
    "select job_id, case when s = 'queued' and p = 0 and rs is not null then rs else s end as status, case when s = 'queued' and p = 0 and rs is not null then rp else p end as progress from l"
)


@query(_STATUS, "job_events")
def status_current(spark, sf_dir):
    return status_now(view(spark, sf_dir, "job_events"))


@query(_STATUS, "job_events")
def status_stream(spark, sf_dir):
    """The same as a streaming aggregate over the events table, run until it is drained."""
    told, path = status_now(live_events(spark, sf_dir)), work_path(spark, "status")

    def put(rows, _batch):
        rows.write.mode("overwrite").parquet(f"{path}/rows")

    spark.createDataFrame([], told.schema).write.parquet(f"{path}/rows")  # what there is without any event
    run = told.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(told.schema).parquet(f"{path}/rows")


def _is_folder(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def live_table(spark, sf_dir, name):
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if _is_folder(spark, path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def live_events(spark, sf_dir):
    """The view ``job_events`` over a stream."""
    return spark.sql(VIEWS["job_events"], events=live_table(spark, sf_dir, "events"))


def drained(stream, name):
    """All rows of a stream in append mode, each batch in a folder of its own, and the folder."""
    spark = stream.sparkSession
    path = work_path(spark, name)
    write_once(stream, f"{path}/rows", f"{path}/progress").awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows"), path


_CUT = "(select min(event_ts) + (max(event_ts) - min(event_ts)) / 2 as cut from job_events)"


@query(
    f"with past as (select e.* from job_events e, {_CUT} where event_ts < cut and status <> 'done'), snap as ({_STATUS.replace('from job_events', 'from past')}), "
    f"ev as (select e.*, row_number() over (partition by job_id order by event_ts, event_id) as k from job_events e, {_CUT} where event_ts >= cut), "
    "stop as (select job_id, min(k) as last from ev where status in ('done', 'error') group by 1), "
    "used as (select e.*, s.status as s0, s.progress as p0, last_value(case when e.status <> 'queued' or e.progress <> 0 then e.progress end ignore nulls) over (partition by e.job_id order by k rows between unbounded preceding and 1 preceding) as made "
    "from ev e left join stop using (job_id) left join snap s using (job_id) where last is null or k <= last), "
    "kept as (select *, lag(status) over (partition by job_id order by k) as ls, lag(progress) over (partition by job_id order by k) as lp from used where status <> 'queued' or progress <> 0 or coalesce(made, p0, 0) = 0) "
    "select job_id, event_id, status, progress, 'change' as kind from kept where status <> coalesce(ls, s0, '') or progress <> coalesce(lp, p0, 0) "
    "union all select job_id, cast(-1 as bigint), status, progress, 'snapshot' from snap where job_id in (select job_id from ev)",
    "job_events",
)
def job_follow(spark, sf_dir):
    """What a subscriber to each job is shown: the state of the first half of the time, then the changes of the second."""
    e = view(spark, sf_dir, "job_events")
    low, high = e.agg(F.min("event_ts"), F.max("event_ts")).first()
    cut = F.lit(str(low + (high - low) / 2)).cast("timestamp_ntz")
    snapshot = status_now(e.where((F.col("event_ts") < cut) & (F.col("status") != "done")))
    out, _ = drained(follow_jobs(live_events(spark, sf_dir).where(F.col("event_ts") >= cut), snapshot), "follow")
    return out


_STORE_EVENTS = (
    "select event_id, cast(floor(job_id / 3) as bigint) as job_id, event_ts, case when event_id % 11 = 0 then 'insert' when event_id % 29 = 0 then 'delete' else 'update' end as event, "
    "case when event_id % 2 = 0 then status end as status, case when event_id % 3 <> 0 then progress end as progress, case when event_id % 5 = 0 then 'at ' || progress end as message from "
)


@query(
    f"with e as (select *, row_number() over (partition by job_id order by event_ts, event_id) as k from ({_STORE_EVENTS} job_events)), "
    "marks as (select job_id, max(k) filter (where event = 'insert') as born, max(k) filter (where event = 'delete') as gone, max(event_ts) as updated_at from e group by 1) "
    "select e.job_id, any_value(event_ts) filter (where k = born) as created_at, any_value(updated_at) as updated_at, arg_max(status, k) filter (where event <> 'delete' and k >= born) as status, arg_max(progress, k) filter (where event <> 'delete' and k >= born) as progress, "
    "arg_max(message, k) filter (where event <> 'delete' and k >= born) as message from e join marks using (job_id) where born is not null and (gone is null or born > gone) group by 1",
    "job_events",
)
def job_store(spark, sf_dir):
    """A store of jobs kept by a stream in which every third event comes twice."""
    events = spark.sql(_STORE_EVENTS + "{e}", e=live_events(spark, sf_dir))
    path = work_path(spark, "store")
    store.upsert_stream(events.unionByName(events.where("event_id % 3 = 0")), f"{path}/jobs", f"{path}/progress").awaitTermination()
    jobs = store.live(store.read_state(spark, f"{path}/jobs"))
    return jobs.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


@query(TRACKS_SQL, "detections")
def track_stream(spark, sf_dir):
    """The tracker as a stateful stream over the table of line items."""
    lines = live_table(spark, sf_dir, "lineitem")
    part, catalog = (view(spark, sf_dir, n) for n in ("part", "catalog"))
    boxes = moving_boxes(spark.sql(VIEWS["detections"], lineitem=lines, part=part, catalog=catalog))
    return drained(follow_stream(boxes), "tracks")[0]


@query("select to_timestamp(floor(epoch(event_ts) / 3600) * 3600)::timestamp as start, status, count(*) as n from job_events group by 1, 2", "job_events")
def events_by_hour(spark, sf_dir):
    e = view(spark, sf_dir, "job_events")
    return e.groupBy(F.window("event_ts", "1 hour").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")
