"""Jobs: filters, an event-sourced store, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT_FIELDS = ("status", "progress", "message", "csv_path", "preview_path", "files_deleted_at")


def latest(jobs: DataFrame, user_id: int | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest jobs, 1 to 200 of them, of a user or status if given."""
    if user_id is not None:
        jobs = jobs.where(F.col("user_id") == user_id)
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    return jobs.orderBy(F.col("created_at").desc(), "id").limit(max(1, min(200, limit)))


def since(as_of: Column, days: int) -> Column:
    """The moment ``days`` (1 to 365) before ``as_of``."""
    return as_of - F.make_dt_interval(F.lit(max(1, min(365, days))))


def in_range(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    return jobs.where(F.col("created_at") >= since(as_of, days))


def expired(jobs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Ended jobs older than ``days`` whose files are still there."""
    return jobs.where(F.col("status").isin("done", "error") & (F.col("created_at") < since(as_of, days)) & F.col("files_deleted_at").isNull())


def current(events: DataFrame) -> DataFrame:
    """The state of each job: of each field the last value that an event supplied; deleted jobs are left out.

    events: job_id, event_ts, event (insert, update or delete) and any of the fields.
    """
    fields = [c for c in EVENT_FIELDS if c in events.columns]
    ts = F.col("event_ts")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), ts))
    state = events.groupBy("job_id").agg(
        F.min(F.when(F.col("event") == "insert", ts)).alias("created_at"), F.max(ts).alias("updated_at"), F.max_by("event", ts).alias("__last"), *[last(c).alias(c) for c in fields]
    )
    return state.where("__last <> 'delete'").drop("__last")


def status_now(events: DataFrame) -> DataFrame:
    """job_id, status, progress: the last event that is no step back (a queued event of no progress does not override progress made)."""
    made = F.max("progress").alias("progress_made")
    at = F.struct("event_ts", "progress", "status")  # of events of one time, the furthest
    told = events.groupBy("job_id").agg(
        F.max_by(F.struct("status", "progress"), at).alias("last"),
        F.max_by(F.struct("status", "progress"), F.when((F.col("progress") > 0) | (F.col("status") != "queued"), at)).alias("real"), made,
    )
    pick = F.when((F.col("last.status") == "queued") & (F.col("last.progress") == 0) & F.col("real").isNotNull(), F.col("real")).otherwise(F.col("last"))
    return told.withColumn("s", pick).select("job_id", F.col("s.status").alias("status"), F.col("s.progress").alias("progress"))


def merge_runtime(stored: DataFrame, runtime: DataFrame, fields: tuple[str, ...] = ("status", "progress", "message")) -> DataFrame:
    """Stored jobs, each field overridden by the queue's value if it has one."""
    other = runtime.select("id", *[F.col(f).alias("r_" + f) for f in fields])
    return stored.join(other, "id", "left").withColumns({f: F.coalesce(F.col("r_" + f), F.col(f)) for f in fields}).drop(*["r_" + f for f in fields])


def health(checks: DataFrame) -> DataFrame:
    """status over checks (name, ok, critical): unhealthy if a critical one fails, degraded if another does."""
    bad = lambda critical: F.count_if(~F.col("ok") & (F.col("critical") == critical)) > 0
    return checks.agg(F.when(bad(True), "unhealthy").when(bad(False), "degraded").otherwise("ok").alias("status"))


def upload_problem(extension: Column, mime: Column, size: Column, seconds: Column, width: Column, height: Column) -> Column:
    """The first rule that an upload breaks, or null."""
    return (
        F.when(~F.lower(extension).isin("mp4", "avi", "mov", "mkv"), "extension").when(~F.lower(mime).startswith("video/"), "mime")
        .when(size > 500 * 1024 * 1024, "size").when(seconds > 300, "duration").when(~width.between(320, 3840) | ~height.between(240, 2160), "resolution")
    )


def latest_active(jobs: DataFrame, newest: int = 20) -> DataFrame:
    """user_id, id: of each user's ``newest`` jobs the newest that is queued or processing and was not revoked."""
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), "id")
    recent = jobs.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= newest)
    active = recent.where(F.col("status").isin("queued", "processing") & ~F.lower(F.coalesce("message", F.lit(""))).contains("revoked"))
    return active.groupBy("user_id").agg(F.min_by("id", "__n").alias("id"))


def duration_histogram(seconds: DataFrame, column: str, bounds: tuple[int, ...]) -> DataFrame:
    """le, jobs: how many took at most so many seconds, for each bound and, as null, for all."""
    counts = seconds.agg(*[F.count_if(F.col(column) <= b).alias(f"b{b}") for b in bounds], F.count(column).alias("every"))
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"b{b}").alias("jobs")) for b in bounds]
    return counts.select(F.explode(F.array(*rows, F.struct(F.lit(None).cast("int").alias("le"), F.col("every").alias("jobs")))).alias("r")).select("r.*")


def size_label(size: Column) -> Column:
    """``12.34 MB``, or GB from 1024 MB on; ties go to the even digit."""
    unit = F.when(size >= 1 << 30, F.lit(1 << 30)).otherwise(F.lit(1 << 20))
    whole, rest = F.floor(size * 100 / unit), size * 100 % unit
    cents = whole + F.when((rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.when(size >= 1 << 30, " GB").otherwise(" MB"))
