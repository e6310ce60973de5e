"""Job progress and tracks as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.operators.jobs import status_now
from tagloom.operators.tracks import BOX, Follower

EVENT = "status string, progress int, message string, csv_path string, preview_path string, job_id bigint, event_ts timestamp"


def progress_events(lines: DataFrame) -> DataFrame:
    """Events from JSON lines (``value``); lines that are no events are dropped."""
    parsed = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    return lines.select(parsed.alias("e")).select("e.*").where("job_id is not null and status is not null")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return progress_events(spark.readStream.text(path))


def live_status(events: DataFrame) -> DataFrame:
    """The state of each job, updated as events come (output mode update or complete)."""
    return status_now(events)


def counts_by_window(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by status in tumbling windows of event time; later ones than ``late`` are dropped."""
    return events.withWatermark("event_ts", late).groupBy(F.window("event_ts", width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


# The states of a job after which nothing follows.
TERMINAL = ("done", "error")


def follow_jobs(events: DataFrame, snapshot: DataFrame, late: str = "1 day", linger_ms: int = 3_600_000) -> DataFrame:
    """job_id, event_id, status, progress, kind: for each job that has events the stored state first, then every change, to its terminal state.

    events: a stream of event_id, job_id, event_ts, status, progress, in the order of time across batches; snapshot: the
    stored state (job_id, status, progress). A queued event without progress is no step back from progress made, and an
    event that changes nothing is passed over. A snapshot row has event_id -1. At its terminal state a job's state
    shrinks to a mark that it is closed, which goes, as any state does, when events are ``late`` plus ``linger_ms`` ahead of the job's last.
    """
    stored = snapshot.select("job_id", F.col("status").alias("stored_status"), F.col("progress").cast("long").alias("stored_progress"))
    met = events.select("event_id", "job_id", F.col("event_ts").cast("timestamp"), "status", F.col("progress").cast("long").alias("progress")).withWatermark("event_ts", late).join(stored, "job_id", "left")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["event_ts", "event_id"])
        out = []
        if state.exists:
            closed, status, progress = state.get
        else:
            closed, status, progress = False, "", 0
            if isinstance(rows.stored_status.iloc[0], str):
                status, progress = rows.stored_status.iloc[0], int(rows.stored_progress.iloc[0])
                out.append((key[0], -1, status, progress, "snapshot"))
                closed = status in TERMINAL
        for e, s, p in zip(rows.event_id, rows.status, rows.progress, strict=True):
            if closed:
                break
            if (s == "queued" and p == 0 and progress > 0) or (s, p) == (status, progress):
                continue
            status, progress = s, int(p)
            out.append((key[0], e, status, progress, "change"))
            closed = status in TERMINAL
        state.update((closed, "" if closed else status, 0 if closed else progress))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows.event_ts.max().timestamp() * 1000)) + linger_ms)
        yield pd.DataFrame(out, columns=["job_id", "event_id", "status", "progress", "kind"])

    return met.groupBy("job_id").applyInPandasWithState(step, "job_id bigint, event_id bigint, status string, progress bigint, kind string", "closed boolean, status string, progress bigint", "append", GroupStateTimeout.EventTimeTimeout)


def follow_stream(boxes: DataFrame, least: float = 0.3, max_skip: int = 5, event_time: str | None = None, late: str = "10 minutes", linger_ms: int = 600_000) -> DataFrame:
    """Tracks of a stream of boxes (video, frame_idx, pos, box): the batch tracker's steps over state kept by video.

    Frames of a video must come in order across batches; within a batch they are sorted. The state is
    the last box of each live track, so it stays as small as a frame. event_time: a column of times, by which the
    state of a video goes when the stream is ``late`` plus ``linger_ms`` ahead of its last frame; without it, it stays.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begun, last = state.get if state.exists else (0, [])
        live = {int(r[0]): (int(r[1]), *r[2:]) for r in np.array(last).reshape(-1, 6).tolist()}
        out = Follower(least, max_skip, live, begun)
        rows = pd.concat(list(parts)).sort_values(["frame_idx", "pos"])
        track = out.run(rows.frame_idx.to_numpy(), rows[BOX].to_numpy(float))
        state.update((out.begun, [float(x) for t, v in out.live.items() for x in (t, *v)]))
        if event_time:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows[event_time].max().timestamp() * 1000)) + linger_ms)
        yield rows[["video", "pos"]].assign(track_id=track)

    timed = boxes.withWatermark(event_time, late) if event_time else boxes
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return timed.groupBy("video").applyInPandasWithState(step, "video int, pos bigint, track_id int", "begun int, live array<double>", "append", timeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, key: str = "batch"):
    """Each batch goes to a folder of its own, so that a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{key}={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
