"""Greedy operators against plain loops, bands against all pairs, streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import evaluate, jobs, joins, tracks
from tagloom.streaming import jobs as stream

TAG = "video int, pos bigint, confidence int, barcode string, frame_timestamp bigint, x_min int, y_min int, x_max int, y_max int"


def tags(n, seed, videos=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.randrange(60), r.randrange(60)
        out.append((r.randrange(videos), i, r.choice([10, 50, 50, 80]), r.choice(["", "460123456789", None]), r.randrange(6000), x, y, x + r.randrange(5, 40), y + r.randrange(5, 40)))
    return out


def overlap(a, b, union):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    p, q = (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    return w * h / ((p + q - w * h) if union else min(p, q))


def test_golden_suppression(spark):
    rows = [(1, 0, 9, "", 0, 0, 0, 10, 10), (1, 1, 8, "", 2000, 4, 0, 14, 10), (1, 2, 8, "", 4000, 4, 0, 14, 10)]
    assert {r.pos for r in tracks.suppress(spark.createDataFrame(rows, TAG), 3000).collect()} == {0, 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_suppress(spark, seed):
    rows = tags(120, seed)
    kept = []
    for t in sorted(rows, key=lambda t: (-(len(t[3] or "") >= 12), -t[2], -(t[7] - t[5]) * (t[8] - t[6]), t[1])):
        if not any(k[0] == t[0] and abs(k[4] - t[4]) <= 1000 and overlap(k[5:], t[5:], False) >= 0.5 for k in kept):
            kept.append(t)
    assert {r.pos for r in tracks.suppress(spark.createDataFrame(rows, TAG), 1000).collect()} == {k[1] for k in kept}


def test_match_by_place(spark):
    rows = tags(80, 5)
    df = spark.createDataFrame(rows, TAG)
    gt, pred = df.where("pos % 2 = 0"), df.where("pos % 2 = 1")
    got = {(r.gt_pos, r.pred_pos) for r in evaluate.match_by_place(gt, pred, tolerance_ms=2000, least=0.2).collect()}
    free, want = {t[1]: t for t in rows if t[1] % 2 == 0}, set()
    for p in sorted((t for t in rows if t[1] % 2), key=lambda t: (-(t[7] - t[5]) * (t[8] - t[6]), t[1])):
        near = [(-overlap(p[5:], g[5:], True), g[1]) for g in free.values() if g[0] == p[0] and abs(g[4] - p[4]) <= 2000 and overlap(p[5:], g[5:], True) >= 0.2]
        if near:
            want.add((min(near)[1], p[1]))
            del free[min(near)[1]]
    assert got == want


def test_band_join(spark):
    rows = tags(90, 7)
    df = spark.createDataFrame(rows, TAG)
    for strict in (True, False):
        got = sorted((r.pos, r.r_pos) for r in joins.band_join(df, df, ["video"], "frame_timestamp", 250, strict).collect())
        want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and (abs(a[4] - b[4]) < 250 if strict else abs(a[4] - b[4]) <= 250))
        assert got == want
        assert "CartesianProduct" not in joins.band_join(df, df, ["video"], "frame_timestamp", 250, strict)._jdf.queryExecution().executedPlan().toString()


def test_tracker_gap(spark):
    box = (0, 0, 10, 10)
    make = lambda a, b: spark.createDataFrame([(1, a, 0, *box), (1, b, 1, *box)], "video int, frame_idx bigint, pos bigint, x_min int, y_min int, x_max int, y_max int")
    ids = lambda df: len({r.track_id for r in tracks.follow(df).collect()})
    assert ids(make(0, 5)) == 1 and ids(make(0, 6)) == 2


def test_stream_tracker_equals_batch(spark, tmp_path):
    rows = [(t[0], t[4] // 100, t[1], *t[5:]) for t in tags(150, 3)]
    schema = "video int, frame_idx bigint, pos bigint, x_min int, y_min int, x_max int, y_max int"
    df = spark.createDataFrame(rows, schema)
    want = {(r.pos, r.track_id) for r in tracks.follow(df).collect()}
    for k, part in enumerate((df.where("frame_idx < 30"), df.where("frame_idx >= 30"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = stream.follow_stream(source).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.pos, r.track_id) for r in spark.table("tracked").collect()} == want


def test_events_store(spark):
    rows = [(1, 1, "insert", "queued", 0), (1, 2, "update", "processing", None), (1, 3, "update", None, 40), (2, 1, "insert", "queued", 0), (2, 5, "delete", None, None)]
    df = spark.createDataFrame(rows, "job_id int, event_ts int, event string, status string, progress int")
    got = jobs.current(df).collect()
    assert [(r.job_id, r.status, r.progress) for r in got] == [(1, "processing", 40)]


def test_bad_lines_are_dropped(spark):
    lines = spark.createDataFrame([('{"status":"done","progress":1,"job_id":3}',), ("{bad",), ("{}",)], "value string")
    assert [r.job_id for r in stream.progress_events(lines).collect()] == [3]


def test_write_once(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        stream.write_once(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_windows_by_time(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(10).select(F.timestamp_seconds(F.col("id") * 300).alias("event_ts"), F.lit("done").alias("status"))
    assert stream.counts_by_window(df).count() == 5
