"""Matching in rounds, chains by pointer jumping, nearest groups, codes with gaps, the store and exports, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tagloom.operators import catalog, joins, providers, store
from tagloom.operators.jobs import status_now
from tagloom.sources import exports, readers
from tagloom.streaming import jobs as stream


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_is_the_greedy_choice(spark, seed):
    r = random.Random(seed)
    edges = list({(v, r.randrange(25), r.randrange(25)): (v, r.randrange(6)) for v in range(3) for _ in range(120)}.items())
    rows = [(v, a, b, w) for (v, a, b), (_, w) in edges] + [(7, k, k + d, 5 - d) for k in range(12) for d in (0, 1)]
    got = joins.one_to_one(spark.createDataFrame(rows, "video int, l int, r int, cost int"), ["video"], "l", "r", ["cost"]).collect()
    used_l, used_r, want = set(), set(), set()
    for cost, a, b, v in sorted((c, a, b, v) for v, a, b, c in rows):
        if (v, a) not in used_l and (v, b) not in used_r:
            used_l.add((v, a))
            used_r.add((v, b))
            want.add((v, a, b))
    assert {(x.video, x.l, x.r) for x in got} == want and len(got) == len(want)


def kept_by_fold(rows, stride, sharp, least):
    out = set()
    for video in {r[0] for r in rows}:
        last, moved = None, 0
        for _, n, ts, sharpness, difference in sorted(r for r in rows if r[0] == video):
            moved += difference
            if sharpness >= sharp and (last is None or (ts - last >= stride and moved >= least)):
                out.add((video, n))
                last, moved = ts, 0
    return out


@pytest.mark.parametrize("stretch", [10_000, 7, 40])
@pytest.mark.parametrize(("stride", "least"), [(300, 9), (0, 9), (300, 0), (0, 0), (10**7, 1), (1, 10**7)])
def test_key_frames_equal_the_fold(spark, monkeypatch, stretch, stride, least):
    monkeypatch.setattr(providers, "STRETCH", stretch)
    r = random.Random(3)
    rows = []
    for video in ("a", "b", "c"):
        n = ts = 0
        for _ in range(150):
            n += r.choice([1, 1, 2, 30])
            ts += r.choice([0, 20, 40, 900])
            rows.append((video, n, ts, r.randrange(10), r.choice([0, 0, 0, 1, 5]) if n % 300 < 150 else 0))
    rows += [("blurred", 1, 0, 0, 5), ("one", 4, 0, 9, 0)]
    frames = spark.createDataFrame(rows, "video string, frame_idx bigint, frame_ts_ms bigint, sharpness int, difference int").repartition(3)
    assert {(x.video, x.frame_idx) for x in providers.kept_frames(frames, stride, 3, least).collect()} == kept_by_fold(rows, stride, 3, least)


def test_reached(spark):
    links = [(1, k, k + 3) for k in range(0, 100)] + [(2, k, k + 1) for k in range(5)] + [(3, 9, None)]
    got = joins.reached(spark.createDataFrame(links, "video int, n int, to int"), spark.createDataFrame([(1, 1), (2, 4), (3, 9)], "video int, n int"), ["video"]).collect()
    assert {(x.video, x.n) for x in got} == {(1, k) for k in range(1, 103, 3)} | {(2, 4), (2, 5), (3, 9)} and len(got) == 37


def test_nearest_group(spark):
    r = random.Random(5)
    values = [(v, r.randrange(3000)) for v in range(3) for _ in range(14)]
    asked = [(k, r.randrange(4), r.randrange(-500, 3500)) for k in range(300)]
    got = {x.pos: (x.anchor, x.n) for x in joins.nearest_group(spark.createDataFrame(asked, "pos int, video int, ts bigint"), spark.createDataFrame(values, "video int, ts bigint"), ["video"], "ts", 40).collect()}
    want = {}
    for pos, video, ts in asked:
        own = [t for v, t in values if v == video]
        if own:
            anchor = ts if any(abs(t - ts) <= 40 for t in own) else min(own, key=lambda t: (abs(t - ts), t))
            want[pos] = (anchor, sum(abs(t - anchor) <= 40 for t in own))
    assert got == want


def test_unread_codes(spark):
    r = random.Random(2)

    def code(body):
        return body + str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(body)) % 10)

    known = [code("46" + "".join(r.choice("0123") for _ in range(10))) for _ in range(300)] + ["4600000000001", "460"]
    reads = ["".join("?" if r.random() < 0.35 else c for c in r.choice(known[:300])) for _ in range(400)] + ["?" * 13, "46?", "4?xx???????00", known[0], None]
    rows = list(enumerate(reads)) + [(999, reads[0])]
    table = spark.createDataFrame([(c,) for c in known], "barcode string")
    got = {x.pos: x.barcode for x in catalog.complete_unread(spark.createDataFrame(rows, "pos int, code string"), table, ["pos"], "code").collect()}
    want = {}
    for pos, read in rows:
        if read and len(read) == 13 and not set(read) - set("?0123456789") and sum(c != "?" for c in read) >= 6:
            found = {c for c in known[:300] if all(a in ("?", b) for a, b in zip(read, c, strict=True))}
            if len(found) == 1:
                want[pos] = found.pop()
    assert got == want and len(want) > 50
    assert catalog.complete_unread(spark.createDataFrame([], "pos int, code string"), table, ["pos"], "code").count() == 0


AT = datetime(2024, 5, 1)


def events(seed, n=300):
    r = random.Random(seed)
    kinds = ["insert", "update", "update", "update", "delete"]
    return [(k, r.randrange(12), AT + timedelta(seconds=r.randrange(200)), r.choice(kinds), r.choice([None, "queued", "done"]), r.choice([None, 0, 50]), r.choice([None, "m"])) for k in range(n)]


EVENT = "event_id bigint, job_id bigint, event_ts timestamp, event string, status string, progress bigint, message string"


def stored(rows):
    """The rows, one by one in the order of time."""
    out = {}
    for _, job, ts, event, *values in sorted(rows, key=lambda e: (e[2], e[0])):
        if event == "delete":
            out.pop(job, None)
        elif event == "insert":
            out[job] = [ts, ts, *values]
        elif job in out:
            out[job] = [out[job][0], ts, *[new if new is not None else old for new, old in zip(values, out[job][2:], strict=True)]]
    return out


def first_inserts(rows):
    """Events without inserts of jobs that are there, which a store does not see."""
    there, out = set(), []
    for e in sorted(rows, key=lambda e: (e[2], e[0])):
        if e[3] == "insert" and e[1] in there:
            continue
        (there.add if e[3] == "insert" else there.discard if e[3] == "delete" else lambda _: None)(e[1])
        out.append(e)
    return out


def told(spark, path):
    return {x.job_id: [x.created_at, x.updated_at, x.status, x.progress, x.message] for x in store.live(store.read_state(spark, path)).collect()}


def test_store_replays_change_nothing(spark, tmp_path):
    rows, path = first_inserts(events(1)), f"{tmp_path}/store"
    assert store.version(spark, path) is None and told(spark, path) == {}
    random.Random(1).shuffle(rows)  # late events too
    parts = [rows[k::4] for k in range(4)]
    for k, part in enumerate(parts):
        batch = spark.createDataFrame(part + parts[0][:5], EVENT)
        assert store.apply_batch(spark, path, batch, k)
        before = told(spark, path)
        assert not store.apply_batch(spark, path, batch, k) and told(spark, path) == before  # again, after it was marked
    assert told(spark, path) == stored(rows) and len(stored(rows)) > 3
    # a crash after the snapshot and before the mark: the old one is current, and the batch can be run again
    fs, mark = store._files(spark, f"{path}/{store.MARK}3")
    fs.delete(mark, False)
    assert store.version(spark, path) == 2 and told(spark, path) != stored(rows)
    assert store.apply_batch(spark, path, spark.createDataFrame(parts[3], EVENT), 3) and told(spark, path) == stored(rows)
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")) == ["current-2", "current-3", "v=2", "v=3"]


def test_upsert_stream_restarts(spark, tmp_path):
    rows = first_inserts(events(2))
    for k in range(3):
        spark.createDataFrame(rows[k::3] + rows[:9], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        store.upsert_stream(source, f"{tmp_path}/store", f"{tmp_path}/progress").awaitTermination()
    assert told(spark, f"{tmp_path}/store") == stored(rows)


def followed(rows, snapshot):
    out = []
    for job in {e[1] for e in rows}:
        now = snapshot.get(job, ("", 0))
        if job in snapshot:
            out.append((job, -1, *now, "snapshot"))
        for k, _, _, status, progress in sorted((e for e in rows if e[1] == job), key=lambda e: (e[2], e[0])):
            if now[0] in stream.TERMINAL:
                break
            if not (status == "queued" and progress == 0 and now[1] > 0) and (status, progress) != now:
                now = (status, progress)
                out.append((job, k, *now, "change"))
    return sorted(out)


def test_follow_jobs_restarts(spark, tmp_path):
    r = random.Random(4)
    schema = "event_id bigint, job_id bigint, event_ts timestamp, status string, progress bigint"
    rows = [(k, r.randrange(15), AT + timedelta(seconds=k), r.choice(["queued", "processing", "processing", "processing", "done" if k > 150 else "queued"]), r.choice([0, 0, 30, 60])) for k in range(260)]
    snapshot = {k: (r.choice(["queued", "processing", "error"]), r.choice([0, 20])) for k in range(0, 20, 2)}
    static = spark.createDataFrame([(k, *v) for k, v in snapshot.items()], "job_id bigint, status string, progress bigint")
    for k in range(3):  # three runs from one checkpoint
        spark.createDataFrame(rows[k * 90 : (k + 1) * 90], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream.write_once(stream.follow_jobs(source, static), f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out").collect()
    assert sorted((x.job_id, x.event_id, x.status, x.progress, x.kind) for x in got) == followed(rows, snapshot)


def test_exports_are_rebuilt_where_stale(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("part"), "id")
    rows.repartition("part").write.partitionBy("part").parquet(source)
    build = lambda df: df.groupBy("part").agg(F.sum("id").alias("total"))
    times = lambda: {p.name: [f.stat().st_mtime_ns for f in p.glob("*.parquet")] for p in (tmp_path / "out").glob("part=*")}
    assert exports.refresh(spark, source, target, "part", build) == ["0", "1", "2", "3"]
    first = times()
    assert exports.refresh(spark, source, target, "part", build) == [] and times() == first
    spark.createDataFrame([(2, 1000)], "part int, id bigint").write.mode("append").partitionBy("part").parquet(source)
    assert exports.refresh(spark, source, target, "part", build) == ["2"]
    assert {k for k, v in times().items() if v != first[k]} == {"part=2"}
    assert {r.part: r.total for r in spark.read.parquet(target).collect()} == {0: 180, 1: 190, 2: 1200, 3: 210}


def test_files_in_their_own_encodings(spark, tmp_path):
    for name, encoding, text in (("a", "utf-8", "﻿Name;Code\nВино; 1\n\"с; \"\"ы\"\"\nр\";2\n"), ("b", "cp1251", "код;Название;Штрихкод\nx;Мёд №1;3\nx;Чай;4\n"), ("c", "latin-1", "name;price\ncaf\xe9\x98;5\n"), ("d", "utf-8", "")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
    got = sorted(map(tuple, readers.read_catalog_any(spark, str(tmp_path), columns=("name", "barcode", "price"), details=True).collect()), key=str)
    want = [("a.csv", "utf-8", 0, "Вино", " 1", None), ("a.csv", "utf-8", 1, "с; \"ы\"\nр", "2", None), ("b.csv", "cp1251", 0, "Мёд №1", "3", None), ("b.csv", "cp1251", 1, "Чай", "4", None), ("c.csv", "latin-1", 0, "caf\xe9\x98", None, "5")]
    assert got == want
    assert readers.read_catalog_any(spark, str(tmp_path), limit=1).count() == 3


def test_saved_tables_are_deleted(spark):
    table = joins.saved(spark.range(3))
    fs = joins.shared_dir(spark)
    assert table.saved_path.startswith(fs) and joins.saved(table).count() == 3
    joins.dropped(table)
    assert joins.clear(spark) >= 1 and joins.clear(spark) == 0


def test_status_of_nothing(spark):
    assert status_now(spark.createDataFrame([], "job_id bigint, event_ts timestamp, status string, progress bigint")).count() == 0
