"""Findings of round 4: what must not pass the driver, and what must not be written for each pair."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import evaluate, joins, recovery, tracks
from tagloom.sources import adapters
from tagloom.sources.adapters import view
from tests.test_growth import SF, copies, plan


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that are written on the way."""
    kept, write = [], joins.saved
    monkeypatch.setattr(joins, "saved", lambda df: kept.append(plan(df)) or write(df))
    return kept


def test_nearest_points_do_not_pass_the_driver(spark, plans):
    """Tables that are small as files were broadcast after they were put into nine cells."""
    d = copies(spark, 60).localCheckpoint()
    near = joins.nearest_point(d, d.where("pos % 3 = 0").withColumn("x_min", F.col("x_min") + 3), ["video"], "frame_timestamp", 3000, ["x_min", "y_min"])
    assert near.count() == 1200
    assert len(plans) > 6 and not any("BroadcastExchange" in p for p in [*plans, plan(near)])


def test_boxes_do_not_pass_the_driver(spark, tmp_path):
    """What is put into cells is larger than its file tells."""
    copies(spark, 60).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    best = joins.best_overlap(d.where("pos % 3 = 0"), d, ["video"], 0.25)
    assert "BroadcastExchange" not in plan(best) and best.count() == 400


def test_crowds_are_decided_in_turns(spark, monkeypatch):
    """All tags that overlap were paired at once: pairs grew with the square of the boxes in a place."""
    rng = np.random.default_rng(11)
    n = 1500
    x, y, t = rng.integers(0, 120, n), rng.integers(0, 60, n), rng.integers(0, 900, n)
    rows = [(int(i % 2), int(i), int(t[i]), int(x[i]), int(y[i]), int(x[i] + rng.integers(0, 60)), int(y[i] + 20), int(rng.integers(0, 4)), "460123456789" if i % 3 else "") for i in range(n)]
    tags = spark.createDataFrame(rows, "video int, pos bigint, frame_timestamp bigint, x_min int, y_min int, x_max int, y_max int, confidence int, barcode string").localCheckpoint()
    pairs, told = [], {}
    meeting = tracks.overlapping
    monkeypatch.setattr(tracks, "overlapping", lambda *a: pairs.append(meeting(*a).count()) or meeting(*a))
    for crowd in (10**6, 20):
        monkeypatch.setattr(tracks, "CROWD", crowd)
        pairs.clear()
        told[crowd] = sorted(map(tuple, tracks.suppress(tags, 200).collect())), sum(pairs), len(pairs)
    assert told[20][0] == told[10**6][0] and told[20][2] > 2
    assert 5 * told[20][1] < told[10**6][1]


def test_votes_are_shuffled_as_lists(spark):
    """Each vote was shuffled for its kind and once more for their sum; a run of a pos that stands in two rows counted twice."""
    check = lambda b: b + str((10 - sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(b)) % 10) % 10)
    known = [check(f"0600000{i:05d}") for i in range(300)] + ["060000000007"]
    catalog = spark.createDataFrame([(c,) for c in known], "barcode string")
    texts = {1: ["x " + known[12], "x " + known[12]], 2: ["n" + known[250][:11]], 3: ["EAN 060000000001 7", ""], 4: [None]}
    rows = spark.createDataFrame([(p, t) for p, own in texts.items() for t in own], "pos int, text string")
    want: dict = {}
    for p, own in texts.items():
        digits = ["".join(c for c in t or "" if c.isdigit()) for t in own]
        for run in {t[i : i + n] for t in digits for n in (10, 11, 12) for i in range(len(t) - n + 1)}:
            for c in known:
                hit = c.startswith(run) + (len(run) == 12 and len(c) == 13 and sum(a != b for a, b in zip(run, c, strict=False)) == 1)
                if hit:
                    want[p, c] = want.get((p, c), 0) + hit
    told = recovery.partial_votes(rows, catalog, ["pos"], "text")
    assert {(r.pos, r.barcode): r.votes for r in told.collect()} == want and len(want) > 100
    assert plan(told).split("Union")[0].count("Exchange") == 1


@pytest.mark.parametrize("first", ["largest", "earliest"])
def test_copies_of_boxes_are_matched_as_groups(spark, monkeypatch, first):
    """Each copy of a prediction was paired with each copy of ground truth, and all pairs were written."""
    rng = np.random.default_rng(4)

    def make(n, places):
        k = rng.integers(0, places, n)
        return [(int(v), int(p), int(i % 3 * 900), int(i * 9), 10, int(i * 9 + 40 + i % 2 * 8), 40) for p, v, i in zip(rng.permutation(n), k % 2, k, strict=True)]

    schema = "video int, pos bigint, frame_timestamp bigint, x_min int, y_min int, x_max int, y_max int"
    gt, pred = make(60, 12), make(90, 14)
    kept, write = [], joins.saved
    monkeypatch.setattr(evaluate, "saved", lambda df: kept.append(write(df)) or kept[-1])
    got = evaluate.match_by_place(spark.createDataFrame(gt, schema), spark.createDataFrame(pred, schema), first=first)
    size = lambda r: (r[5] - r[3]) * (r[6] - r[4])
    want, free, pairs = [], set(range(len(gt))), 0
    for p in sorted(pred, key=lambda r: (-size(r) if first == "largest" else 0, r[1])):
        wishes = []
        for j, g in enumerate(gt):
            share = max(min(p[5], g[5]) - max(p[3], g[3]), 0) * 30
            overlap = share / (size(p) + size(g) - share)
            if g[0] == p[0] and abs(g[2] - p[2]) <= 3000 and overlap >= 0.2:
                pairs += 1
                wishes += [(-overlap, g[1], j)] if j in free else []
        if wishes:
            free.discard(min(wishes)[2])
            want.append((p[0], min(wishes)[1], p[1]))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    assert 3 * kept[1].count() < pairs


def test_pairs_of_rows_are_not_shuffled(spark):
    d = copies(spark, 60).localCheckpoint()
    told = plan(evaluate.candidate_pairs(d.where("pos % 3 = 0"), d))
    assert told.count("SortMergeJoin") == 1 and evaluate.candidate_pairs(d.where("pos % 3 = 0"), d).where("gt_pos = 0").count() % 60 == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_keys_of_many_parts_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(adapters, "MOST_PARTS", 100)
    for name in ("detections", "gt"):
        told = view(spark, SF, name).select("pos", "video")
        assert "BroadcastExchange" not in plan(told)
    monkeypatch.undo()
    assert told.count() == view(spark, SF, "gt").count() > 0


def test_blocks_are_read_one_by_one(spark, tmp_path):
    """Blocks went to Python one by one, but 4096 of them were read from a file at once."""
    from tagloom.llm import collocations, common

    seen = []
    write = collocations.materialize
    collocations.materialize = lambda df, name: seen.append((name, spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))) or write(df, name)
    try:
        docs = spark.createDataFrame([("en", "red wine of the old town " * 3)] * 40, "lang string, text string")
        assert collocations.mine(docs, least=30).count() > 0
    finally:
        collocations.materialize = write
    assert {size for name, size in seen if name.startswith("counted")} == {"1"} and seen[-1][1] == "4096"
    with common.small_batches(spark, 10_000):
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
