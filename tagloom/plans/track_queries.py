"""Tracks: fusing frames, votes, bands and boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagloom.functions import geometry as G
from tagloom.functions import votes as V
from tagloom.operators import joins, tracks
from tagloom.operators.finalize import confidence
from tagloom.plans.registry import PLAIN_SQL, query
from tagloom.plans.text_queries import NAMED, ean_sql
from tagloom.sources.adapters import view

KEYS = ["video", "track_id"]
_BC = (
    "bc as (select video, track_id, value, votes from (select video, track_id, barcode_raw as value, count(*) as votes, min(pos) as first from ocr_frames where length(barcode_raw) between 12 and 13 group by 1, 2, 3) "
    f"qualify row_number() over (partition by video, track_id order by {ean_sql('value')} desc, votes desc, length(value) desc, first) = 1)"
)
_BQ = (
    "bq as (select video, track_id, value from (select video, track_id, qr_raw as value, count(*) as votes, min(pos) as first from ocr_frames where trim(qr_raw) <> '' group by 1, 2, 3) "
    "qualify row_number() over (partition by video, track_id order by regexp_matches(value, '(^|[;&])(b|barcode)=') desc, votes desc, length(value) desc, first) = 1)"
)


def frames(spark, sf_dir):
    return view(spark, sf_dir, "ocr_frames")


@query(
    f"with {_BC}, {_BQ}, t as (select video, track_id, count(*) as frames, arg_min(frame_ts_ms, cast(rnk as bigint) * 1000000000 + pos) as frame_ts_ms, arg_min(pos, cast(rnk as bigint) * 1000000000 + pos) as pos, string_agg(ocr_text, chr(10) order by rnk, pos) as ocr_text from ocr_frames group by 1, 2) "
    "select t.video, t.track_id, frames, frame_ts_ms, pos, ocr_text, coalesce(bc.value, '') as barcode, coalesce(bq.value, '') as qr from t left join bc using (video, track_id) left join bq using (video, track_id)",
    "ocr_frames",
)
def track_merge(spark, sf_dir):
    return tracks.merge(frames(spark, sf_dir), KEYS)


_WIDE = "(select pos, video, cast(floor(pos / 100) as bigint) as track_id, barcode_raw, event_type, score from ocr_frames)"


def wide(spark, sf_dir):
    """Frames in tracks of up to 100, so that votes have something to count."""
    return frames(spark, sf_dir).withColumn("track_id", F.floor(F.col("pos") / 100)).withColumn("video", F.lit(0))


@query(
    f"select track_id, value, votes from (select cast(floor(pos / 100) as bigint) as track_id, barcode_raw as value, count(*) as votes, min(pos) as first from ocr_frames where length(barcode_raw) between 12 and 13 group by 1, 2) qualify row_number() over (partition by track_id order by {ean_sql('value')} desc, votes desc, length(value) desc, first) = 1",
    "ocr_frames",
)
def vote_barcode(spark, sf_dir):
    return V.best_barcode(wide(spark, sf_dir), ["track_id"], "barcode_raw")


@query("select track_id, value, votes from (select cast(floor(pos / 100) as bigint) as track_id, event_type as value, count(*) as votes, min(pos) as first from ocr_frames group by 1, 2) qualify row_number() over (partition by track_id order by votes desc, first) = 1", "ocr_frames")
def vote_field(spark, sf_dir):
    return V.vote(wide(spark, sf_dir), ["track_id"], F.col("event_type"))


@query(
    "with p as (select cast(floor(pos / 100) as bigint) as track_id, i as place, substr(barcode_raw, cast(i as bigint), 1) as digit, sum(1 + score % 5) as w from ocr_frames, (select unnest(generate_series(1, 13)) as i) where length(barcode_raw) = 13 group by 1, 2, 3) "
    "select track_id, string_agg(digit, '' order by place) as digits from (select * from p qualify row_number() over (partition by track_id, place order by w desc, digit) = 1) group by 1",
    "ocr_frames",
)
def digit_position_vote(spark, sf_dir):
    return V.digit_vote(wide(spark, sf_dir), ["track_id"], "barcode_raw", 1 + F.col("score") % 5)


@query(
    f"with {_BC}, {_BQ} select f.pos, case when trim(barcode_raw) = '' then coalesce(bc.value, '') else barcode_raw end as barcode_raw, case when trim(qr_raw) = '' then coalesce(bq.value, '') else qr_raw end as qr_raw from ocr_frames f left join bc using (video, track_id) left join bq using (video, track_id)",
    "ocr_frames",
)
def propagate_track(spark, sf_dir):
    return tracks.propagate(frames(spark, sf_dir), KEYS).select("pos", "barcode_raw", "qr_raw")


@query("select track_id, pos, rank from (select cast(floor(pos / 100) as bigint) as track_id, pos, row_number() over (partition by cast(floor(pos / 100) as bigint) order by score desc, pos) as rank from ocr_frames) where rank <= 3", "ocr_frames")
def top_frames(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.col("score").desc(), "pos"))
    return wide(spark, sf_dir).withColumn("rank", rank).where("rank <= 3").select("track_id", "pos", "rank")


def _pairs(spark, sf_dir):
    """Tags and the boxes they are looked up by, a little off."""
    d = view(spark, sf_dir, "detections").select("pos", "video", "frame_timestamp", "x_min", "y_min")
    o = view(spark, sf_dir, "gt").select("pos", "video", (F.col("frame_timestamp") - 690).alias("frame_timestamp"), (F.col("x_min") + 3).alias("x_min"), (F.col("y_min") + 2).alias("y_min"))
    return d, o


_O = "(select pos, video, frame_timestamp - 690 as frame_timestamp, x_min + 3 as x_min, y_min + 2 as y_min from gt)"


@query(
    f"select d.pos, min(o.pos) as match_pos from detections d join {_O} o on d.video = o.video and abs(d.frame_timestamp - o.frame_timestamp) < 15 and abs(d.x_min - o.x_min) < 12 and abs(d.y_min - o.y_min) < 12 group by 1",
    "detections", "gt",
)
def near_key_lookup(spark, sf_dir):
    d, o = _pairs(spark, sf_dir)
    met = joins.band_join(d, o, ["video"], "frame_timestamp", 15, True, (("x_min", 12, True), ("y_min", 12, True)))
    return met.groupBy("pos").agg(F.min("r_pos").alias("match_pos"))


@query(
    f"select pos, match_pos, distance from (select d.pos, o.pos as match_pos, abs(d.frame_timestamp - o.frame_timestamp) + abs(d.x_min - o.x_min) + abs(d.y_min - o.y_min) as distance from detections d join {_O} o on d.video = o.video and abs(d.frame_timestamp - o.frame_timestamp) <= 3000) qualify row_number() over (partition by pos order by distance, match_pos) = 1",
    "detections", "gt",
)
def nearest_fallback(spark, sf_dir):
    d, o = _pairs(spark, sf_dir)
    return joins.nearest_point(d, o, ["video"], "frame_timestamp", 3000, ["x_min", "y_min"]).withColumnRenamed("r_pos", "match_pos")


@query(
    "select a.pos, count(*) as near, array_to_string((list(b.product_name order by b.frame_timestamp, b.pos))[1:10], '|') as names from detections a join detections b on a.video = b.video and a.pos <> b.pos and abs(a.frame_timestamp - b.frame_timestamp) <= 600 where b.product_name <> '' group by 1",
    "detections",
)
def shelf_context(spark, sf_dir):
    d = view(spark, sf_dir, "detections").select("pos", "video", "frame_timestamp", "product_name")
    return joins.context(d, ["video"], "frame_timestamp", 600, "product_name", 10)


_BOXES = "(select pos, video, frame_timestamp // 500 as frame, x_min, y_min, x_max, y_max from detections)"


@query(
    "select t.pos, min(c.pos) as code_pos from (select pos, video, frame_timestamp // 500 as frame, x_min, y_min, x_max, y_max from detections) t join (select pos, video, (frame_timestamp - 700) // 500 as frame, (x_min + x_max) / 2.0 as cx, (y_min + y_max) / 2.0 as cy from gt) c on t.video = c.video and t.frame = c.frame "
    "where cx between x_min - (x_max - x_min) * 0.25 and x_max + (x_max - x_min) * 0.25 and cy between y_min - (y_max - y_min) * 0.6 and y_max + (y_max - y_min) * 0.25 group by 1",
    "detections", "gt",
)
def code_in_tag(spark, sf_dir):
    frame = lambda e: F.floor(e / 500).alias("frame")
    t = view(spark, sf_dir, "detections").select("pos", "video", frame(F.col("frame_timestamp")), "x_min", "y_min", "x_max", "y_max")
    c = view(spark, sf_dir, "gt").select(F.col("pos").alias("code_pos"), "video", frame(F.col("frame_timestamp") - 700), *[F.col(k).alias("c_" + k) for k in tracks.BOX])
    return t.join(c, ["video", "frame"]).where(G.holds_centre(G.box(), G.box("c_"))).groupBy("pos").agg(F.min("code_pos").alias("code_pos"))


_IOU = "case when (a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) - i > 0 then i / ((a.x_max - a.x_min) * (a.y_max - a.y_min) + (b.x_max - b.x_min) * (b.y_max - b.y_min) - i) else 0 end"


@query(
    "select gt_pos, pos, round(iou, 6) as iou from (select gt_pos, pos, cast(i as double) / (ga + da - i) as iou from (select g.pos as gt_pos, d.pos, cast(greatest(least(g.x_max, d.x_max) - greatest(g.x_min, d.x_min), 0) as bigint) * greatest(least(g.y_max, d.y_max) - greatest(g.y_min, d.y_min), 0) as i, "
    "(g.x_max - g.x_min) * (g.y_max - g.y_min) as ga, (d.x_max - d.x_min) * (d.y_max - d.y_min) as da from gt g join detections d on g.video = d.video)) where iou >= 0.25 qualify row_number() over (partition by gt_pos order by iou desc, pos) = 1",
    "gt", "detections",
)
def iou_argmax(spark, sf_dir):
    met = joins.best_overlap(*(view(spark, sf_dir, n).select("video", "pos", *tracks.BOX) for n in ("gt", "detections")), ["video"], 0.25)
    return met.select(F.col("pos").alias("gt_pos"), F.col("r_pos").alias("pos"), F.round("iou", 6).alias("iou"))


@query(
    "select track_id, frame, count(*) as boxes from (select track_id, rnk, unnest(generate_series(rnk - 2, rnk + 2)) as frame from ocr_frames) where frame >= 0 group by 1, 2",
    "ocr_frames",
)
def frame_expand(spark, sf_dir):
    near = frames(spark, sf_dir).select("track_id", F.explode(F.sequence(F.col("rnk") - 2, F.col("rnk") + 2)).alias("frame")).where("frame >= 0")
    return near.groupBy("track_id", F.col("frame").cast("long").alias("frame")).agg(F.count("*").alias("boxes"))


@query("select video, frame_timestamp, r as rank from (select distinct video, frame_timestamp, dense_rank() over (partition by video order by frame_timestamp) as r from gt) where r <= 3", "gt")
def first_timestamps(spark, sf_dir):

    rank = F.dense_rank().over(Window.partitionBy("video").orderBy("frame_timestamp")).cast("long")
    return view(spark, sf_dir, "gt").select("video", "frame_timestamp", rank.alias("rank")).where("rank <= 3").distinct()


@query("select pos, greatest(cast(trunc(x_min - (x_max - x_min) * 0.1) as int), 0) as x0, greatest(cast(trunc(y_min - (y_max - y_min) * 0.2) as int), 0) as y0, least(cast(trunc(x_max + (x_max - x_min) * 0.1) as int), 3000) as x1, least(cast(trunc(y_max + (y_max - y_min) * 0.4) as int), 1600) as y1 from detections", "detections")
def padded_boxes(spark, sf_dir):
    b = G.pad(G.box(), 0.1, 0.2, 0.1, 0.4, F.lit(3000), F.lit(1600))
    return view(spark, sf_dir, "detections").select("pos", *[c.alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), b, strict=True)])


_SCORED = PLAIN_SQL["confidence_score"].replace(NAMED, "product_name").replace("select pos, case when ok", "select *, case when ok", 1)
_TURNS = "d as (select video, pos, frame_timestamp as ts, x_min, y_min, x_max, y_max, row_number() over (partition by video order by length(barcode) >= 12 desc, confidence desc, (x_max - x_min) * (y_max - y_min) desc, pos) as k from (select * from s qualify row_number() over (partition by video, pos order by length(barcode) >= 12 desc, confidence desc, (x_max - x_min) * (y_max - y_min) desc) = 1)), "


def unsuppressed(window_ms: int) -> str:
    """SQL: video and pos of the rows of ``s`` that stay, chosen one by one in the order of their rank."""
    covers = f"abs(c.ts - d.ts) <= {window_ms} and 2 * greatest(least(c.x1, d.x_max) - greatest(c.x0, d.x_min), 0) * greatest(least(c.y1, d.y_max) - greatest(c.y0, d.y_min), 0) >= least((c.x1 - c.x0) * (c.y1 - c.y0), (d.x_max - d.x_min) * (d.y_max - d.y_min))"
    return (
        _TURNS + "st as (select video, cast(0 as bigint) as k, cast([] as struct(pos bigint, ts bigint, x0 integer, y0 integer, x1 integer, y1 integer)[]) as kept from d where k = 1 union all "
        f"select d.video, d.k, case when len(list_filter(kept, lambda c: {covers})) = 0 then list_append(kept, {{'pos': d.pos, 'ts': d.ts, 'x0': d.x_min, 'y0': d.y_min, 'x1': d.x_max, 'y1': d.y_max}}) else kept end from st join d on d.video = st.video and d.k = st.k + 1), "
        "stay as (select video, x.pos as pos from (select video, unnest(kept) as x from (select video, arg_max(kept, k) as kept from st group by 1)))"
    )


@query(f"with recursive s as ({_SCORED}), {unsuppressed(3000)} select * from stay", "detections")
def suppress(spark, sf_dir):
    return tracks.suppress(confidence(view(spark, sf_dir, "detections")), 3000)


@query(
    "with recursive d as (select track_id, pos, ts, row_number() over (partition by track_id order by score desc, pos) as k from (select cast(floor(pos / 100) as bigint) as track_id, pos, score, frame_ts_ms as ts from ocr_frames)), "
    "st as (select track_id, cast(0 as bigint) as k, cast([] as struct(pos bigint, ts bigint)[]) as kept, cast([] as bigint[]) as rest from d where k = 1 union all select d.track_id, d.k, case when fits then list_append(kept, {'pos': d.pos, 'ts': d.ts}) else kept end, case when fits then rest else list_append(rest, d.pos) end "
    "from (select d.track_id, d.k, d.pos, d.ts, kept, rest, len(kept) < 3 and len(list_filter(kept, lambda c: abs(c.ts - d.ts) < 500)) = 0 as fits from st join d on d.track_id = st.track_id and d.k = st.k + 1) d), "
    "z as (select track_id, list_concat(list_transform(kept, lambda c: c.pos), rest)[1:3] as chosen from (select track_id, arg_max(kept, k) as kept, arg_max(rest, k) as rest from st group by 1)) "
    "select track_id, unnest(chosen) as pos, cast(generate_subscripts(chosen, 1) - 1 as int) as choice from z",
    "ocr_frames",
)
def best_frames(spark, sf_dir):
    return tracks.best_frames(wide(spark, sf_dir).select("track_id", "pos", "score", "frame_ts_ms"), ["track_id"])


#: Boxes one by one, in the order of frames: each joins the live track it overlaps most, else begins one.
TRACKS_SQL = (
    "with recursive b as (select video, cast(floor(frame_timestamp / 100) as bigint) as f, pos, x_min, y_min, x_max, y_max, row_number() over (partition by video order by floor(frame_timestamp / 100), pos) as k from detections), "
    "st as (select video, cast(0 as bigint) as k, cast(null as bigint) as pos, cast(null as int) as track_id, cast(0 as int) as begun, cast([] as struct(id integer, f bigint, x0 integer, y0 integer, x1 integer, y1 integer)[]) as live from b where k = 1 union all "
    "select video, k, pos, id, greatest(begun, id + 1), list_append(list_filter(live, lambda t: t.id <> id and f - t.f <= 5), {'id': id, 'f': f, 'x0': x_min, 'y0': y_min, 'x1': x_max, 'y1': y_max}) "
    "from (select *, coalesce(list_sort(list_filter(list_transform(list_filter(live, lambda t: f - t.f <= 5 and t.f < f), lambda t: {'apart': -coalesce(cast(greatest(least(t.x1, x_max) - greatest(t.x0, x_min), 0) * greatest(least(t.y1, y_max) - greatest(t.y0, y_min), 0) as double) / "
    "nullif((t.x1 - t.x0) * (t.y1 - t.y0) + (x_max - x_min) * (y_max - y_min) - greatest(least(t.x1, x_max) - greatest(t.x0, x_min), 0) * greatest(least(t.y1, y_max) - greatest(t.y0, y_min), 0), 0), 0), 'id': t.id}), lambda c: c.apart <= -0.3))[1].id, begun) as id "
    "from (select b.*, st.begun, st.live from st join b on b.video = st.video and b.k = st.k + 1))) "
    "select video, pos, track_id from st where k > 0"
)


@query(TRACKS_SQL, "detections")
def iou_tracker(spark, sf_dir):
    return tracks.follow(moving_boxes(view(spark, sf_dir, "detections")))


def moving_boxes(detections):
    return detections.withColumn("frame_idx", F.floor(F.col("frame_timestamp") / 100).cast("long")).select("video", "frame_idx", "pos", *tracks.BOX)
