"""Key frames, codes with unread digits, partial votes, and probes of decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import catalog as C
from tagloom.operators import filters, joins, providers, recovery
from tagloom.plans.registry import PLAIN_SQL, query
from tagloom.sources.adapters import view

_STRIDE, _SHARP, _MOVED = 2000, 10, 60


@query(
    "with recursive f as (select cast(pos % 5 as int) as video, pos as n, frame_ts_ms as ts, score % 50 as sharp, sum(score % 11) over (partition by pos % 5 order by pos) as moved from ocr_frames), "
    f"s as (select * from f where sharp >= {_SHARP}), "
    f"links as (select a.video, a.n, min(b.n) as onward from s a join s b on a.video = b.video and b.ts >= a.ts + {_STRIDE} and b.moved >= a.moved + {_MOVED} group by 1, 2), "
    "st as (select video, min(n) as n from s group by 1 union all select l.video, l.onward from st join links l on l.video = st.video and l.n = st.n) "
    "select video, n as frame_idx from st",
    "ocr_frames",
)
def key_frames(spark, sf_dir):
    f = view(spark, sf_dir, "ocr_frames")
    frames = f.select((F.col("pos") % 5).cast("int").alias("video"), F.col("pos").alias("frame_idx"), "frame_ts_ms", (F.col("score") % 50).alias("sharpness"), (F.col("score") % 11).alias("difference"))
    return providers.kept_frames(frames, _STRIDE, _SHARP, _MOVED)


#: Codes in which a digit could not be read, wherever it stands; which one rests on the row.
_UNREAD = "(select pos, replace(replace(barcode, cast(pos % 10 as varchar(1)), '?'), cast(job_id % 7 as varchar(1)), '?') as code from {detections} where length(barcode) = 13)"


@query(
    f"with reads as {_UNREAD.format(detections='detections')}, valid as (select distinct barcode from catalog), "
    "told as (select distinct code from reads where length(replace(code, '?', '')) >= 6), "
    "one as (select code, min(barcode) as barcode from told join valid on barcode like replace(code, '?', '_') group by code having count(*) = 1) "
    "select pos, code, barcode from reads join one using (code)",
    "detections", "catalog",
)
def unread_codes(spark, sf_dir):
    reads = spark.sql("select * from " + _UNREAD, detections=view(spark, sf_dir, "detections"))
    return C.complete_unread(reads, view(spark, sf_dir, "catalog"), ["pos"], "code")


_ONE_DIGIT = PLAIN_SQL["one_digit_votes"].replace("with r as", "r as", 1).replace(" select pos, barcode, count(*) as votes from r join", ", near as (select pos, barcode, count(*) as votes from r join", 1) + ")"


@query(
    "with grams as (select distinct pos, substr(g, cast(i as bigint), n) as run from (select pos, regexp_replace(text, '[^0-9]', '', 'g') as g from track_codes), (select unnest([10, 11, 12]) as n), lateral (select unnest(generate_series(1, length(g) - n + 1)) as i) where length(g) >= n), "
    "begun as (select pos, barcode, count(*) as votes from grams join (select barcode, unnest([substr(barcode, 1, 10), substr(barcode, 1, 11), substr(barcode, 1, 12)]) as run from catalog) using (run) group by 1, 2), "
    f"{_ONE_DIGIT} select pos, barcode, sum(votes)::bigint as votes from (select * from begun union all select * from near) group by 1, 2",
    "track_codes", "catalog",
)
def partial_votes(spark, sf_dir):
    return recovery.partial_votes(view(spark, sf_dir, "track_codes"), view(spark, sf_dir, "catalog"), ["pos"], "text")


_HITS = "select pos, 'decoder' as source, barcode as hit from {track_codes} where barcode <> '' union all select pos, 'text', regexp_replace(text, '[^0-9]', '{g}) from {track_codes} where length(regexp_replace(text, '[^0-9]', '{g})) >= 12"


@query(
    f"with hits as ({_HITS.format(track_codes='track_codes', g=chr(39) + ', ' + chr(39) + 'g' + chr(39))}), every as (select distinct pos, source, hit from (select * from hits union all select pos, 'either', hit from hits)), "
    "truth as (select t.pos, c.barcode, s.source from track_codes t cross join (select count(*) as parts from catalog) n join catalog c on c.part_id = t.track_id * 7919 % parts cross join (select unnest(['decoder', 'text', 'either']) as source) s) "
    "select pos, source, case when bool_or(hit = barcode) then 'EXACT' when bool_or(substr(hit, 1, 12) = substr(barcode, 1, 12)) then 'PREFIX12' when count(hit) > 0 then 'ANY(' || count(hit) || ')' else 'miss' end as status from truth left join every using (pos, source) group by pos, source",
    "track_codes", "catalog",
)
def decode_probe_by_source(spark, sf_dir):
    t, c = view(spark, sf_dir, "track_codes"), view(spark, sf_dir, "catalog")
    truth = t.select("pos", "track_id").crossJoin(c.agg(F.count("*").alias("parts"))).withColumn("part_id", F.col("track_id") * 7919 % F.col("parts"))  # one single row
    hits = spark.sql(_HITS.format(track_codes="{track_codes}", g="'"), track_codes=t)
    return filters.probe_by_source(truth.join(c.select("part_id", "barcode"), "part_id").select("pos", "barcode"), hits, ["pos"], ("decoder", "text"))


@query(
    "with a as (select pos, video, frame_ts_ms + 170 * (pos % 5) as ts from ocr_frames), f as (select video, frame_ts_ms as ts, count(*) as n from ocr_frames group by 1, 2), "
    "own as (select a.pos, sum(n) as n from a join f on f.video = a.video and abs(a.ts - f.ts) <= 120 group by 1), "
    "near as (select a.pos, a.video, arg_min(f.ts, {'gap': abs(a.ts - f.ts), 'ts': f.ts}) as anchor from a join f on f.video = a.video where a.pos not in (select pos from own) group by 1, 2), "
    "other as (select near.pos, anchor, sum(n) as n from near join f on f.video = near.video and abs(near.anchor - f.ts) <= 120 group by 1, 2) "
    "select pos, ts as anchor, n::bigint as n from own join a using (pos) union all select pos, anchor, n::bigint from other",
    "ocr_frames",
)
def nearest_group(spark, sf_dir):
    f = view(spark, sf_dir, "ocr_frames")
    asked = f.select("pos", "video", (F.col("frame_ts_ms") + 170 * (F.col("pos") % 5)).alias("ts"))
    return joins.nearest_group(asked, f.select("video", F.col("frame_ts_ms").alias("ts")), ["video"], "ts", 120)
