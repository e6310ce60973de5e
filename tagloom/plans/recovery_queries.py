"""Parsing prices, fusing tracks, recovering codes, the metric over all fields, and small rules on tags and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import geometry as G
from tagloom.functions import scores as S
from tagloom.functions import text as T
from tagloom.functions import votes as V
from tagloom.functions.prices import with_prices
from tagloom.operators import catalog as C
from tagloom.operators import evaluate as E
from tagloom.operators import filters, fusion, joins, recovery, tracks
from tagloom.plans.evaluation_queries import _CODE, _NAME, _PRICE, _T, _TEXT
from tagloom.plans.registry import PLAIN_SQL, query
from tagloom.plans.text_queries import _FIX, INFO_SQL, MARK_SQL, ean_sql
from tagloom.sources.adapters import view

_CLEAN = f"trim(regexp_replace(regexp_replace({_FIX.replace('ocr_text', 'text')}, '[^0-9.,\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_FULL = "'([0-9]{1,4})[.,]([0-9]{2})([^0-9]|$)'"
_PRICES = f"""with recursive t as (select pos, idx, height as h, {_CLEAN} as s from tokens),
f as (select *, try_cast(nullif(regexp_extract(s, {_FULL}, 1), '') as bigint) as r, try_cast(nullif(regexp_extract(s, {_FULL}, 2), '') as bigint) as c from t),
n as (select pos, idx, h, case when r >= 1 then 'full' when regexp_full_match(s, '[0-9]{{2}}') then 'kop' when regexp_full_match(s, '[0-9]{{3,5}}') then 'rub' end as kind, case when r >= 1 then r * 100 + c else try_cast(s as bigint) end as v from f),
m as (select *, row_number() over (partition by pos order by idx) as k from n where kind in ('full', 'rub')),
o as (select pos, list({{'idx': idx, 'v': v, 'h': h}} order by idx) as ks from n where kind = 'kop' group by 1),
st as (select pos, cast(0 as bigint) as k, cast([] as integer[]) as used, cast([] as struct(v bigint, h integer)[]) as prices from m where k = 1
union all select pos, k, case when kind = 'rub' and b is not null then list_append(used, b.idx) else used end, list_append(prices, {{'v': case when kind = 'rub' then v * 100 + coalesce(b.v, 0) else v end, 'h': h}}) from (
select st.pos, m.k, m.kind, m.v, m.h, st.used, st.prices, list_sort(list_transform(list_filter(coalesce(o.ks, []), lambda x: not list_contains(st.used, x.idx) and abs(x.idx - m.idx) between 1 and 3 and (m.h <= 0 or x.h <= 0 or (x.h * 5 >= m.h and x.h * 10 <= m.h * 11))), lambda x: {{'d': abs(x.idx - m.idx), 'idx': x.idx, 'v': x.v}}))[1] as b
from st join m on m.pos = st.pos and m.k = st.k + 1 left join o on o.pos = st.pos)),
z as (select pos, p.v as v, max(p.h) as h, count(*) as c from (select pos, unnest(prices) as p from (select pos, arg_max(prices, k) as prices from st group by 1)) group by 1, 2),
w as (select pos, max(case when x = 1 then v end) as a, max(case when x = 2 then v end) as b from (select *, row_number() over (partition by pos order by least(c, 5) desc, h desc, v desc) as x from z) group by 1),
prices as (select e.pos, case when b < a then a else b end as price_default, case when b < a then b else a end as price_card from (select distinct pos from tokens) e left join w on w.pos = e.pos)
"""


def token_lists(spark, sf_dir):
    """pos and the frame's tokens in reading order."""
    told = view(spark, sf_dir, "tokens").groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("idx", "text", F.col("height").cast("double").alias("height")))).alias("tokens"))
    return told.withColumn("tokens", F.transform("tokens", lambda t: F.struct(t["text"].alias("text"), t["height"].alias("height"))))


@query(_PRICES + "select pos, price_default, price_card from prices", "tokens")
def parse_prices(spark, sf_dir):
    return with_prices(token_lists(spark, sf_dir), "tokens").select("pos", "price_default", "price_card")


_BARCODE = (
    f"case when regexp_full_match(trim(barcode_raw), '[0-9]{{12,13}}') and (length(trim(barcode_raw)) = 12 or {ean_sql('trim(barcode_raw)')}) then trim(barcode_raw) when length(line) = 12 or {ean_sql('line')} then line else '' end"
)


@query(f"select pos, {_BARCODE} as barcode from (select pos, barcode_raw, regexp_extract({_FIX}, '(^|[^0-9])([0-9]{{12,13}})([^0-9]|$)', 2) as line from ocr_frames)", "ocr_frames")
def parse_barcode(spark, sf_dir):
    return view(spark, sf_dir, "ocr_frames").select("pos", T.parse_barcode(F.col("ocr_text"), F.col("barcode_raw")).alias("barcode"))


FUSED = ["price_default", "price_card", "discount_amount", "id_sku", "print_datetime", "code", "additional_info", "special_symbols", "barcode"]
_FIELDS = (
    f"frames as (select o.pos, cast(floor(o.pos / 100) as bigint) as track_id, coalesce(cast(p.price_default as varchar), '') as price_default, coalesce(cast(p.price_card as varchar), '') as price_card, d.discount as discount_amount, "
    "regexp_replace(s.sku, case when length(regexp_replace(s.sku, '[^0-9]', '', 'g')) >= 9 then '[^0-9]' else '$^' end, '', 'g') as id_sku, t.printed as print_datetime, c.code, i.info as additional_info, y.mark as special_symbols, case when b.barcode <> '' then b.barcode when regexp_full_match(trim(q.qr_code_barcode), '[0-9]{12,13}') then trim(q.qr_code_barcode) else '' end as barcode "
    "from ocr_frames o left join prices p using (pos) "
    + " ".join(f"join ({{{name}}}) {alias} using (pos)" for name, alias in (("parse_discount", "d"), ("parse_sku", "s"), ("parse_datetime", "t"), ("parse_code", "c"), ("parse_barcode", "b"), ("parse_qr_kv", "q")))
    + f" join ({INFO_SQL}) i using (pos) join ({MARK_SQL}) y using (pos))"
)
_FUSE = (
    _PRICES.rstrip() + ", " + _FIELDS.replace("{12,13}", "{{12,13}}").format(**PLAIN_SQL)
    + ", said as (select * from (" + " union all ".join(f"select track_id, '{f}' as field, trim({f}) as value, count(*) as votes, min(pos) as first from frames group by 1, 2, 3" for f in FUSED) + ") where value not in ('', 'нет')), "
    "ranked as (select *, row_number() over (partition by track_id, field order by case when field = 'id_sku' and regexp_full_match(value, '[0-9]{9,}') then case when length(value) = 12 then 2 else 1 end when field = 'print_datetime' then 1 "
    f"when field = 'barcode' then case when {ean_sql('value')} then 1 else 0 end else 0 end desc, case when field = 'id_sku' and regexp_full_match(value, '[0-9]{{9,}}') then length(value) else 0 end desc, "
    "case when field = 'id_sku' and regexp_full_match(value, '[0-9]{9,}') then 0 else votes end desc, case when field = 'barcode' then length(value) else 0 end desc, first) as n from said) "
    "select track_id, " + ", ".join(f"coalesce(max(case when field = '{f}' and n = 1 then value end), '') as {f}" for f in FUSED) + " from (select distinct track_id from frames) left join ranked using (track_id) group by 1"
)


@query(_FUSE, "ocr_frames", "tokens")
def fuse_track(spark, sf_dir):
    met = view(spark, sf_dir, "ocr_frames").join(token_lists(spark, sf_dir), "pos", "left").withColumn("track_id", F.floor(F.col("pos") / 100))
    return fusion.fuse(fusion.parsed_frames(met, "tokens"), ["track_id"], FUSED)


_MERGED = "merged as (select video, track_id, min(pos) as pos, string_agg(ocr_text, chr(10) order by rnk, pos) as ocr_text from ocr_frames group by 1, 2)"
_OF_MERGED = {k: PLAIN_SQL[k].replace("ocr_frames", "merged") for k in ("parse_sku", "parse_code", "parse_datetime")}
_OLD = {"id_sku": "case when pos % 3 = 0 then 'нет' when pos % 3 = 1 then '270000000001' else '' end", "code": "case when pos % 2 = 0 then '270102 - 012345' else '1_012345' end", "print_datetime": "case when pos % 4 = 0 then '01.01.2024' else '' end"}


@query(
    f"with {_MERGED}, old as (select video, track_id, pos, {', '.join(f'{e} as {c}' for c, e in _OLD.items())} from merged) select video, track_id, case when old.id_sku in ('', 'нет') and s.sku <> '' then s.sku else old.id_sku end as id_sku, "
    f"case when old.code = '270102 - 012345' and c.code <> 'нет' then c.code else old.code end as code, case when old.print_datetime = '' and d.printed <> '' then d.printed else old.print_datetime end as print_datetime "
    f"from old join ({_OF_MERGED['parse_sku']}) s using (pos) join ({_OF_MERGED['parse_code']}) c using (pos) join ({_OF_MERGED['parse_datetime']}) d using (pos)",
    "ocr_frames",
)
def reparse_text(spark, sf_dir):
    merged = tracks.merge(view(spark, sf_dir, "ocr_frames"), ["video", "track_id"]).select("video", "track_id", "pos", "ocr_text")
    old = merged.withColumns({c: F.expr(e) for c, e in _OLD.items()})
    return fusion.reparse(old, "ocr_text").select("video", "track_id", *_OLD)


_EAN_HIT = lambda c: f"{_T(c)} when regexp_replace(regexp_replace(trim(g.{c}), '[.]0$', ''), '[^0-9]', '', 'g') = regexp_replace(regexp_replace(trim(p.{c}), '[.]0$', ''), '[^0-9]', '', 'g') and regexp_matches(g.{c}, '[0-9]') then 1 else 0 end"
_COUNT_HIT = lambda c: f"{_T(c)} when cast(try_cast(g.{c} as double) as int) = cast(try_cast(p.{c} as double) as int) then 1 else 0 end"
_KIND_SQL = {"name": lambda c: _NAME, "price": _PRICE, "ean": _EAN_HIT, "code": _EAN_HIT, "text": _TEXT, "count": _COUNT_HIT}
_MATCH23 = (
    "m as (select g.video, g.gt_pos, p.pred_pos from (select video, barcode, min(pos) as gt_pos from gt23 where length(barcode) between 12 and 13 group by 1, 2 having count(*) = 1) g "
    "join (select video, barcode, min(pos) as pred_pos from tags23 where length(barcode) between 12 and 13 group by 1, 2) p on g.video = p.video and g.barcode = p.barcode)"
)
_HITS23 = "h as (select m.video, m.gt_pos, m.pred_pos, " + ", ".join(f"{_KIND_SQL[k](c)} as hit_{c}" for c, k in E.ALL_FIELDS.items()) + " from m join gt23 g on g.pos = m.gt_pos join tags23 p on p.pos = m.pred_pos)"
_SUM23 = " + ".join(f"hit_{c}" for c in E.ALL_FIELDS)


def _hits23(spark, sf_dir):
    return E.barcode_hits(view(spark, sf_dir, "gt23"), view(spark, sf_dir, "tags23"), E.ALL_FIELDS)


@query(f"with {_MATCH23}, {_HITS23} select *, {_SUM23} as hits from h", "gt23", "tags23")
def field_match_23(spark, sf_dir):
    return _hits23(spark, sf_dir)


@query(f"with {_MATCH23}, {_HITS23} select t.video, gt_rows, coalesce(matched, 0) as matched, coalesce(successes, 0) as successes, round(coalesce(successes, 0) / gt_rows, 4) as target from (select video, count(*) as gt_rows from gt23 group by 1) t left join (select video, count(*) as matched, count(*) filter (where {_SUM23} >= 19) as successes from h group by 1) s on t.video = s.video", "gt23", "tags23")
def target_metric_23(spark, sf_dir):
    return E.target(_hits23(spark, sf_dir), view(spark, sf_dir, "gt23"), len(E.ALL_FIELDS))


@query(f"with {_MATCH23}, {_HITS23} select field, sum(hit) as hits, count(*) as total from (" + " union all ".join(f"select '{c}' as field, hit_{c} as hit from h" for c in E.ALL_FIELDS) + ") group by 1", "gt23", "tags23")
def field_hit_rates(spark, sf_dir):
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col("hit_" + f).alias("hit")) for f in E.ALL_FIELDS)))
    return _hits23(spark, sf_dir).select(each).groupBy("field").agg(F.sum("hit").alias("hits"), F.count("*").alias("total"))


@query(f"with {_MATCH23}, {_HITS23} select video, gt_pos, {_SUM23} as hits from h where {_SUM23} between 17 and 22", "gt23", "tags23")
def near_miss_23(spark, sf_dir):
    return _hits23(spark, sf_dir).where("hits between 17 and 22").select("video", "gt_pos", "hits")


_INDEX = "idx as (select distinct code from (select barcode as code from catalog union all select substr(barcode, 1, 12) from catalog))"
_GRAMS = (
    "said as (select pos, track_id, " + _FIX.replace("ocr_text", "text") + " as t from track_codes where trim(text) <> ''), dig as (select pos, track_id, t, regexp_replace(t, '[^0-9]', '', 'g') as g, regexp_replace(t, '[0-9]{14,}', 'x', 'g') as s from said), "
    "cand as (select pos, track_id, unnest(list_filter(regexp_extract_all(s, '[0-9]+'), lambda x: length(x) between 12 and 13)) as code, cast(0 as bigint) as place from dig "
    "union all select pos, track_id, substr(g, cast(i as bigint), n) as code, cast((13 - n) * 1000 + i as bigint) as place from dig, (select unnest([12, 13]) as n), lateral (select unnest(generate_series(1, length(g) - n + 1)) as i) where length(g) >= n)"
)
_NGRAM = (
    f"{_INDEX}, {_GRAMS}, votes as (select track_id, code, count(*) as votes, min(pos * 100000 + place) as seen from cand group by 1, 2), lone as (select track_id, count(*) = 1 as lone from said group by 1), "
    f"told as (select v.*, lone, {ean_sql('v.code')} and (a.code is not null or b.code is not null) as passes from votes v join lone using (track_id) left join idx a on a.code = v.code left join idx b on b.code = substr(v.code, 1, 12)), "
    "best as (select track_id, code as barcode, votes from told where votes >= 2 or (lone and passes) qualify row_number() over (partition by track_id order by votes >= 2 desc, passes desc, case when passes then votes end desc nulls last, case when passes then code end desc nulls last, seen) = 1)"
)


@query(f"with {_NGRAM} select * from best", "track_codes", "catalog")
def ngram_votes(spark, sf_dir):
    return recovery.ngram_votes(view(spark, sf_dir, "track_codes"), view(spark, sf_dir, "catalog"), ["track_id"], "text")


@query(
    f"with {_INDEX}, v as (select track_id, barcode as code, count(*) as votes, min(pos) as first from track_codes where length(barcode) >= 12 group by 1, 2) select track_id, code as barcode, votes from (select v.*, {ean_sql('v.code')} as ok, a.code is not null or b.code is not null as known from v left join idx a on a.code = v.code left join idx b on b.code = substr(v.code, 1, 12)) "
    "where ok and known qualify row_number() over (partition by track_id order by votes desc, ok desc, known desc, length(code) desc, first) = 1",
    "track_codes", "catalog",
)
def decoder_ranking(spark, sf_dir):
    return recovery.rank_hits(view(spark, sf_dir, "track_codes"), view(spark, sf_dir, "catalog"), ["track_id"], "barcode")


@query(
    f"with {_INDEX.replace('idx as', 'idx as')}, good as (select distinct track_id from track_codes where {ean_sql('barcode')}), lacking as (select * from track_codes where track_id not in (select track_id from good)), "
    + _NGRAM.replace(_INDEX + ", ", "").replace("from track_codes", "from lacking")
    + " select t.pos, coalesce(b.barcode, t.barcode) as barcode, b.barcode is not null as recovered from track_codes t left join best b using (track_id)",
    "track_codes", "catalog",
)
def recover_tracks(spark, sf_dir):
    return recovery.recover_tracks(view(spark, sf_dir, "track_codes"), view(spark, sf_dir, "catalog"), ["track_id"], "text", "barcode").select("pos", "barcode", "recovered")


@query("select count(distinct track_id) as tracks, count(distinct case when ok then track_id end) as good from (select track_id, " + ean_sql("barcode") + " as ok from track_codes)", "track_codes")
def tracks_with_code(spark, sf_dir):
    frames = view(spark, sf_dir, "track_codes")
    every = frames.agg(F.count_distinct("track_id").alias("tracks"))
    lacking = recovery.needs_code(frames, ["track_id"], "barcode").agg(F.count("*").alias("n"))
    return every.crossJoin(lacking).select("tracks", (F.col("tracks") - F.col("n")).alias("good"))  # two single rows


_CROP = "case when (y1 - y0) * 100 < 60 * (x1 - x0) or (y1 - y0) * 100 > 120 * (x1 - x0) then 'ar' when score % 100 < 20 then 'paper' when score % 37 < 5 then 'sharp' else 'ok' end"


def _judged(spark, sf_dir):
    f = view(spark, sf_dir, "ocr_frames")
    reason = filters.crop_problem((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")), (F.col("score") % 100).cast("double") / 100, (F.col("score") % 37).cast("double"), (0.6, 1.2), 0.2, 5.0)
    return f.withColumn("reason", reason)


@query(f"select reason, count(*) as frames, count(distinct track_id) as tracks from (select track_id, {_CROP} as reason from ocr_frames) group by 1", "ocr_frames")
def crop_reasons(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("frames"), F.count_distinct("track_id").alias("tracks"))


@query(f"select pos from ocr_frames where track_id in (select track_id from ocr_frames where {_CROP} = 'ok')", "ocr_frames")
def kept_tracks(spark, sf_dir):
    judged = _judged(spark, sf_dir)
    return filters.of_kept_tracks(judged, judged.where("reason = 'ok'"), ["track_id"]).select("pos")


_GATED = "g as (select pos, track_id, score, abs(event_gap) <= 1.8 * med as calm from (select *, quantile_cont(event_gap, 0.5) over (partition by track_id) as med from (select pos, cast(floor(pos / 50) as bigint) as track_id, score, cast(score * 7 % 101 as double) as event_gap from ocr_frames)))"


@query(f"with {_GATED} select track_id, pos, choice from (select *, row_number() over (partition by track_id order by score desc, pos) as choice from (select *, bool_or(calm) over (partition by track_id) as any_calm from g) where calm or not any_calm) where choice <= 2", "ocr_frames")
def sharpest_calm_frames(spark, sf_dir):
    f = view(spark, sf_dir, "ocr_frames").select("pos", F.floor(F.col("pos") / 50).alias("track_id"), "score", (F.col("score") * 7 % 101).cast("double").alias("motion"))
    return filters.sharpest_calm(f, ["track_id"], "motion", "score", 2).select("track_id", "pos", "choice")


@query("select status, count(*) as tags from (select case when d.hit is null then 'miss' when d.hit = d.barcode then 'EXACT' when substr(d.hit, 1, 12) = substr(d.barcode, 1, 12) then 'PREFIX12' else 'ANY' end as status from (select g.pos, g.barcode, nullif(d.barcode, '') as hit from (select t.pos, c.barcode from track_codes t cross join (select count(*) as parts from catalog) n join catalog c on c.part_id = t.track_id * 7919 % parts) g join track_codes d using (pos)) d) group by 1", "track_codes", "catalog")
def decode_probe(spark, sf_dir):
    t = view(spark, sf_dir, "track_codes")
    c = view(spark, sf_dir, "catalog")
    truth = t.select("pos", "track_id").crossJoin(c.agg(F.count("*").alias("parts")))  # one single row
    truth = truth.select("pos", (F.col("track_id") * 7919 % F.col("parts")).alias("part_id")).join(c.select("part_id", "barcode"), "part_id")
    hits = t.where("barcode <> ''").select("pos", F.col("barcode").alias("hit"))
    return filters.probe_status(truth, hits, ["pos"]).groupBy("status").agg(F.count("*").alias("tags"))


@query(
    "select round(avg(case when hit then 1.0 else 0.0 end), 6) as recall, count(*) as gt_rows from (select g.pos, coalesce(bool_or(cast(i as double) / (ga + da - i) >= 0.3), false) as hit from (select *, (x_max - x_min) * (y_max - y_min) as ga from gt) g left join (select *, (x_max - x_min) * (y_max - y_min) as da from (select video, frame_timestamp, x_min + discount * 4 as x_min, y_min, x_max + discount * 4 as x_max, y_max from detections)) d on g.video = d.video and abs(g.frame_timestamp - d.frame_timestamp) <= 1500, "
    "lateral (select cast(greatest(least(g.x_max, d.x_max) - greatest(g.x_min, d.x_min), 0) as bigint) * greatest(least(g.y_max, d.y_max) - greatest(g.y_min, d.y_min), 0) as i) group by 1)",
    "gt", "detections",
)
def detector_recall(spark, sf_dir):
    gt = view(spark, sf_dir, "gt")
    shifted = view(spark, sf_dir, "detections").withColumns({c: F.col(c) + 4 * F.col("discount") for c in ("x_min", "x_max")})
    at = ["video", "frame_timestamp", *tracks.BOX]
    hit = E.like_boxes(shifted, gt, 1500, 0.3).select("video", *[F.col("r_" + c).alias(c) for c in at[1:]]).distinct()
    met = gt.join(hit, at, "left_semi").select("pos").distinct().withColumn("hit", F.lit(1.0))
    return gt.select("pos").distinct().join(met, "pos", "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"), F.count("*").alias("gt_rows"))


@query("select pos, case when a.barcode_raw is not null then a.barcode_raw else coalesce(b.barcode_raw, '') end as found from (select pos, frame_ts_ms - (pos % 3) * 40 as ts, case when pos % 2 = 0 then x0 else x0 + 1 end as x, y0 as y from ocr_frames) f left join (select frame_ts_ms, x0, y0, min(barcode_raw) as barcode_raw from ocr_frames group by 1, 2, 3) a on a.frame_ts_ms = f.ts and a.x0 = f.x and a.y0 = f.y left join (select frame_ts_ms, min(barcode_raw) as barcode_raw from ocr_frames group by 1) b on b.frame_ts_ms = f.ts", "ocr_frames")
def exact_key_fallback(spark, sf_dir):
    f = view(spark, sf_dir, "ocr_frames")
    left = f.select("pos", (F.col("frame_ts_ms") - (F.col("pos") % 3) * 40).alias("ts"), F.when(F.col("pos") % 2 == 0, F.col("x0")).otherwise(F.col("x0") + 1).alias("x"), F.col("y0").alias("y"))
    right = f.select(F.col("frame_ts_ms").alias("ts"), F.col("x0").alias("x"), F.col("y0").alias("y"), "barcode_raw")
    return joins.by_keys_in_turn(left, right, [["ts", "x", "y"], ["ts"]], "barcode_raw").select("pos", F.coalesce("barcode_raw", F.lit("")).alias("found"))


@query("select g.pos, count(d.pos) as near from gt g left join detections d on g.video = d.video and abs(g.frame_timestamp - d.frame_timestamp) < 10 and abs(g.x_min - d.x_min) < 8 and abs(g.y_min - d.y_min) < 8 group by 1", "gt", "detections")
def near_key_tight(spark, sf_dir):
    cols = ["pos", "video", "frame_timestamp", "x_min", "y_min"]
    gt = view(spark, sf_dir, "gt").select(*cols)
    met = joins.band_join(gt, view(spark, sf_dir, "detections").select(*cols), ["video"], "frame_timestamp", 10, strict=True, also=(("x_min", 8, True), ("y_min", 8, True)))
    return gt.select("pos").distinct().join(met.groupBy("pos").agg(F.count("*").alias("near")), "pos", "left").fillna(0, ["near"])


@query("select pos, case when pos % 3 = 0 then '' else product_name end || ' | ' || case when barcode = '' then '-' else barcode end || ' | ' || coalesce(cast(coalesce(price_default, price_card) as varchar), '-') as label, left(array_to_string(string_split(product_name || ' из ' || color || ' ' || id_sku || ' ' || print_datetime, ' ')[1:4], ' '), 36) || ' …' || right(barcode, 4) as short from detections", "detections")
def display_labels(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    name = F.when(F.col("pos") % 3 == 0, "").otherwise(F.col("product_name"))
    return d.select("pos", filters.row_label(name, F.col("barcode"), [F.col("price_default"), F.col("price_card")]).alias("label"), filters.short_label(F.concat_ws(" ", "product_name", F.lit("из"), "color", "id_sku", "print_datetime"), F.col("barcode")).alias("short"))


@query("select pos, barcode is not null and regexp_matches(barcode, '^(2099999|2999999|0000000)') as placeholder, len(list_distinct(string_split(barcode, ''))) > 3 and length(barcode) - length(replace(barcode, '0', '')) < 6 as plausible from track_codes where barcode <> ''", "track_codes")
def code_noise(spark, sf_dir):
    return view(spark, sf_dir, "track_codes").where("barcode <> ''").select("pos", filters.placeholder_code(F.col("barcode")).alias("placeholder"), filters.plausible_digits(F.col("barcode")).alias("plausible"))


@query("select pos, case when length(barcode) >= 12 and price_card * 100 < price_default * 98 and cast(floor((price_default - price_card) * 100.0 / price_default) as int) between 5 and 90 then '-' || cast(cast(floor((price_default - price_card) * 100.0 / price_default) as int) as varchar) || '%' else 'старая' end as discount_amount from detections", "detections")
def forced_discount(spark, sf_dir):
    return view(spark, sf_dir, "detections").select("pos", S.forced_discount(F.lit("старая"), F.col("price_default"), F.col("price_card"), F.col("barcode")).alias("discount_amount"))


@query("select track_id, value, votes from (select cast(floor(pos / 100) as bigint) as track_id, sku as value, count(*) as votes, min(pos) as first from (" + PLAIN_SQL["parse_sku"] + ") where sku <> '' group by 1, 2) qualify row_number() over (partition by track_id order by length(value) = 12 desc, length(value) desc, first) = 1", "ocr_frames")
def best_sku(spark, sf_dir):
    f = view(spark, sf_dir, "ocr_frames").select("pos", F.floor(F.col("pos") / 100).alias("track_id"), T.parse_id_sku(F.col("ocr_text")).alias("sku"))
    return V.best_sku(f, ["track_id"], "sku")


@query("select pos, case pos % 4 when 0 then x0 when 1 then y0 when 2 then 2000 - x1 else 2000 - y1 end as x_min, case pos % 4 when 0 then y0 when 1 then 1000 - x1 when 2 then 1000 - y1 else x0 end as y_min from ocr_frames", "ocr_frames")
def rotated_boxes(spark, sf_dir):
    f = view(spark, sf_dir, "ocr_frames")
    b = G.unrotate((F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), (F.col("pos") % 4) * 90, F.lit(2000), F.lit(1000))
    return f.select("pos", b[0].alias("x_min"), b[1].alias("y_min"))


@query("select pos, barcode, votes from (with p as (select pos, video % 20 as video, barcode, product_name from detections where barcode <> '' and product_name <> '') select video, min(pos) as pos, barcode, count(*) as votes from p group by video, barcode qualify row_number() over (partition by video order by min(pos)) <= 40)", "detections")
def seen_products(spark, sf_dir):
    d = view(spark, sf_dir, "detections").withColumn("video", F.col("video") % 20)
    return filters.first_products(d, ["video"], 40).select("pos", "barcode", "votes")


@query("select g.pos, min(abs(g.ts - f.frame_ts_ms)) as gap from (select pos, video, frame_ts_ms + 17 * (pos % 5) as ts from ocr_frames) g join ocr_frames f on f.video = g.video and abs(g.ts - f.frame_ts_ms) <= 40 group by 1", "ocr_frames")
def nearest_time_group(spark, sf_dir):
    f = view(spark, sf_dir, "ocr_frames")
    left = f.select("pos", "video", (F.col("frame_ts_ms") + 17 * (F.col("pos") % 5)).alias("frame_ts_ms"))
    gap = F.abs(F.col("frame_ts_ms") - F.col("r_frame_ts_ms"))
    return joins.nearest(left, f.select("pos", "video", "frame_ts_ms"), ["video"], "frame_ts_ms", 40, gap).select("pos", gap.alias("gap"))


_HOLD = "case when video % 5 = 0 then 'holdout' when pos % 10 = 0 then 'valid' else 'train' end"


@query(f"select {_HOLD} as part, count(*) as rows, count(distinct video) as videos from detections group by 1", "detections")
def holdout_split(spark, sf_dir):
    d = view(spark, sf_dir, "detections")
    held, rest = filters.split_by(d, F.col("video") % 5 == 0)
    valid, train = filters.split_by(rest, F.col("pos") % 10 == 0)
    parts = [p.select(F.lit(n).alias("part"), "video") for n, p in (("holdout", held), ("valid", valid), ("train", train))]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("part").agg(F.count("*").alias("rows"), F.count_distinct("video").alias("videos"))


@query("with v as (select pos, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda w: w not in ('vino', 'wine')))) as word from (select part_id as pos, left(name, length(name) - 9) as text from catalog)) select pos, count(distinct part_id) as holders from v join catalog on contains(lower(name), word) group by 1", "catalog")
def substring_fallback(spark, sf_dir):
    from tagloom.operators import fuzzy
    from tagloom.plans.catalog_queries import misread

    c = view(spark, sf_dir, "catalog")
    return fuzzy.holders(misread(c), c, "text")


@query("with best as (select track_id, count(*) as n, avg(score) as mean from (select cast(floor(pos / 500) as bigint) as track_id, score from ocr_frames) group by 1) select arg_max(track_id, mean) as experiment, round(max(mean), 6) as metric from best", "ocr_frames")
def best_experiment(spark, sf_dir):
    runs = view(spark, sf_dir, "ocr_frames").groupBy(F.floor(F.col("pos") / 500).alias("track_id")).agg(F.avg("score").alias("mean"))
    return runs.agg(F.max_by("track_id", "mean").alias("experiment"), F.round(F.max("mean"), 6).alias("metric"))


@query(
    f"with r as (select distinct pos, substr(g, cast(i as bigint), 12) as run from (select pos, regexp_replace({_FIX.replace('ocr_text', 'text')}, '[^0-9]', '', 'g') as g from track_codes), lateral (select unnest(generate_series(1, length(g) - 11)) as i) where length(g) >= 12), "
    "v as (select run, substr(run, 1, cast(i as bigint) - 1) || cast(x as varchar) || substr(run, cast(i as bigint) + 1) as body from (select distinct run from r), (select unnest(generate_series(1, 12)) as i) i, (select unnest(generate_series(0, 9)) as x) x where substr(run, cast(i as bigint), 1) <> cast(x as varchar)) "
    "select pos, barcode, count(*) as votes from r join v using (run) join catalog c on substr(c.barcode, 1, 12) = v.body group by 1, 2",
    "track_codes", "catalog",
)
def one_digit_votes(spark, sf_dir):
    t = view(spark, sf_dir, "track_codes")
    runs = t.select("pos", F.explode(F.array_distinct(F.filter(recovery.code_candidates(F.col("text")), lambda c: F.length(c) == 12))).alias("run"))
    return C.recover_one_digit(runs, view(spark, sf_dir, "catalog"), ["pos", "run"], "run").groupBy("pos", "barcode").agg(F.count("*").alias("votes"))
