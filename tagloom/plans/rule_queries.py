"""Rules on boxes, names, uploads, jobs and codes, and the rows that files are written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import geometry as G
from tagloom.functions import text as T
from tagloom.operators import filters, jobs, joins
from tagloom.plans.registry import query
from tagloom.plans.text_queries import _EAN, ean_sql
from tagloom.sources import readers
from tagloom.sources.adapters import view


@query("select pos from detections where x_max - x_min between 50 and 200 and y_max - y_min between 50 and 200 and (y_max - y_min) / (x_max - x_min) between 0.45 and 0.6", "detections")
def plausible_boxes(spark, sf_dir):
    fits = filters.plausible_box(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"), (50, 200), (0.45, 0.6))
    return view(spark, sf_dir, "detections").where(fits).select("pos")


_NAMED = "name || case part_id % 4 when 0 then ' Вино красное' when 1 then ' dark RUM' when 2 then ' Коньяк' else ' rumble' end"


@query(f"select part_id from (select part_id, lower({_NAMED}) as n from catalog) where regexp_matches(n, 'вин|wine|коньяк|brandy|beer|cider|champagne|\\b[a-z]*rum\\b|gin\\b|sparkling|juice')", "catalog")
def beverage_subset(spark, sf_dir):
    named = view(spark, sf_dir, "catalog").select("part_id", F.expr(_NAMED).alias("name"))
    return filters.subset(named, "name", "beverage").select("part_id")


@query(
    "select id, case when id % 5 = 4 then 'extension' when id % 7 = 6 then 'mime' when id * 7919 % 600 > 500 then 'size' when id % 320 > 300 then 'duration' when id * 3 % 4000 not between 320 and 3840 or id * 5 % 2300 not between 240 and 2160 then 'resolution' end as problem from jobs",
    "jobs",
)
def upload_problems(spark, sf_dir):
    i = F.col("id")
    extension = F.element_at(F.array(*map(F.lit, ("mp4", "AVI", "mov", "mkv", "exe"))), (i % 5 + 1).cast("int"))
    mime = F.when(i % 7 == 6, "text/plain").otherwise("video/mp4")
    problem = jobs.upload_problem(extension, mime, i * 7919 % 600 * 1024 * 1024, i % 320, i * 3 % 4000, i * 5 % 2300)
    return view(spark, sf_dir, "jobs").select("id", problem.alias("problem"))


@query(
    "select user_id, id from (select *, row_number() over (partition by user_id order by k) as first from (select *, row_number() over (partition by user_id order by created_at desc, id) as k from jobs) where k <= 20 and status in ('queued', 'processing') and id % 4 <> 0) where first = 1",
    "jobs",
)
def active_jobs(spark, sf_dir):
    told = view(spark, sf_dir, "jobs").withColumn("message", F.when(F.col("id") % 4 == 0, "Task was Revoked"))
    return jobs.latest_active(told)


_BOUNDS = (60, 300, 600, 1800, 3000)


@query(
    f"select le, (select count(*) from jobs where status = 'done' and (b.le is null or id % 3600 <= b.le)) as jobs from (select unnest([{', '.join(map(str, _BOUNDS))}, null]) as le) b",
    "jobs",
)
def duration_histogram(spark, sf_dir):
    done = view(spark, sf_dir, "jobs").where("status = 'done'").select((F.unix_timestamp("updated_at") - F.unix_timestamp("created_at")).alias("seconds"))
    return jobs.duration_histogram(done, "seconds", _BOUNDS)


@query("select id, case when s >= 1073741824 then printf('%.2f GB', s / 1073741824.0::double) else printf('%.2f MB', s / 1048576.0::double) end as label from (select id, id * 7919 * 131072 % 3000000000 as s from jobs)", "jobs")
def size_labels(spark, sf_dir):
    return view(spark, sf_dir, "jobs").select("id", jobs.size_label(F.col("id") * 7919 * 131072 % 3000000000).alias("label"))


@query("select case when bool_or(bad and critical) then 'unhealthy' when bool_or(bad) then 'degraded' else 'ok' end as status from (select n_nationkey % 6 = 5 as bad, n_nationkey % 2 = 0 as critical from nation)")
def health_status(spark, sf_dir):
    k = F.col("n_nationkey")
    return jobs.health(view(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (k % 6 != 5).alias("ok"), (k % 2 == 0).alias("critical")))


_DECODED = "select pos, cast(floor(pos / 10) as bigint) as track_id, rnk, case when pos % 3 = 0 then '' else 'B' || pos end as barcode_raw, case when pos % 2 = 0 then 'Q' || pos else '' end as qr_raw from {ocr_frames}"


@query(
    f"with d as ({_DECODED.format(ocr_frames='ocr_frames')}), t as (select track_id, rnk, arg_min(barcode_raw, pos) filter (barcode_raw <> '') as b, arg_min(qr_raw, pos) filter (qr_raw <> '') as q from d group by 1, 2) "
    "select pos, case when barcode_raw = '' then coalesce(b, '') else barcode_raw end as barcode_raw, case when qr_raw = '' then coalesce(q, '') else qr_raw end as qr_raw from ocr_frames f left join t on t.track_id = f.track_id and t.rnk = f.rnk",
    "ocr_frames",
)
def fill_codes_by_rank(spark, sf_dir):
    frames = view(spark, sf_dir, "ocr_frames")
    return joins.fill_by_keys(frames, spark.sql(_DECODED, ocr_frames=frames), ["track_id", "rnk"], ["barcode_raw", "qr_raw"]).select("pos", "barcode_raw", "qr_raw")


_MARKS = """select pos, [{'i': 1, 't': case pos % 4 when 0 then 'К' when 1 then 'Ш.' when 2 then 'кк' else 'Ц1' end, 'h': pos * 10 % 70}, {'i': 2, 't': case pos % 3 when 0 then ' ш ' when 1 then 'Ц' else 'abc' end, 'h': pos * 10 % 110},
{'i': 3, 't': case when pos % 5 = 0 then 'к' else 'ц' end, 'h': pos * 10 % 130}] as marks from ocr_frames"""


@query(
    f"with m as (select pos, unnest(marks) as m from ({_MARKS})), c as (select pos, m.i as i, m.h as h, upper(regexp_replace(trim(m.t), '[^КШЦкшц]', '', 'g')) as c, trim(m.t) as t from m), r as (select pos, c, row_number() over (partition by pos order by count(*) desc, max(h) desc, min(i)) as k from c where length(c) = 1 and length(t) <= 3 and not regexp_matches(t, '[0-9]') group by 1, 2) "
    "select f.pos, coalesce(c, 'нет') as mark from ocr_frames f left join r on r.pos = f.pos and k = 1",
    "ocr_frames",
)
def special_marks(spark, sf_dir):
    p = F.col("pos")
    pick = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), (p % n + 1).cast("int"))
    token = lambda text, most: F.struct(text.alias("text"), F.lit(1.0).alias("conf"), (p * 10 % most).cast("double").alias("height"))
    tokens = F.array(token(pick(4, "К", "Ш.", "кк", "Ц1"), 70), token(pick(3, " ш ", "Ц", "abc"), 110), token(pick(5, "к", "ц", "ц", "ц", "ц"), 130))
    return view(spark, sf_dir, "ocr_frames").select("pos", T.special_symbol(tokens).alias("mark"))


_RUN = "case when part_id % 5 = 0 then substr(barcode, 1, 11) || '0' || part_id % 10 when part_id % 5 = 1 then substr(barcode, 1, 12) when part_id % 5 = 2 then substr(barcode, 3, 8) when part_id % 5 = 3 then barcode || '77' else '9' || substr(barcode, 1, 12) end"
_PIECES = "case when length(d) >= 13 then greatest(substr(d, 1, 12), substr(d, 2, 12)) when length(d) = 12 then d else '' end"


@query(
    f"with r as (select part_id, {_RUN} as d from catalog), p as (select part_id, d, unnest([substr(d, 1, 12), substr(d, 2, 12)]) as p from r), c as (select part_id, p || cast({_EAN.format('p')} as varchar) as c from p where length(p) = 12 and p like '%0' "
    f"union all select part_id, substr(d, 1, 13) from r where {ean_sql('substr(d, 1, 13)')}) select part_id, coalesce((select max(c) from c where c.part_id = r.part_id), {_PIECES}) as ean from r",
    "catalog",
)
def best_digit_codes(spark, sf_dir):
    return view(spark, sf_dir, "catalog").select("part_id", T.best_digits(F.expr(_RUN)).alias("ean"))


@query("select part_id, s as start, substr(barcode, cast(s as bigint) + 1, case when whole then 13 else 2 end) as digits from catalog, (select unnest([0, 2, 4, 6, 8, 10, 12]) as s, false as whole union all select 0, true) g", "catalog")
def digit_group_reads(spark, sf_dir):
    return view(spark, sf_dir, "catalog").select("part_id", F.explode(T.digit_groups(F.col("barcode"))).alias("g")).select("part_id", "g.start", "g.digits")


_OTHER = "case pos % 4 when 0 then '' when 1 then ' ' || substr(ocr_text, 4, 6) || ' ' when 2 then 'TOP line' else barcode_raw end"
_BOTH = f"select pos, trim(ocr_text) as a, trim({_OTHER}) as b from ocr_frames"


@query(
    f"with t as ({_BOTH}), j as (select pos, a, b, case when b = '' then a when a = '' then b else a || chr(10) || b end as joined from t) select pos, joined, case when contains(a, b) then a else joined end as appended, "
    "array_to_string([x for x, i in l if list_position([lower(y) for y in l], lower(x)) = i], chr(10)) as lines from (select *, [trim(x) for x in string_split(joined || chr(10) || ' NO ' || chr(10) || upper(b), chr(10)) if trim(x) <> ''] as l from j)",
    "ocr_frames",
)
def merged_texts(spark, sf_dir):
    t = view(spark, sf_dir, "ocr_frames").select("pos", F.col("ocr_text").alias("a"), F.expr(_OTHER).alias("b"))
    joined = T.joined_text(F.col("a"), F.col("b"))
    more = F.concat_ws("\n", joined, F.lit(" NO "), F.upper(F.trim("b")))
    return t.select("pos", joined.alias("joined"), T.appended_text(F.col("a"), F.col("b")).alias("appended"), T.distinct_lines(more).alias("lines"))


@query("select p_partkey as part_id, sqrt((w * w + h * h)::double) * 4.2 / 7.9 as fx, sqrt((w * w + h * h)::double) * 4.2 / 7.9 as fy, w / 2 as cx, h / 2 as cy from (select p_partkey, 640 + p_partkey % 3000 as w, 480 + p_partkey % 1700 as h from part)")
def camera_matrices(spark, sf_dir):
    k = F.col("p_partkey")
    return view(spark, sf_dir, "part").select(k.alias("part_id"), G.camera_matrix(640 + k % 3000, 480 + k % 1700, 4.2, 7.9).alias("m")).select("part_id", "m.*")


@query("select pos, '0 ' || printf('%.6f', (x_min + x_max) / 2000) || ' ' || printf('%.6f', (y_min + y_max) / 2000) || ' ' || printf('%.6f', (x_max - x_min) / 1000) || ' ' || printf('%.6f', (y_max - y_min) / 1000) as value from detections", "detections")
def yolo_label_rows(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections").withColumns({"cls": F.lit(0), "width": F.lit(1000), "height": F.lit(1000)})
    return readers.yolo_labels(boxes, carry=("pos",))


@query("select '{\"pos\":' || pos || ',\"barcode\":\"' || barcode || '\",\"price\":' || case when pos % 3 = 0 then 'null' else cast(pos % 100 + 0.5 as varchar) end || '}' as value from detections", "detections")
def json_rows(spark, sf_dir):
    price = F.when(F.col("pos") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("pos") % 100 + 0.5)
    return readers.as_json(view(spark, sf_dir, "detections").select("pos", "barcode", price.alias("price")))


_PATH = "'/data/' || case part_id % 4 when 0 then 'original/' when 1 then 'Videos/' when 2 then 'cache/' else 'misc/' end || case when part_id % 3 = 0 then barcode else 'x' || substr(barcode, 1, 12) || '_1' end || '.mp4'"


@query(f"select part_id, nullif(regexp_extract(path, '(^|[^0-9])([0-9]{{12,13}})([^0-9][^/]*)?$', 2), '') as ean from (select part_id, {_PATH} as path from catalog)", "catalog")
def ean_from_path(spark, sf_dir):
    return view(spark, sf_dir, "catalog").select("part_id", readers.ean_of_path(F.expr(_PATH)).alias("ean"))


@query(f"select name, path from (select *, row_number() over (partition by name order by case part_id % 4 when 0 then 2 when 1 then 2 when 2 then 0 else 1 end desc, path desc) as k from (select part_id, part_id % 50 as name, {_PATH} as path from catalog)) where k = 1", "catalog")
def best_paths(spark, sf_dir):
    return readers.best_path(view(spark, sf_dir, "catalog").select((F.col("part_id") % 50).alias("name"), F.expr(_PATH).alias("path")))
