"""Jobs, reports and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import jobs as J
from tagloom.operators import reporting as R
from tagloom.operators.catalog import exact_match
from tagloom.plans.registry import query
from tagloom.sources.adapters import view

FIELDS = ["product_name", "price_default", "price_card", "barcode", "id_sku", "print_datetime", "color", "special_symbols", "qr_code_barcode", "discount"]
FILL = "(" + " + ".join(f"case when lower(trim(coalesce(cast({c} as varchar), ''))) in ('', 'nan', 'none') then 0 else 1 end" for c in FIELDS) + ") / 10.0"
DAYS = 200


def _seconds():
    return (F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6


def _as_of(jobs):
    """The last moment in the table, in place of the clock; one row, so that it may be joined to every row."""
    return jobs.crossJoin(F.broadcast(jobs.agg(F.max("created_at").alias("as_of"))))


@query("select id, status, user_id, created_at from jobs where user_id = 3 and status = 'done' order by created_at desc, id limit 20", "jobs")
def jobs_filter_recent(spark, sf_dir):
    return J.latest(view(spark, sf_dir, "jobs"), user_id=3, status="done", limit=20).select("id", "status", "user_id", "created_at")


@query(f"select id, status, created_at from jobs where created_at >= (select max(created_at) from jobs) - interval {DAYS} day", "jobs")
def jobs_in_range(spark, sf_dir):
    return J.in_range(_as_of(view(spark, sf_dir, "jobs")), F.col("as_of"), DAYS).select("id", "status", "created_at")


@query("select id, status from jobs where status in ('done', 'error') and files_deleted_at is null and created_at < (select max(created_at) from jobs) - interval 30 day", "jobs")
def jobs_retention(spark, sf_dir):
    return J.expired(_as_of(view(spark, sf_dir, "jobs")), F.col("as_of"), 30).select("id", "status")


@query("select cast(created_at as date) as day, count(*) as jobs from jobs group by 1", "jobs")
def jobs_by_day(spark, sf_dir):
    return R.by_day(view(spark, sf_dir, "jobs"))


@query("select coalesce(round(avg(epoch(updated_at) - epoch(created_at)), 2), 0) as seconds from jobs", "jobs")
def avg_processing_seconds(spark, sf_dir):
    return view(spark, sf_dir, "jobs").agg(F.coalesce(F.round(F.avg(_seconds()), 2), F.lit(0.0)).alias("seconds"))


@query(f"select count(*) as done from jobs where status = 'done' and created_at >= (select max(created_at) from jobs) - interval {DAYS} day", "jobs")
def processed_since(spark, sf_dir):
    return J.in_range(_as_of(view(spark, sf_dir, "jobs")), F.col("as_of"), DAYS).agg(F.count_if(F.col("status") == "done").alias("done"))


@query("select status, count(*) as n, count(*) filter (where secs < 600) as under_10m, count(*) filter (where secs >= 600 and secs < 1800) as under_30m, count(*) filter (where secs >= 1800) as longer from (select status, epoch(updated_at) - epoch(created_at) as secs from jobs) group by 1", "jobs")
def jobs_by_status(spark, sf_dir):
    secs = _seconds()
    return view(spark, sf_dir, "jobs").groupBy("status").agg(F.count("*").alias("n"), F.count_if(secs < 600).alias("under_10m"), F.count_if((secs >= 600) & (secs < 1800)).alias("under_30m"), F.count_if(secs >= 1800).alias("longer"))


@query(f"select cast(j.created_at as date) as day, round(avg({FILL}), 4) as fill_rate from detections d join jobs j on d.job_id = j.id group by 1", "detections", "jobs")
def fill_rate_by_day(spark, sf_dir):
    return R.fill_by_day(view(spark, sf_dir, "detections"), view(spark, sf_dir, "jobs"), FIELDS)


@query(f"select job_id, round(avg({FILL}), 4) as fill_rate, count(*) as n from detections group by 1", "detections")
def recognition_rate(spark, sf_dir):
    return view(spark, sf_dir, "detections").groupBy("job_id").agg(F.round(F.avg(R.row_fill(FIELDS)), 4).alias("fill_rate"), F.count("*").alias("n"))


@query(
    "select case when lower(trim(color)) not in ('', 'nan', 'none') then color when lower(trim(special_symbols)) not in ('', 'nan', 'none') then special_symbols else 'unknown' end as type, count(*) as n from detections group by 1 order by 2 desc, 1 limit 20",
    "detections",
)
def tag_type_distribution(spark, sf_dir):
    return R.tag_types(view(spark, sf_dir, "detections"))


@query(
    "select trim(name) as product_name, count(*) as n from detections d join catalog c on d.barcode = c.barcode where lower(trim(name)) not in ('', 'nan') group by 1 order by 2 desc, 1 limit 10",
    "detections", "catalog",
)
def top_products(spark, sf_dir):
    met = exact_match(view(spark, sf_dir, "detections"), view(spark, sf_dir, "catalog"), "part_id")
    return R.top_products(met.where("catalog_name is not null"), "catalog_name")


@query("select pos, job_id from detections where lower(trim(product_name)) in ('', 'nan') or lower(trim(barcode)) in ('', 'nan') or (price_default is null and price_card is null)", "detections")
def problem_rows(spark, sf_dir):
    return view(spark, sf_dir, "detections").where(R.problem(["product_name", "barcode"], ["price_default", "price_card"])).select("pos", "job_id")


@query("select pos, product_name, barcode from detections where regexp_matches(product_name, '(?i)a.*e') and regexp_matches(barcode, '(?i)^46.*1') and (regexp_matches(coalesce(cast(price_default as varchar), ''), '9') or regexp_matches(coalesce(cast(price_card as varchar), ''), '9'))", "detections")
def search_filter(spark, sf_dir):
    return R.search(view(spark, sf_dir, "detections"), name="A.*E", barcode="^46.*1", price="9").select("pos", "product_name", "barcode")


_KEY = "case when lower(trim(id_sku)) not in ('', 'nan', 'нет', 'no', 'n/a') then 'id_sku:' || trim(id_sku) when lower(trim(barcode)) not in ('', 'nan', 'нет', 'no', 'n/a') then 'barcode:' || trim(barcode) end"
_RUNS = (
    f"with l as (select * from (select *, {_KEY} as compare_key from run_left) where compare_key is not null qualify row_number() over (partition by compare_key order by pos) = 1), "
    f"r as (select * from (select *, {_KEY} as compare_key from run_right) where compare_key is not null qualify row_number() over (partition by compare_key order by pos) = 1) "
)


def _runs(spark, sf_dir):
    return R.keyed_once(view(spark, sf_dir, "run_left")), R.keyed_once(view(spark, sf_dir, "run_right"))


@query(_RUNS + "select compare_key, l.product_name as product_name_left, l.price_default as price_default_left, r.product_name as product_name_right, r.price_default as price_default_right from l join r using (compare_key)", "run_left", "run_right")
def run_common(spark, sf_dir):
    return R.common(*_runs(spark, sf_dir), ("product_name", "price_default"))


@query(_RUNS + "select compare_key, l.price_default as price_default_left, r.price_default as price_default_right from l join r using (compare_key) where l.price_default is distinct from r.price_default", "run_left", "run_right")
def run_price_diff(spark, sf_dir):
    return R.common(*_runs(spark, sf_dir), ("price_default",)).where("not (price_default_left <=> price_default_right)")


@query(_RUNS + "select compare_key, pos, barcode from l where compare_key not in (select compare_key from r)", "run_left", "run_right")
def run_left_only(spark, sf_dir):
    left, right = _runs(spark, sf_dir)
    return left.join(right, "compare_key", "left_anti").select("compare_key", "pos", "barcode")


@query(_RUNS + "select compare_key, pos, barcode from r where compare_key not in (select compare_key from l)", "run_left", "run_right")
def run_right_only(spark, sf_dir):
    left, right = _runs(spark, sf_dir)
    return right.join(left, "compare_key", "left_anti").select("compare_key", "pos", "barcode")


@query(
    _RUNS + "select (select count(*) from l) as left_rows, (select count(*) from r) as right_rows, count(*) filter (where a and b) as common_rows, count(*) filter (where a and not b) as left_only, count(*) filter (where b and not a) as right_only, count(*) filter (where a and b and x is distinct from y) as price_diffs "
    "from (select l.compare_key is not null as a, r.compare_key is not null as b, l.price_default as x, r.price_default as y from l full join r on l.compare_key = r.compare_key)",
    "run_left", "run_right",
)
def run_summary(spark, sf_dir):
    return R.run_summary(*_runs(spark, sf_dir))


@query(
    "select video, count(*) as n, count(distinct case when barcode <> '' then barcode end) as barcodes, cast(sum(x_max - x_min) as bigint) as sum_w, min(x_max - x_min) as min_w, min(y_max - y_min) as min_h, min(frame_timestamp) as first_ts, max(frame_timestamp) as last_ts, "
    "count(*) filter (where product_name = 'нет') as absent_product_name, count(*) filter (where special_symbols = 'нет') as absent_special_symbols from gt group by 1",
    "gt",
)
def gt_profile(spark, sf_dir):
    return R.profile(view(spark, sf_dir, "gt"), ["product_name", "special_symbols"])


@query("select video, frame_timestamp, n from (select video, frame_timestamp, count(*) as n from gt group by 1, 2) qualify row_number() over (partition by video order by n desc, frame_timestamp) = 1", "gt")
def busiest_timestamp(spark, sf_dir):
    return R.busiest(view(spark, sf_dir, "gt"))


@query(
    "select field, round(100.0 * count(*) filter (where value = 'нет') / count(*), 2) as pct from (select unnest(['product_name', 'special_symbols', 'id_sku']) as field, unnest([product_name, special_symbols, id_sku]) as value from gt) group by 1",
    "gt",
)
def missing_pct(spark, sf_dir):
    long = view(spark, sf_dir, "gt").select("product_name", "special_symbols", "id_sku").unpivot([], ["product_name", "special_symbols", "id_sku"], "field", "value")
    return long.groupBy("field").agg(F.round(100.0 * F.count_if(F.col("value") == "нет") / F.count("*"), 2).alias("pct"))


@query(
    "select j.id, j.status, count(d.pos) as tags, max(d.price_card) as most from jobs j left join detections d on j.id = d.job_id group by 1, 2",
    "jobs", "detections",
)
def job_detections(spark, sf_dir):
    d = view(spark, sf_dir, "detections").groupBy("job_id").agg(F.count("*").alias("tags"), F.max("price_card").alias("most"))
    return view(spark, sf_dir, "jobs").join(d, F.col("id") == F.col("job_id"), "left").select("id", "status", F.coalesce("tags", F.lit(0)).cast("long").alias("tags"), "most")


@query("select id, case when id % 3 = 0 then 'processing' else status end as status, case when id % 3 = 0 then id % 100 else 7 end as progress from jobs", "jobs")
def job_runtime_merge(spark, sf_dir):
    jobs = view(spark, sf_dir, "jobs").select("id", "status", F.lit(7).cast("long").alias("progress"))
    runtime = jobs.where("id % 3 = 0").select("id", F.lit("processing").alias("status"), F.expr("id % 100").alias("progress"))
    return J.merge_runtime(jobs, runtime, ("status", "progress"))
