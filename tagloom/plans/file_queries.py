"""Files written into the shared folder and read back: CSV, catalogs in several encodings, tagged folders, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions.text import ean_check_digit, ean_ok, normalize_barcode
from tagloom.operators.joins import delete, saved, work_path
from tagloom.plans.registry import query
from tagloom.plans.text_queries import _EAN
from tagloom.sources import exports, readers
from tagloom.sources.adapters import view


def _then_deleted(spark, path, rows):
    """``rows`` as they are, and the files that they were read from deleted."""
    out = saved(rows)
    delete(spark, path)
    return out


def _in_cp1251(text):
    """The characters whose Latin-1 bytes are those of ``text`` in windows-1251, since Spark writes no such file itself."""
    high = bytes(b for b in range(128, 256) if b != 0x98)
    return str.maketrans(high.decode("cp1251"), high.decode("latin-1")) if text is None else F.translate(text, high.decode("cp1251"), high.decode("latin-1"))


_TEXT = lambda c: f"case when {c} = '' then null else {c} end"  # noqa: E731  # an empty field of a CSV is read as null


@query(
    f"select {_TEXT('product_name')} as product_name, cast(price_default as varchar) as price_default, cast(price_card as varchar) as price_card, {_TEXT('barcode')} as barcode, {_TEXT('color')} as color, frame_timestamp, x_min, y_min, x_max, y_max, cast(null as varchar) as filename, {_TEXT('id_sku')} as id_sku from detections",
    "detections",
)
def detections_csv(spark, sf_dir):
    """The detections as CSV in the contract's columns, and read with the declared schema."""
    path = work_path(spark, "detections-csv")
    readers.write_detections(view(spark, sf_dir, "detections"), path)
    rows = readers.read_detections(spark, path)
    return _then_deleted(spark, path, rows.select("product_name", "price_default", "price_card", "barcode", "color", "frame_timestamp", "x_min", "y_min", "x_max", "y_max", "filename", "id_sku"))


_NAMES = "case part_id % 3 when 0 then name || ' вино' when 1 then name || '; \"сыр\" №1' else name || ' café' || chr(152) end"


@query(
    f"select name, case when length(barcode) = 12 then barcode || cast({_EAN.format('barcode')} as varchar) else barcode end as barcode, ['utf-8', 'cp1251', 'latin-1'][part_id % 3 + 1] as encoding from (select part_id, {_NAMES} as name, case when part_id % 4 = 0 then substr(barcode, 1, 12) else barcode end as barcode from catalog)",
    "catalog",
)
def catalog_encodings(spark, sf_dir):
    """Catalog files in three encodings in one folder, under different headers; barcodes of 12 digits get their check digit."""
    path = work_path(spark, "catalogs")
    c = view(spark, sf_dir, "catalog").withColumns({"name": F.expr(_NAMES.replace("chr(152)", "char(152)")), "barcode": F.when(F.col("part_id") % 4 == 0, F.substring("barcode", 1, 12)).otherwise(F.col("barcode"))})
    for k, (encoding, names) in enumerate((("UTF-8", ("fullname", "code")), ("cp1251", ("Название", "Штрихкод")), ("ISO-8859-1", ("name", "ean")))):
        name = F.col("name")
        if encoding == "cp1251":
            encoding, name, names = "ISO-8859-1", _in_cp1251(name), tuple(n.translate(_in_cp1251(None)) for n in names)
        rows = c.where(F.col("part_id") % 3 == k).select(name.alias(names[0]), F.lit("").alias("unit"), F.col("barcode").alias(names[1]))
        rows.write.mode("append").csv(f"{path}/{k}", header=True, sep=";", encoding=encoding, escape='"')
    read = readers.read_catalog_any(spark, f"{path}/*", details=True, glob="*.csv")
    code = normalize_barcode(F.col("barcode"))
    full = F.when(F.length(code) == 12, F.concat(code, ean_check_digit(code).cast("string"))).otherwise(code)
    return _then_deleted(spark, path, read.select("name", full.alias("barcode"), "encoding").where(ean_ok(F.col("barcode"))))


@query("select name, barcode from catalog", "catalog")
def catalog_cp1251(spark, sf_dir):
    """A catalog in an 8-bit encoding with lines that have too many fields, which are left out."""
    path = work_path(spark, "catalog-cp1251")
    c = view(spark, sf_dir, "catalog")
    lines = c.select(F.explode(F.array(F.concat_ws(";", "name", "barcode"), F.when(F.col("part_id") % 5 == 0, F.concat_ws(";", "name", "barcode", F.lit("лишнее"), F.lit("поле"))))).alias("value")).where("value is not null")
    lines.select(_in_cp1251(F.col("value")).alias("fullname;code")).write.option("encoding", "ISO-8859-1").csv(f"{path}/rows", header=True, quote="", sep="\t")
    return _then_deleted(spark, path, readers.read_catalog(spark, f"{path}/rows", skip_bad=True).select("name", "barcode"))


@query("select cast(video % 4 as varchar) as part, count(*) as rows, count(distinct source) as files from (select video, 'tag_' || (video % 4) as source from gt) group by 1", "gt")
def tagged_files(spark, sf_dir):
    """Files of a folder that match a pattern, with the name of each row's file; those of another kind are left out."""
    path = work_path(spark, "tagged")
    gt = saved(view(spark, sf_dir, "gt").select("barcode", "video", "product_name"))
    for k in range(4):
        gt.where(F.col("video") % 4 == k).write.csv(f"{path}/{k}/tag_{k}", header=True, escape='"')
    gt.write.csv(f"{path}/0/other", header=True, escape='"')
    rows = readers.read_many(spark, f"{path}/*/tag_*", "*.csv", "barcode string, video int, product_name string", without="crc", in_parts=True)
    counted = rows.groupBy((F.col("video") % 4).cast("string").alias("part")).agg(F.count("*").alias("rows"), F.count_distinct("source_file").alias("files"))
    return _then_deleted(spark, path, counted)


@query("select 'gt:v' || (video % 6) as source, count(*) as rows, min(barcode) as least from gt where video % 6 <> 0 and barcode <> '' group by 1", "gt")
def gt_folders(spark, sf_dir):
    """Ground truth in a folder for each video; that of unlabelled videos takes no part."""
    path = work_path(spark, "gt-folders")
    rows = saved(view(spark, sf_dir, "gt").where("barcode <> ''").select("video", "barcode", "product_name"))
    for k in range(6):
        rows.where(F.col("video") % 6 == k).drop("video").write.csv(f"{path}/{f'v{k}' if k else 'Unlabeled'}", header=True, escape='"')
    read = readers.read_ground_truth(spark, path, "barcode string, product_name string")
    return _then_deleted(spark, path, read.groupBy("source").agg(F.count("*").alias("rows"), F.min("barcode").alias("least")))


@query(
    "with r as (select video % 8 as part, count(*) as rows, sum(price_card)::bigint as total from detections group by 1), n as (select unnest([1, 2, 3]) as run) "
    "select run, r.part::int as part, case when run = 1 or (run = 3 and r.part = 3) then 'rebuilt' else 'kept' end as state, r.rows + case when run = 3 and r.part = 3 then 1 else 0 end as rows, total + case when run = 3 and r.part = 3 then 7 else 0 end as total from r, n",
    "detections",
)
def refreshed_exports(spark, sf_dir):
    """Exports by part, made, asked for again, and asked for after one more row has come to part 3."""
    path = work_path(spark, "exports")
    d = view(spark, sf_dir, "detections").select((F.col("video") % 8).alias("part"), F.col("price_card").cast("long").alias("price_card"))
    d.repartition("part").write.partitionBy("part").parquet(f"{path}/rows")
    build = lambda rows: rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum("price_card").alias("total"))
    runs = []
    for run in (1, 2, 3):
        if run == 3:
            spark.createDataFrame([(3, 7)], "part int, price_card bigint").write.mode("append").partitionBy("part").parquet(f"{path}/rows")
        done = exports.refresh(spark, f"{path}/rows", f"{path}/export", "part", build)
        state = F.when(F.col("part").cast("string").isin(*done), "rebuilt").otherwise("kept") if done else F.lit("kept")
        runs.append(saved(spark.read.parquet(f"{path}/export").select(F.lit(run).alias("run"), F.col("part").cast("int").alias("part"), state.alias("state"), "rows", "total")))
    delete(spark, path)
    return runs[0].unionByName(runs[1]).unionByName(runs[2])
