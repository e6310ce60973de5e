"""Readers and writers by round trips through files."""

from pyspark.sql import functions as F

from tagloom.operators import catalog, providers
from tagloom.sources import readers


def test_detections_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("4601234567893", 'a "b", c', 5)], "barcode string, product_name string, frame_timestamp bigint")
    readers.write_detections(df, f"{tmp_path}/d")
    back = readers.read_detections(spark, f"{tmp_path}/d")
    r = back.first()
    assert back.columns == readers.CONTRACT and (r.barcode, r.product_name, r.frame_timestamp, r.color) == ("4601234567893", 'a "b", c', 5, None)


def test_catalog_encodings(spark, tmp_path):
    text = "fullname;code\nВино сухое;4601234567893\n"
    (tmp_path / "a.csv").write_bytes(text.encode("windows-1251"))
    (tmp_path / "b.csv").write_bytes(("﻿" + text).encode())
    for name in ("a", "b"):
        df = readers.read_catalog_any(spark, f"{tmp_path}/{name}.csv")
        assert df.columns == ["name", "barcode"] and df.first().name == "Вино сухое"


def test_many_files(spark, tmp_path):
    for name in ("final_eval_a.csv", "final_eval_b_fused.csv"):
        (tmp_path / name).write_text("barcode\n1\n")
    got = readers.read_many(spark, str(tmp_path), "final_eval_*.csv", "barcode string", without="_fused").collect()
    assert [(r.barcode, r.source_file) for r in got] == [("1", "final_eval_a.csv")]
    for v in ("v1", "Unlabeled"):
        (tmp_path / "gt" / v).mkdir(parents=True)
        (tmp_path / "gt" / v / f"{v}.csv").write_text("barcode\n1\n")
    assert [r.source for r in readers.read_ground_truth(spark, f"{tmp_path}/gt", "barcode string").collect()] == ["gt:v1"]


def test_jsonld(spark):
    html = '<script type="application/ld+json">{"@type":"Product","name":"Wine","gtin13":"46","offers":{"price":"9.99"},"brand":{"name":"B"}}</script><script>x</script>'
    r = readers.jsonld_products(spark.createDataFrame([(1, html), (2, "<p>")], "page_id bigint, html string")).collect()
    assert [(x.page_id, x.name, x.barcode, x.price, x.brand) for x in r] == [(1, "Wine", "46", "9.99", "B")]


def test_small_writers(spark):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    assert readers.as_json(df).first().value == '{"a":1,"b":null,"c":null}'
    box = spark.createDataFrame([(0, 10, 20, 30, 60, 100, 200)], "cls int, x_min int, y_min int, x_max int, y_max int, width int, height int")
    assert readers.yolo_labels(box).first().value == "0 0.200000 0.200000 0.200000 0.200000"
    paths = spark.createDataFrame([("v", "/a/tmp/v"), ("v", "/a/video/v"), ("v", "/b/v")], "name string, path string")
    assert readers.best_path(paths).first().path == "/a/video/v"
    assert spark.range(1).select(readers.ean_of_path(F.lit("/x/4601234567893_1.png")).alias("e")).first().e == "4601234567893"


def test_catalog_rules(spark):
    base = spark.createDataFrame([("4601234567893", "n")], "barcode string, name string")
    assert catalog.hybrid(base, None).first().source == "db_hack"
    near = catalog.recover_one_digit(spark.createDataFrame([(1, "4601234567793")], "pos int, code string"), base, ["pos"], "code").collect()
    assert [r.barcode for r in near] == ["4601234567893"]


def test_providers(spark):
    frames = spark.createDataFrame([("v", i, i * 100, 1.0, 0.4) for i in range(10)], "video string, frame_idx bigint, frame_ts_ms bigint, sharpness double, difference double")
    assert [r.frame_idx for r in providers.kept_frames(frames, 200, 0.5, 1.0).collect()] == [0, 3, 6, 9]

    def fake(parts):
        for p in parts:
            yield p.assign(answer="x")[["pos", "answer"]]

    assert providers.run(spark.createDataFrame([(1,)], "pos bigint"), fake, "name").first().answer == "x"
