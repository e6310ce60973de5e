"""Steps whose work must grow no faster than their tables."""

from __future__ import annotations

import contextlib
import io
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.functions.prices import with_prices
from tagloom.operators import catalog as C
from tagloom.operators import evaluate as E
from tagloom.operators import fuzzy, joins, tracks
from tagloom.operators.reporting import longest_words
from tagloom.operators.tracks import Follower
from tagloom.plans import file_queries
from tagloom.plans.catalog_queries import prefix_complete
from tagloom.sources import readers
from tagloom.sources.adapters import view

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_track_codes_meet_the_catalog_by_key(spark):
    """A filter over columns of events and of the catalog does not multiply both."""
    for limit in ("-1", "10MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            told = plan(view(spark, SF, "track_codes").where("barcode <> ''"))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "CartesianProduct" not in told and "NestedLoop" not in told


def test_prefix_complete_reads_part_ids_of_long_positions(spark, tmp_path):
    """Positions are beyond what a double holds: that of supplier 0 was cut to the part before."""
    line = "900000 + id as l_orderkey, id as l_partkey, 0L as l_suppkey, cast(id % 7 + 1 as int) as l_linenumber, 5D as l_quantity, 0.05D as l_discount, 'R' as l_returnflag"
    spark.range(300).selectExpr(*line.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(300).selectExpr("id as p_partkey", "'wine' as p_name", "'Brand#11' as p_brand", "9.5D as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spread = lambda i: "46" + str(i * 1056716611 % 10**10).zfill(10)
    got = {(r.pos // 100000 % 1000000, r.barcode[:12]) for r in prefix_complete(spark, str(tmp_path)).collect()}
    assert {i for i, b in got if b == spread(i)} == set(range(300))


def test_codes_one_digit_off_are_not_sent_through_the_driver(spark, tmp_path):
    codes = spark.createDataFrame([(1, "4600000000017"), (1, "4600000000031"), (2, "460000000001")], "pos bigint, code string")
    body = lambda i: f"46000000000{i}"
    known = spark.range(10).selectExpr("concat('46000000000', id) as body").collect()
    check = lambda b: str((10 - sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(b)) % 10) % 10)
    catalog = spark.createDataFrame([(r.body + check(r.body),) for r in known], "barcode string")
    catalog.write.parquet(f"{tmp_path}/catalog")
    codes.write.parquet(f"{tmp_path}/codes")
    codes, catalog = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("codes", "catalog"))
    found = C.recover_one_digit(codes, catalog, ["pos"], "code")
    told = plan(found)
    assert "BroadcastExchange" not in told
    rows = [(r.pos, r.barcode[:12]) for r in found.collect()]
    assert sorted(rows) == sorted([(1, body(i)) for i in range(10)] + [(2, body(i)) for i in range(10) if i != 1])


def test_many_boxes_a_frame():
    """A frame's boxes are compared with live tracks together: 20,000 boxes took ten seconds one by one."""
    rng = np.random.default_rng(7)
    frame = np.sort(rng.integers(0, 20, 20_000))
    corner = rng.integers(0, 3000, (20_000, 2))
    boxes = np.concatenate([corner, corner + rng.integers(40, 200, (20_000, 2))], 1).astype(float)
    begun = time.process_time()
    ids = Follower().run(frame, boxes)
    assert len(ids) == 20_000 and time.process_time() - begun < 5


def copies(spark, times: int):
    """Boxes at 20 places, each ``times`` times under another pos."""
    return spark.range(20 * times).selectExpr(
        "cast(id % 2 as int) as video", "id as pos", "(id % 20) * 97 as frame_timestamp", "cast(id % 20 * 40 as int) as x_min", "cast(id % 20 * 15 as int) as y_min",
        "cast(id % 20 * 40 + 90 as int) as x_max", "cast(id % 20 * 15 + 60 as int) as y_max", "cast(id * 7 % 10 as int) as confidence", "'' as barcode",
    )


def test_copies_of_boxes_meet_once(spark):
    """Copies are not multiplied with copies where one of them tells the answer."""
    d = copies(spark, 60).localCheckpoint()
    g = d.where("pos % 3 = 0").localCheckpoint()
    assert E.like_boxes(d, g, 3000, 0.2).count() == E.like_boxes(copies(spark, 1), g, 3000, 0.2).count()
    assert tracks.suppress(d, 3000).count() == tracks.suppress(copies(spark, 10), 3000).count()
    best = {r.pos: (r.r_pos, r.iou) for r in joins.best_overlap(g, d, ["video"], 0.25).collect()}
    assert best == {p: (p % 20, 1.0) for p in range(0, 1200, 3)}


def test_nearest_point_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [(int(p), int(v), int(t), int(x), int(y)) for p, v, t, x, y in zip(rng.integers(0, n, n), rng.integers(0, 2, n), rng.integers(0, 9000, n) // 9 * 9, rng.integers(0, 3000, n), rng.integers(0, 40, n), strict=True)]
    a, b = make(150), make(25)
    schema = "pos bigint, video int, t bigint, x int, y int"
    got = {r.pos: (r.distance, r.r_pos) for r in joins.nearest_point(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["video"], "t", 3000, ["x", "y"]).collect()}
    want: dict = {}
    for p, v, t, x, y in a:
        for q, w, u, z, s in b:
            if v == w and abs(t - u) <= 3000:
                want[p] = min(want.get(p, (10**9, 0)), (abs(t - u) + abs(x - z) + abs(y - s), q))
    assert got == want


def test_unread_codes_meet_the_catalog_by_narrow_keys(spark, tmp_path):
    """The exploded index is not broadcast, and of many codes that agree in the last places only beginnings are met."""
    rng = np.random.default_rng(3)
    check = lambda b: str((10 - sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(b)) % 10) % 10)
    bodies = sorted({"46" + "".join(map(str, rng.integers(0, 3, 10))) for _ in range(400)})
    known = [b + check(b) for b in bodies]
    blank = lambda c, n: "".join("?" if i in set(rng.choice(13, n, replace=False)) else d for i, d in enumerate(c))
    reads = [blank(known[int(rng.integers(len(known)))], int(rng.integers(0, 9))) for _ in range(600)]
    spark.createDataFrame([(c,) for c in known], "barcode string").write.parquet(f"{tmp_path}/catalog")
    spark.createDataFrame(list(enumerate(reads)), "pos int, code string").write.parquet(f"{tmp_path}/codes")
    found = C.complete_unread(spark.read.parquet(f"{tmp_path}/codes"), spark.read.parquet(f"{tmp_path}/catalog"), ["pos"], "code")
    assert "head" not in "".join(x for x in plan(found).splitlines() if "BroadcastExchange" in x) and "explode" not in plan(found)
    agree = lambda r: [c for c in known if all(x in ("?", y) for x, y in zip(r, c, strict=True))]
    want = {(i, r, agree(r)[0]) for i, r in enumerate(reads) if 13 - r.count("?") >= 6 and len(agree(r)) == 1}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100


def test_tokens_are_read_once(spark):
    """A tag's tokens were cleaned some ten times each; odd heights and absent tokens have the prices that they had."""
    rows = [
        (1, [("2499", 10.0), ("99", 9.0), ("1.00", 5.0)]), (2, [("1.00 2.00", float("nan")), ("199", -1.0), ("1O", 12.0), ("2499", float("nan"))]),
        (3, None), (4, [None, (None, 1.0), ("l2,5O", None)]), (5, [("99", 1.0), ("199", 5.0), ("45", 5.5), ("299", 5.0)]), (6, []),
    ]
    df = spark.createDataFrame(rows, "pos int, tokens array<struct<text:string,height:double>>")
    told = with_prices(df, "tokens")
    assert plan(told).count("translate(") == 0 and "ArrowEvalPython" in plan(told)
    got = {r.pos: (r.price_default, r.price_card) for r in told.collect()}
    assert got == {1: (249999, 100), 2: (249900, 19910), 3: (None, None), 4: (None, 1250), 5: (29945, 19999), 6: (None, None)}


def test_texts_are_read_once(spark):
    """What a parser finds stands in its result several times, and was looked for as often."""
    said = spark.createDataFrame([("12_012345 - 067890 12.05.25 9:07 270 102 162817",)], "x string")
    x = F.col("x")
    for told, most in ((T.parse_code(x), 1), (T.parse_print_datetime(x), 1), (T.parse_id_sku(x), 1), (T.number_in_token(x), 1)):
        lines = [line for line in plan(said.select(told.alias("v"))).splitlines() if "Project" in line]
        assert max(line.count("translate(") for line in lines) <= most
    assert said.select(T.parse_code(x), T.parse_print_datetime(x), T.parse_id_sku(x)).first()[:] == ("12_012345 - 067890", "12.05.2025 09:07", "270102162817")
    qr = lambda text: said.select(T.parse_qr_field(F.lit(text), "qr_code_barcode"), T.parse_qr(F.lit(text))["qr_code_barcode"]).first()[:]
    assert [qr(t) for t in (None, "", " {\"barcode\": 5}", "[1]", "b= ;p1=3", "b=1&b=2", "x{b=4")] == [("", ""), ("", ""), ("5", "5"), ("", ""), ("нет", "нет"), ("2", "2"), ("", "")]


def test_longest_words_need_no_shuffle(spark):
    """Words were exploded, grouped and ranked over shuffles, though each text is read by itself."""
    rows = [(1, "wine Wine WINE Riesling 12345 цена bordeaux Вино riesling 123a vino"), (2, None), (3, "abc"), (4, "aaaa bbbb cccc dddd eeee ffff ggggg"), (None, "Margaux")]
    told = longest_words(spark.createDataFrame(rows, "k int, text string"), "k", "text")
    assert "Exchange" not in plan(told)
    assert {r.k: r.words for r in told.collect()} == {1: "Riesling bordeaux Вино 123a", 2: "", 3: "", 4: "ggggg aaaa bbbb cccc dddd", None: "Margaux"}


def test_files_in_parts_are_one_file(spark, tmp_path):
    """A file was made of one part by one task that did all joins before it."""
    for k in range(2):
        spark.range(40).selectExpr("id as n").repartition(3).write.csv(f"{tmp_path}/{k}/tag_{k}", header=True)
    read = readers.read_many(spark, f"{tmp_path}/*/tag_*", "*.csv", "n bigint", without="crc", in_parts=True)
    assert sorted((r.source_file, r["count"]) for r in read.groupBy("source_file").count().collect()) == [("tag_0", 40), ("tag_1", 40)]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_ground_truth_is_made_once_for_all_folders(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(file_queries, "saved", lambda df: kept.append(df.columns) or joins.saved(df))
    for ask in (file_queries.gt_folders, file_queries.tagged_files):
        kept.clear()
        assert ask(spark, SF).count() > 0 and "product_name" in kept[0]


def test_fields_go_with_their_barcodes(spark):
    """Both tables are read once; the hits are those of the rows looked up again by their positions."""
    fields = {"name": "name", "price": "price", "code": "code", "color": "text", "ean": "ean", "level": "count"}
    make = lambda n, s: [(s * i % 97, i % 3, f"46012345678{i % 23:02d}" if i % 5 else "", ["Вино", " нет", None, "N/A", "вино  сухое"][i * s % 5], i * s % 400 or None, ["1", "", "нет", "x 2.0"][i % 4], ["Red ", "red", None][i * s % 3], ["4.6E12", "4600000000000", None][i * s % 3], ["3", "3.0", "x", ""][i * s % 4]) for i in range(90)]
    schema = "pos int, video int, barcode string, name string, price bigint, code string, color string, ean string, level string"
    gt, pred = spark.createDataFrame(make(90, 2), schema), spark.createDataFrame(make(90, 5), schema)
    told = E.barcode_hits(gt, pred, fields)
    assert plan(told).count("Scan ExistingRDD") == 2
    asked = E.field_hits(E.match_by_barcode(gt, pred), gt, pred, fields)
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, asked.collect())) and told.count() > 10


def test_sets_of_words_meet_once(spark, monkeypatch):
    """Every row was met by every row before words in common were counted; a pos that came twice was told too many."""
    kept = []
    monkeypatch.setattr(fuzzy, "saved", lambda df: kept.append(joins.saved(df)) or kept[-1])
    monkeypatch.setattr(fuzzy, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(fuzzy, "HELD_PER_TASK", 7)
    names = ["red gear brand", "red gear", "old ring brand", "red", "gear red старое brand", None]
    rows = lambda times, c: spark.createDataFrame([(k, names[k % 6]) for k in range(6 * times)], f"{c} string")
    words = lambda n: {w for w in (n or "").split() if len(w) > 2}
    for times in (2, 20):
        got = fuzzy.candidates(rows(times, "pos int, text").unionByName(spark.createDataFrame([(0, names[0]), (3, "gear")], "pos int, text string")), rows(times, "part_id int, name"), "text", least_shared=2)
        own = {k: words(names[k % 6]) | ({"gear"} if k == 3 else set()) for k in range(6 * times)}
        want = sorted((i, j, n) for i, w in own.items() for j in range(6 * times) if (n := len(w & words(names[j % 6]))) >= 2)
        assert sorted(map(tuple, got.collect())) == want
    assert kept[0].count() == kept[1].count() == 10
