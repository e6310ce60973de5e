"""The last passes over tags: catalog values, back-fill, weak names, sanitising and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.predicates import is_empty_or_no
from tagloom.functions.scores import final_confidence, has_signal, infer_discount, price_override, second_price, tag_confidence
from tagloom.functions.text import ean_ok, weak_name
from tagloom.operators.catalog import clear_repeated, exact_match, gate
from tagloom.operators.joins import saved
from tagloom.operators.tracks import suppress


def confidence(tags: DataFrame) -> DataFrame:
    """``tags`` with ``confidence`` as scored before post-processing."""
    name_ok = ~weak_name(F.col("product_name"), ean_ok(F.col("barcode")))
    score = tag_confidence(F.col("barcode"), F.coalesce(F.col("price_default") > 0, F.lit(False)), F.col("qr_code_barcode"), F.col("id_sku"), F.col("print_datetime"), name_ok)
    return tags.withColumn("confidence", score)


def with_catalog(tags: DataFrame, catalog: DataFrame, overwrite_names: bool = False) -> DataFrame:
    """Name, prices and QR prices from the catalog row of the barcode; QR fields are filled only where empty."""
    met = exact_match(tags, catalog, "part_id")
    name = F.when(F.col("catalog_name").isNotNull() & (F.lit(overwrite_names) | is_empty_or_no(F.col("product_name"))), F.col("catalog_name")).otherwise(F.col("product_name"))
    price = price_override(F.col("price_default"), F.col("catalog_price"))
    card = price_override(F.col("price_card"), F.col("catalog_card_price"))
    return met.withColumns({"product_name": name, "price_default": price, "price_card": card, "price1_qr": F.col("catalog_price"), "price2_qr": second_price(F.col("catalog_price")), "price4_qr": F.col("catalog_card_price")}).drop("catalog_name", "catalog_price", "catalog_card_price")


def sanitize(tags: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Barcodes that the catalog does not know, or whose check digit or length is wrong, are blanked, and so are weak names."""
    if catalog is not None:
        tags = gate(tags, catalog)
    code = F.col("barcode")
    good = (F.length(code) == 12) | ean_ok(code)
    tags = tags.withColumn("barcode", F.when(F.coalesce(good, F.lit(False)), code).otherwise(""))
    return tags.withColumn("product_name", F.when(weak_name(F.col("product_name"), ean_ok(F.col("barcode"))), "").otherwise(F.col("product_name")))


def stabilize(tags: DataFrame, least_confidence: int = 15, window_ms: int = 2000) -> DataFrame:
    """Tags with a signal and enough confidence, without those that a better one suppresses."""
    score = final_confidence(F.col("barcode"), F.coalesce(F.col("price_default") > 0, F.lit(False)), F.col("qr_code_barcode"), F.col("id_sku"), F.col("product_name") != "")
    kept = tags.where(has_signal(F.col("price_default"), F.col("barcode"), F.col("qr_code_barcode"))).withColumn("confidence", score).where(F.col("confidence") >= least_confidence)
    kept = saved(kept)  # read for the pairs, for the tags and at the end
    return kept.join(suppress(kept, window_ms), ["video", "pos"], "left_semi")


def postprocess(tags: DataFrame, catalog: DataFrame, least_confidence: int = 15, window_ms: int = 2000) -> DataFrame:
    """The whole ladder: catalog values, one row for each barcode of a video, discount, sanitising, suppression."""
    matched = clear_repeated(with_catalog(tags, catalog), ["video"])
    told = matched.withColumn("discount_amount", infer_discount(F.lit(""), F.col("price_default"), F.col("price_card")))
    return stabilize(sanitize(told, catalog), least_confidence, window_ms)
