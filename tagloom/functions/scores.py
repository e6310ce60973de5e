"""Scores and conditional updates of a tag's row. Money is in integer cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.predicates import ABSENT, is_empty_or_no
from tagloom.functions.text import ean_ok


def _points(points: int, condition: Column) -> Column:
    return F.when(condition, points).otherwise(0)


def _code_points(barcode: Column) -> Column:
    digits = F.length(F.regexp_replace(F.coalesce(barcode, F.lit("")), r"\D", ""))
    return F.when(ean_ok(barcode), 50).when(digits >= 12, 18).otherwise(0)


def tag_confidence(barcode: Column, has_price: Column, qr: Column, sku: Column, printed: Column, good_name: Column) -> Column:
    """50 for a valid barcode (18 for 12 digits), 30 price, 22 QR, 8 article, 5 date, 12 name."""
    return _code_points(barcode) + _points(30, has_price) + _points(22, ~is_empty_or_no(qr)) + _points(8, ~is_empty_or_no(sku)) + _points(5, ~is_empty_or_no(printed)) + _points(12, good_name)


def final_confidence(barcode: Column, has_price: Column, qr: Column, sku: Column, good_name: Column, absent_counts: bool = True) -> Column:
    """The score after post-processing: no points for a date; an article known to be absent counts if asked."""
    has_sku = F.trim(F.coalesce(sku, F.lit(""))) != "" if absent_counts else ~is_empty_or_no(sku)
    return _code_points(barcode) + _points(30, has_price) + _points(22, ~is_empty_or_no(qr)) + _points(8, has_sku) + _points(12, good_name)


def has_signal(price: Column, barcode: Column, qr: Column) -> Column:
    """A positive price, or 12 digits of a barcode on the tag or in its QR code."""
    digits = lambda x: F.length(F.regexp_replace(F.coalesce(x, F.lit("")), r"\D", ""))
    return F.coalesce(price > 0, F.lit(False)) | (digits(barcode) >= 12) | (digits(qr) >= 12)


def infer_discount(old: Column, default: Column, card: Column) -> Column:
    """``-N%`` from both prices where the field is empty, the card price is below 98 of 100, and N is 5 to 90."""
    percent = ((default - card) * 100 / default).cast("int")
    return F.when(is_empty_or_no(old) & (card * 100 < default * 98) & percent.between(5, 90), F.concat(F.lit("-"), percent.cast("string"), F.lit("%"))).otherwise(F.coalesce(old, F.lit("")))


def forced_discount(old: Column, default: Column, card: Column, barcode: Column) -> Column:
    """The same, over any old value, where the tag has a barcode of 12 digits or more."""
    return F.when(F.length(F.coalesce(barcode, F.lit(""))) >= 12, F.coalesce(F.nullif(infer_discount(F.lit(""), default, card), F.lit("")), old)).otherwise(old)


def second_price(first: Column) -> Column:
    """Five per cent off, rounded half to even to a rouble, less a kopeck."""
    return (F.bround(first.cast("decimal(20,4)") * F.lit(0.95).cast("decimal(3,2)") / 100, 0) * 100 - 1).cast("long")


def fill(old: Column, new: Column) -> Column:
    return F.when(is_empty_or_no(old), F.coalesce(new.cast("string"), old)).otherwise(old)


def price_override(current: Column, catalog: Column) -> Column:
    """The catalog's price where the tag has none, or differs by more than a fifth and in its roubles."""
    far = F.abs(current - catalog) * 5 > catalog
    return F.when(catalog.isNull(), current).when(current.isNull() | (current <= 0), catalog).when(far & (F.floor(current / 100) != F.floor(catalog / 100)), catalog).otherwise(current)


def compare_key(sku: Column, barcode: Column) -> Column:
    """What rows of two runs are matched by: the article if there, else the barcode, with its kind."""
    return F.when(~is_empty_or_no(sku), F.concat(F.lit("id_sku:"), F.trim(sku))).when(~is_empty_or_no(barcode), F.concat(F.lit("barcode:"), F.trim(barcode)))


def with_absent(x: Column) -> Column:
    """Blank becomes the word for absent."""
    return F.when(F.trim(F.coalesce(x, F.lit(""))) == "", ABSENT).otherwise(x)
