"""Fusing a track: every frame is parsed by itself, and the fields of a track are elected from its frames.

Votes of all fields are counted in one aggregate over (track, field, value) and picked in a second, so that
no track's frames meet in one task and no field costs a shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import text as T
from tagloom.functions.predicates import ABSENT, is_empty_or_no
from tagloom.functions.prices import with_prices


def parsed_frames(frames: DataFrame, tokens: str | None = None) -> DataFrame:
    """``frames`` (ocr_text, barcode_raw, qr_raw) with the typed fields of each frame by itself; prices and special symbols from its array of tokens, if named."""
    text, qr = F.col("ocr_text"), T.parse_qr_field(F.col("qr_raw"), "qr_code_barcode")
    read = T.parse_barcode(text, F.col("barcode_raw"))
    of_qr = T.once(F.trim(qr), lambda code: F.when(code.rlike(r"^\d{12,13}$"), code).otherwise(""))
    out = with_prices(frames, tokens).withColumn("special_symbols", T.special_symbol(F.coalesce(F.col(tokens), F.array().cast("array<struct<text:string,height:double>>")))) if tokens else frames
    return out.withColumns({
        "discount_amount": T.parse_discount(text), "id_sku": T.parse_id_sku(text), "print_datetime": T.parse_print_datetime(text), "code": T.parse_code(text),
        "additional_info": T.parse_additional_info(text), "barcode": T.once(read, lambda code: F.when(code != "", code).otherwise(of_qr)),
    })


def _standing(field: Column, value: Column, votes: Column) -> tuple[Column, ...]:
    """What comes before, with, and after the number of votes when values of a field are compared."""
    digits = F.length(value)
    sku, code = (field == "id_sku") & value.rlike(r"^\d{9,}$"), field == "barcode"
    first = F.when(sku, 1 + (digits == 12).cast("int")).when(field == "print_datetime", value.rlike(r"\d{1,2}\.\d{1,2}\.\d{2,4}").cast("int")).when(code, T.ean_ok(value).cast("int")).otherwise(0)
    return first, F.when(sku, digits).otherwise(0), F.when(sku, 0).otherwise(votes), F.when(code, digits).otherwise(0)


def fuse(frames: DataFrame, keys: list[str], fields: list[str], pos: str = "pos") -> DataFrame:
    """keys and the elected value of each field (blank without any), from per-frame fields as :func:`parsed_frames` makes them.

    Blank and absent values have no vote. Most votes win, then the value seen first; an article number is the one
    of 12 digits, else the longest; dates in full shape come before others; only valid shelf codes stand; a barcode
    with a right check digit comes before votes, and votes before length.
    """
    told = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")).alias("value")) for f in fields))
    rows = frames.select(*keys, F.col(pos).alias("__pos"), F.inline(told))
    value = F.when(F.col("field") == "id_sku", F.when(F.length(F.regexp_replace("value", r"\D", "")) >= 9, F.regexp_replace("value", r"\D", "")).otherwise(F.col("value"))).otherwise(F.col("value"))
    rows = rows.withColumn("value", value)
    may = (F.col("value") != "") & (F.lower("value") != ABSENT) & ((F.col("field") != "code") | T.valid_layout_code(F.col("value")))
    counted = rows.groupBy(*keys, "field", "value").agg(F.count("*").alias("votes"), F.min("__pos").alias("first")).where(may)
    order = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(_standing(F.col("field"), F.col("value"), F.col("votes")))], (-F.col("first")).alias("seen"))
    best = counted.groupBy(*keys, "field").agg(F.max_by("value", order).alias("value"))
    elected = best.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return frames.select(*keys).distinct().join(elected, keys, "left").fillna("", fields)


def reparse(tags: DataFrame, text: str) -> DataFrame:
    """``tags`` whose missing id_sku, code and print_datetime (and codes of no valid shape) are read anew from ``text``."""
    read = {"id_sku": T.parse_id_sku(F.col(text)), "code": T.parse_code(F.col(text)), "print_datetime": T.parse_print_datetime(F.col(text))}
    lacks = {f: is_empty_or_no(F.col(f)) for f in read}
    lacks["code"] = lacks["code"] | ~T.valid_layout_code(F.col("code"))
    anew = lambda f, c: T.once(c, lambda x: F.when(is_empty_or_no(x), F.col(f)).otherwise(x))
    return tags.withColumns({f: F.when(lacks[f], anew(f, c)).otherwise(F.col(f)) for f, c in read.items()})
