"""Readers and writers of the tables that price-tag jobs exchange."""

from __future__ import annotations

import csv
import io
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The output contract's columns.
CONTRACT = (
    "filename product_name price_default price_card price_discount barcode discount_amount id_sku print_datetime code additional_info color special_symbols "
    "frame_timestamp x_min y_min x_max y_max qr_code_barcode price1_qr price2_qr price3_qr price4_qr wholesale_level_1_count wholesale_level_1_price "
    "wholesale_level_2_count wholesale_level_2_price action_price_qr action_code_qr"
).split()
NUMBERS = {"frame_timestamp": "bigint", "x_min": "int", "y_min": "int", "x_max": "int", "y_max": "int"}
DETECTIONS = ", ".join(f"{c} {NUMBERS.get(c, 'string')}" for c in CONTRACT)
# Headers that mean a catalog's name or barcode.
ALIASES = {**dict.fromkeys(("fullname", "full_name", "product_name", "название", "товар"), "name"), **dict.fromkeys(("code", "ean", "штрихкод", "barcode_sku"), "barcode")}


def read_detections(spark: SparkSession, path: str, schema: str = DETECTIONS) -> DataFrame:
    """CSV with a header; the schema is declared, so that a barcode is never read as a number."""
    return spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True, escape='"')


def read_catalog(spark: SparkSession, path: str, sep: str = ";", encoding: str = "windows-1251", skip_bad: bool = False) -> DataFrame:
    """A catalog of strings in an 8-bit encoding: name and barcode under whatever headers.

    Spark reads bytes as Latin-1 characters, and these are exchanged for those of the encoding.
    """
    raw = spark.read.csv(path, header=True, sep=sep, encoding="iso-8859-1", mode="DROPMALFORMED" if skip_bad else "PERMISSIVE")
    high = bytes(range(128, 256))
    byte_chars, chars = high.decode("iso-8859-1"), "".join(bytes([b]).decode(encoding, "replace") for b in high)
    names = [c.translate(str.maketrans(byte_chars, chars)) for c in raw.columns]
    return rename_headers(raw.select(*[F.translate(F.col(f"`{c}`"), byte_chars, chars).alias(n) for c, n in zip(raw.columns, names, strict=True)]))


def rename_headers(df: DataFrame) -> DataFrame:
    clean = [c.replace("﻿", "").strip().lower() for c in df.columns]
    return df.toDF(*[ALIASES.get(c, c) for c in clean])


# Fixed value: the encodings that a catalog file may be in, in the order in which they are tried.
ENCODINGS = ("utf-8", "cp1251", "latin-1")


def decoded(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str]:
    """The text of a file and the first encoding in which all its bytes have a meaning."""
    for encoding in encodings:
        try:
            return content.decode(encoding).removeprefix("\ufeff"), encoding
        except UnicodeDecodeError:
            continue
    raise ValueError(f"the file is in none of {encodings}")


def read_catalog_any(spark: SparkSession, path: str, sep: str = ";", limit: int | None = None, columns: tuple[str, ...] = ("name", "barcode"), details: bool = False, glob: str = "*") -> DataFrame:
    """The ``columns`` (strings, null where a file lacks one) of every file, each in its own encoding, in one scan; with ``details`` source_file, encoding and row before them.

    limit: the first so many rows of each file. A file is decoded and split by one task; headers may bear any of
    the names in ``ALIASES``.
    """
    head = ["source_file", "encoding", "row"]

    def each(batches):
        for files in batches:
            for name, content in zip(files.path, files.content, strict=True):
                text, encoding = decoded(content)
                rows = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
                names = [ALIASES.get(c, c) for c in (x.strip().lower() for x in next(rows, []))]
                at = [names.index(c) if c in names else -1 for c in columns]
                kept = itertools.islice((r for r in rows if r), limit)
                told = ((name.rsplit("/", 1)[-1], encoding, k, *(r[i] if 0 <= i < len(r) else None for i in at)) for k, r in enumerate(kept))
                while part := list(itertools.islice(told, 50_000)):
                    yield pd.DataFrame(part, columns=[*head, *columns])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    rows = files.mapInPandas(each, f"source_file string, encoding string, row bigint, {', '.join(f'{c} string' for c in columns)}")
    return rows if details else rows.select(*columns)


def read_many(spark: SparkSession, folder: str, glob: str, schema: str = DETECTIONS, without: str | None = None, in_parts: bool = False) -> DataFrame:
    """All files of a folder that match, with ``source_file``, the name of each row's file: of files that Spark has written ``in_parts``, that of the folder of the parts."""
    df = spark.read.schema(schema).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).csv(folder, header=True)
    df = df.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2 if in_parts else -1))
    return df.where(~F.col("source_file").contains(without)) if without else df


def read_ground_truth(spark: SparkSession, root: str, schema: str = DETECTIONS) -> DataFrame:
    """``<video>/<video>.csv`` below ``root``, with source ``gt:<video>``; the folder of unlabelled videos is left out."""
    df = spark.read.schema(schema).csv(f"{root}/*/*.csv", header=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+\.csv$", 1)
    return df.withColumn("source", F.concat(F.lit("gt:"), folder)).where(folder != "Unlabeled")


def ean_of_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(?<!\d)(\d{12,13})(?!\d)[^/]*$", 1), F.lit(""))


def jsonld_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each product in a page's JSON-LD blocks: page_id, name, barcode, price, brand."""
    block = r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'
    shape = "`@type` string, name string, gtin13 string, sku string, brand struct<name:string>, offers struct<price:string>"
    text = F.explode(F.regexp_extract_all(F.col(html), F.lit(block)))
    items = pages.select("page_id", text.alias("json")).select("page_id", F.explode(F.coalesce(F.from_json("json", f"array<struct<{shape.replace(' string', ':string').replace(' struct', ':struct')}>>"), F.array())).alias("p"))
    return items.where("p.`@type` = 'Product'").select("page_id", "p.name", F.coalesce("p.gtin13", "p.sku").alias("barcode"), F.col("p.offers.price").alias("price"), F.col("p.brand.name").alias("brand"))


def best_path(paths: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """Of each name's paths the one in the best folder, then the greatest."""
    score = F.when(F.col(path).rlike("(?i)/(original|source|videos?)/"), 2).when(F.col(path).rlike("(?i)/(tmp|cache|preview)/"), 0).otherwise(1)
    return paths.groupBy(name).agg(F.max_by(path, F.struct(score.alias("s"), F.col(path).alias("p"))).alias(path))


def write_detections(df: DataFrame, path: str, keep_alternatives: bool = False) -> None:
    """CSV in the contract's column order, in a folder that must be new: an input is never overwritten."""
    extra = ["alts_json"] if keep_alternatives and "alts_json" in df.columns else []
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in CONTRACT], *extra).write.csv(path, header=True, escape='"')


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row, NaN as null, nulls written out."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("value"))


def yolo_labels(boxes: DataFrame, width: str = "width", height: str = "height", carry: tuple[str, ...] = ()) -> DataFrame:
    """``class cx cy w h`` in shares of the frame, six decimals; the columns to ``carry`` stay beside it."""
    share = lambda e, size: F.format_string("%.6f", F.expr(e).cast("double") / F.col(size))
    return boxes.select(*carry, F.concat_ws(" ", F.col("cls").cast("string"), share("(x_min + x_max) / 2", width), share("(y_min + y_max) / 2", height), share("x_max - x_min", width), share("y_max - y_min", height)).alias("value"))
