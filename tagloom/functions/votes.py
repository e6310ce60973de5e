"""Ranked votes of several frames: counts first, then one pick, so that a track's rows never meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.predicates import is_empty_or_no
from tagloom.functions.text import ean_ok


def vote(df: DataFrame, keys: list[str], value: Column, pos: str = "pos", rank: tuple = (), weight: Column | None = None) -> DataFrame:
    """keys, value, votes: of each key's values that are not empty, the one of the highest ``rank``, most votes, then seen first.

    rank: functions of (value, votes), compared before the votes.
    """
    counted = df.withColumn("value", value).where(~is_empty_or_no(F.col("value"))).groupBy(*keys, "value").agg(F.count("*").alias("votes") if weight is None else F.sum(weight).alias("votes"), F.min(pos).alias("__first"))
    order = F.struct(*[f(F.col("value"), F.col("votes")).alias(f"r{i}") for i, f in enumerate(rank)], F.col("votes").alias("v"), (-F.col("__first")).alias("p"))
    return counted.groupBy(*keys).agg(F.max_by("value", order).alias("value"), F.max_by("votes", order).alias("votes"))


def best_barcode(df: DataFrame, keys: list[str], barcode: str, pos: str = "pos") -> DataFrame:
    """A right check digit beats votes, votes beat length."""
    order = F.struct(ean_ok(F.col("value")).cast("int").alias("a"), F.col("votes").alias("b"), F.length("value").alias("c"), (-F.col("__first")).alias("d"))
    return _pick(df, keys, barcode, pos, order, F.length(F.col(barcode)).between(12, 13))


def best_qr(df: DataFrame, keys: list[str], qr: str, pos: str = "pos") -> DataFrame:
    """A payload that has a barcode beats votes, votes beat length."""
    order = F.struct(F.col("value").rlike(r"(^|[;&\n{\"])(b|barcode)\"?[=:]").cast("int").alias("a"), F.col("votes").alias("b"), F.length("value").alias("c"), (-F.col("__first")).alias("d"))
    return _pick(df, keys, qr, pos, order, F.trim(F.col(qr)) != "")


def best_sku(df: DataFrame, keys: list[str], sku: str, pos: str = "pos") -> DataFrame:
    """12 digits first, then the longest, then the first seen."""
    order = F.struct((F.length("value") == 12).cast("int").alias("a"), F.length("value").alias("b"), (-F.col("__first")).alias("c"))
    return _pick(df, keys, sku, pos, order, ~is_empty_or_no(F.col(sku)))


def _pick(df: DataFrame, keys: list[str], column: str, pos: str, order: Column, use: Column) -> DataFrame:
    counted = df.where(use).groupBy(*keys, F.col(column).alias("value")).agg(F.count("*").alias("votes"), F.min(pos).alias("__first"))
    return counted.groupBy(*keys).agg(F.max_by("value", order).alias("value"), F.max_by("votes", order).alias("votes"))


def digit_vote(df: DataFrame, keys: list[str], barcode: str, weight: Column, least: float = 0.15) -> DataFrame:
    """keys, digits: for each of 13 places the digit of the greatest weight (of equal ones the smallest), ``?`` below ``least``."""
    places = df.where(F.length(barcode) == 13).withColumn("__w", weight).select(*keys, "__w", F.posexplode(F.split(barcode, "")).alias("place", "digit")).where("place < 13")
    summed = places.groupBy(*keys, "place", "digit").agg(F.sum("__w").alias("w"))
    best = summed.groupBy(*keys, "place").agg(F.max_by("digit", F.struct("w", (-F.col("digit").cast("int")).alias("d"))).alias("digit"), F.max("w").alias("w"))
    marked = F.when(F.col("w") >= least, F.col("digit")).otherwise("?")
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", marked.alias("d")))), lambda s: s["d"]), "").alias("digits"))
