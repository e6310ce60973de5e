"""Small rules on tags, crops and frames: what is dropped and why, what is shown, and how rows are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import BEVERAGES

# How codes begin that stand for no product.
PLACEHOLDERS = ("2099999", "2999999", "0000000")
# Fixed value: frames that move more than so many times the track's median are blurred.
CALM = 1.8


def crop_problem(aspect: Column, paper: Column, sharpness: Column, aspects: tuple[float, float], least_paper: float, least_sharpness: float) -> Column:
    """The first test that a crop fails: ``ar``, ``paper`` or ``sharp``; else ``ok``."""
    return F.when(~aspect.between(*aspects), "ar").when(paper < least_paper, "paper").when(sharpness < least_sharpness, "sharp").otherwise("ok")


def plausible_box(width: Column, height: Column, sides: tuple[int, int], aspects: tuple[float, float]) -> Column:
    """Both sides within bounds, and the height over the width too."""
    return width.between(*sides) & height.between(*sides) & (height / F.greatest(width, F.lit(1))).between(*aspects)


def subset(catalog: DataFrame, name: str, which: str) -> DataFrame:
    """The catalog rows of a subset: ``beverage`` by words of the name, or ``all``."""
    if which not in ("beverage", "all"):
        raise ValueError(f"unknown subset: {which}")
    return catalog if which == "all" else catalog.where(F.col(name).rlike(BEVERAGES))


def of_kept_tracks(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose track has a row in ``kept``."""
    return rows.join(kept.select(*keys).distinct(), keys, "left_semi")


def sharpest_calm(frames: DataFrame, keys: list[str], motion: str, sharpness: str, top: int, pos: str = "pos") -> DataFrame:
    """The ``top`` sharpest frames of each track among those that move at most 1.8 times the track's median; among all, where none is calm."""
    own = Window.partitionBy(*keys)
    median = frames.groupBy(*keys).agg(F.percentile(motion, 0.5).alias("__median"))
    calm = frames.join(median, keys).withColumn("__calm", F.abs(motion) <= CALM * F.col("__median")).withColumn("__some", F.max("__calm").over(own))
    order = own.orderBy(F.col(sharpness).desc(), pos)
    return calm.where("__calm or not __some").withColumn("choice", F.row_number().over(order)).where(F.col("choice") <= top).drop("__median", "__calm", "__some")


def probe_status(truth: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: whether any hit is the true barcode, shares its first 12 digits, is another code, or there is none."""
    met = truth.join(hits, keys, "left").groupBy(*keys).agg(
        F.max(F.coalesce(F.col("hit") == F.col("barcode"), F.lit(False))).alias("exact"), F.max(F.coalesce(F.substring("hit", 1, 12) == F.substring("barcode", 1, 12), F.lit(False))).alias("prefix"), F.count("hit").alias("n"),
    )
    return met.select(*keys, F.when(F.col("exact"), "EXACT").when(F.col("prefix"), "PREFIX12").when(F.col("n") > 0, "ANY").otherwise("miss").alias("status"))


def probe_by_source(truth: DataFrame, hits: DataFrame, keys: list[str], sources: tuple[str, ...]) -> DataFrame:
    """keys, source, status for each source of hits (keys, source, hit) and for ``either``: as :func:`probe_status`, and ``ANY(n)`` with the number of other codes."""
    every = hits.where(F.col("source").isin(*sources)).unionByName(hits.where(F.col("source").isin(*sources)).withColumn("source", F.lit("either"))).distinct()
    asked = truth.withColumn("source", F.explode(F.array(*map(F.lit, (*sources, "either")))))
    same = lambda n: F.coalesce(F.substring("hit", 1, n) == F.substring("barcode", 1, n), F.lit(False))
    met = asked.join(every, [*keys, "source"], "left").groupBy(*keys, "source").agg(F.max(F.coalesce(F.col("hit") == F.col("barcode"), F.lit(False))).alias("exact"), F.max(same(12)).alias("prefix"), F.count("hit").alias("n"))
    other = F.when(F.col("n") > 0, F.concat(F.lit("ANY("), F.col("n").cast("string"), F.lit(")"))).otherwise("miss")
    return met.select(*keys, "source", F.when(F.col("exact"), "EXACT").when(F.col("prefix"), "PREFIX12").otherwise(other).alias("status"))


def row_label(name: Column, barcode: Column, prices: list[Column]) -> Column:
    """Name, barcode and the first price there is, parted by bars; a dash for what is missing, but for the name."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    return F.concat_ws(" | ", F.coalesce(name, F.lit("")), dash(F.coalesce(barcode, F.lit(""))), dash(F.coalesce(*prices).cast("string")))


def short_label(name: Column, barcode: Column, words: int = 4, length: int = 36) -> Column:
    """The name's first words, cut to a length, and the last four digits of the barcode."""
    head = F.left(F.array_join(F.slice(F.split(name, " "), 1, words), " "), F.lit(length))
    return F.concat(head, F.lit(" …"), F.right(barcode, F.lit(4)))


def placeholder_code(barcode: Column) -> Column:
    return barcode.rlike("^(" + "|".join(PLACEHOLDERS) + ")")


def plausible_digits(barcode: Column) -> Column:
    """More than three different digits and fewer than six zeros."""
    return (F.size(F.array_distinct(F.split(barcode, ""))) > 3) & (F.length(barcode) - F.length(F.replace(barcode, F.lit("0"), F.lit(""))) < 6)


def first_products(tags: DataFrame, keys: list[str], most: int, pos: str = "pos") -> DataFrame:
    """The first ``most`` barcodes of each key that were seen with a name, with their first pos and how often they were."""
    seen = tags.where("barcode <> '' and product_name <> ''").groupBy(*keys, "barcode").agg(F.min(pos).alias(pos), F.count("*").alias("votes"))
    return seen.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).where(F.col("__n") <= most).drop("__n")


def split_by(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that meet a condition, and all others."""
    meets = F.coalesce(condition, F.lit(False))
    return rows.where(meets), rows.where(~meets)


def seeded_split(rows: DataFrame, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """About ``share`` of the rows, chosen by a hash of the key, and all others: the same at any partitioning."""
    return split_by(rows, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))
