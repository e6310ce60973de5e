"""Recovering the barcodes of tracks from what their frames were read as, with the catalog as a gate.

All steps are counts over (track, code) and joins with the catalog's codes; a track's frames never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.text import digit_runs, ean_ok, fix_ocr_digits
from tagloom.functions.votes import best_barcode
from tagloom.operators.catalog import barcode_index, one_digit_apart, prefix_postings
from tagloom.operators.joins import meet


def code_candidates(text: Column) -> Column:
    """Runs of 12 and 13 digits, then all 13- and 12-grams of the digits put together, with repetitions."""
    clean = fix_ocr_digits(F.coalesce(text, F.lit("")))
    digits = F.regexp_replace(clean, r"\D", "")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits) - n + 1))
        return F.when(F.length(digits) >= n, F.transform(starts, lambda i: F.substring(digits, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(F.regexp_extract_all(clean, F.lit(r"(?<!\d)(\d{12,13})(?!\d)")), grams(13), grams(12))


def known_to(catalog: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """``codes`` with ``known``: whether the catalog has the code in full or its first 12 digits."""
    index = barcode_index(catalog)
    full = index.select(F.col("code").alias("__full"))
    head = index.where(F.length("code") == 12).select(F.col("code").alias("__head"))
    met = codes.join(full, F.col(code) == F.col("__full"), "left").join(head, F.substring(code, 1, 12) == F.col("__head"), "left")
    return met.withColumn("known", F.col("__full").isNotNull() | F.col("__head").isNotNull()).drop("__full", "__head")


def ngram_votes(texts: DataFrame, catalog: DataFrame, keys: list[str], text: str, pos: str = "pos", least: int = 2) -> DataFrame:
    """keys, barcode, votes: of the codes with ``least`` votes or more the best; of a track with one text, any code that passes.

    Codes with a right check digit that the catalog knows come first, by votes, then by the greater code; without
    one the code seen first stands, as it does where no code passes.
    """
    said = texts.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    rows = said.select(*keys, F.col(pos).alias("__pos"), F.posexplode(code_candidates(F.col(text))).alias("at", "code"))
    counted = rows.groupBy(*keys, "code").agg(F.count("*").alias("votes"), F.min(F.struct("__pos", "at")).alias("seen"))
    lone = said.groupBy(*keys).agg((F.count("*") == 1).alias("lone"))
    told = known_to(catalog, counted, "code").withColumn("passes", ean_ok(F.col("code")) & F.col("known")).join(lone, keys)
    told = told.where((F.col("votes") >= least) | F.col("lone") & F.col("passes"))
    order = [(F.col("votes") >= least).desc(), F.col("passes").desc(), F.when(F.col("passes"), F.col("votes")).desc(), F.when(F.col("passes"), F.col("code")).desc(), F.col("seen")]
    best = told.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1")
    return best.select(*keys, F.col("code").alias("barcode"), "votes")


def rank_hits(hits: DataFrame, catalog: DataFrame, keys: list[str], code: str, pos: str = "pos", require_known: bool = True) -> DataFrame:
    """keys, barcode, votes: of a decoder's hits the one of most votes, a right check digit, known to the catalog, the longest, seen first.

    A hit stands with 13 digits and a right check digit, known if required; one of 12 digits only if not required.
    """
    counted = hits.where(F.length(code) >= 12).groupBy(*keys, F.col(code).alias("code")).agg(F.count("*").alias("votes"), F.min(pos).alias("first"))
    told = known_to(catalog, counted, "code").withColumn("right", ean_ok(F.col("code")))
    stands = F.col("right") & F.col("known") if require_known else F.col("right") | (F.length("code") == 12)
    order = F.struct("votes", F.col("right").cast("int").alias("r"), F.col("known").cast("int").alias("k"), F.length("code").alias("l"), (-F.col("first")).alias("f"))
    best = told.where(stands).groupBy(*keys).agg(F.max_by("code", order).alias("barcode"), F.max_by("votes", order).alias("votes"))
    return best


def partial_votes(texts: DataFrame, catalog: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, barcode, votes: catalog codes that runs of 10 to 12 digits begin, or that runs of 12 digits miss by one digit.

    Runs are distinct within their keys. They meet lists of codes as numbers (a run of 10 digits begins 200 codes at most, and
    as many are one digit apart), which go to their keys in one shuffle and are counted there.
    """
    dealt = texts.select(*keys, text).repartition(*keys)
    number = lambda c: F.concat(F.lit("1"), c).cast("long")  # noqa: E731  # codes may begin with 0
    of = lambda rows, c: rows.groupBy("run").agg(F.collect_list(number(F.col(c))).alias("codes"))
    begun = dealt.select(*keys, F.explode(digit_runs(F.col(text))).alias("run")).where(F.length("run").between(10, 12)).distinct()
    runs = dealt.select(*keys, F.explode(F.array_distinct(F.filter(code_candidates(F.col(text)), lambda c: F.length(c) == 12))).alias("run")).distinct()
    near = one_digit_apart(runs.select(F.col("run").alias("__body")).distinct(), catalog).withColumnRenamed("__body", "run")
    hits = meet(begun, of(prefix_postings(catalog).withColumnRenamed("prefix", "run"), "barcode"), "run").unionByName(meet(runs, of(near, "__found"), "run"))
    votes = hits.select(*keys, "codes").repartition(*keys).select(*keys, F.explode("codes").alias("code")).groupBy(*keys, "code").agg(F.count("*").alias("votes"))
    return votes.select(*keys, F.substring(F.col("code").cast("string"), 2, 13).alias("barcode"), "votes")


def needs_code(frames: DataFrame, keys: list[str], barcode: str) -> DataFrame:
    """Tracks without a barcode that has a right check digit."""
    good = best_barcode(frames, keys, barcode).where(ean_ok(F.col("value"))).select(*keys)
    return frames.select(*keys).distinct().join(good, keys, "left_anti")


def recover_tracks(frames: DataFrame, catalog: DataFrame, keys: list[str], text: str, barcode: str, least: int = 2) -> DataFrame:
    """``frames`` where every row of a track that lacks a right barcode bears the one its texts vote for, with ``recovered``."""
    lacking = frames.join(needs_code(frames, keys, barcode), keys, "left_semi")
    found = ngram_votes(lacking, catalog, keys, text, least=least).select(*keys, F.col("barcode").alias("__found"))
    met = frames.join(found, keys, "left")
    return met.withColumns({barcode: F.coalesce("__found", barcode), "recovered": F.col("__found").isNotNull()}).drop("__found")
