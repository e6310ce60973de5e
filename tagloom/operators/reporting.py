"""Reports over jobs and tags, and the comparison of two runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.predicates import analytics_empty, screen_empty
from tagloom.functions.scores import compare_key
from tagloom.functions.text import STOP_WORDS
from tagloom.operators.catalog import first_by


def row_fill(columns: list[str]) -> Column:
    """The share of fields that a row has filled."""
    return sum((F.when(analytics_empty(F.col(c)), 0).otherwise(1) for c in columns), F.lit(0)) / len(columns)


def by_day(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("jobs"))


def fill_by_day(tags: DataFrame, jobs: DataFrame, columns: list[str]) -> DataFrame:
    """Mean fill of the tags by the day of their job, round 4."""
    filled = tags.select("job_id", row_fill(columns).alias("fill")).join(jobs.select(F.col("id").alias("job_id"), F.to_date("created_at").alias("day")), "job_id")
    return filled.groupBy("day").agg(F.round(F.avg("fill"), 4).alias("fill_rate"))


def tag_types(tags: DataFrame, most: int = 20) -> DataFrame:
    """Counts by color, else by special symbol, else unknown."""
    kind = F.when(~analytics_empty(F.col("color")), F.col("color")).when(~analytics_empty(F.col("special_symbols")), F.col("special_symbols")).otherwise("unknown")
    return tags.groupBy(kind.alias("type")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type").limit(most)


def top_products(tags: DataFrame, name: str = "product_name", most: int = 10) -> DataFrame:
    label = F.trim(F.col(name))
    named = tags.where(~screen_empty(F.col(name)))
    return named.groupBy(label.alias("product_name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "product_name").limit(most)


def search(tags: DataFrame, name: str | None = None, barcode: str | None = None, price: str | None = None, price_columns: tuple[str, ...] = ("price_default", "price_card")) -> DataFrame:
    """Rows whose name, barcode and any price hold the given patterns, whatever their case."""
    has = lambda c, q: F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(f"(?iu){q}")
    tests = [has(c, q) for c, q in (("product_name", name), ("barcode", barcode)) if q]
    if price:
        tests.append(reduce(lambda a, b: a | b, (has(c, price) for c in price_columns)))
    return tags.where(reduce(lambda a, b: a & b, tests)) if tests else tags


def problem(mandatory: list[str], prices: list[str]) -> Column:
    """A mandatory field is empty, or there is no price at all."""
    return reduce(lambda a, b: a | b, (screen_empty(F.col(c)) for c in mandatory)) | reduce(lambda a, b: a & b, (screen_empty(F.col(c)) for c in prices))


def keyed_once(run: DataFrame) -> DataFrame:
    """A run's rows that have a compare key, the first of each."""
    keyed = run.withColumn("compare_key", compare_key(F.col("id_sku"), F.col("barcode"))).where("compare_key is not null")
    return first_by(keyed, ["compare_key"], F.col("pos"))


def common(left: DataFrame, right: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """compare_key and each column of both runs, as ``_left`` and ``_right``."""
    side = lambda df, s: df.select("compare_key", *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return side(left, "left").join(side(right, "right"), "compare_key")


def run_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: keys of both runs, of each, in common, and prices that differ."""
    l, r = left.select("compare_key", F.col("price_default").alias("a"), F.lit(1).alias("l")), right.select("compare_key", F.col("price_default").alias("b"), F.lit(1).alias("r"))
    both = l.join(r, "compare_key", "full")
    n = lambda c: F.count_if(c).cast("long")
    has_l, has_r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(
        n(has_l).alias("left_rows"), n(has_r).alias("right_rows"), n(has_l & has_r).alias("common_rows"), n(has_l & ~has_r).alias("left_only"),
        n(~has_l & has_r).alias("right_only"), n(has_l & has_r & ~F.col("a").eqNullSafe(F.col("b"))).alias("price_diffs"),
    )


def profile(gt: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, barcodes, box sizes and times by video."""
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    return gt.groupBy("video").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("barcode") != "", F.col("barcode"))).alias("barcodes"), F.sum(w).alias("sum_w"), F.min(w).alias("min_w"), F.min(h).alias("min_h"),
        F.min("frame_timestamp").alias("first_ts"), F.max("frame_timestamp").alias("last_ts"), *[F.count_if(F.col(c) == "нет").alias(f"absent_{c}") for c in columns],
    )


def busiest(gt: DataFrame) -> DataFrame:
    """The time of each video with most rows, of equal ones the earliest."""
    n = gt.groupBy("video", "frame_timestamp").agg(F.count("*").alias("n"))
    return n.groupBy("video").agg(F.max_by("frame_timestamp", F.struct("n", (-F.col("frame_timestamp")).alias("t"))).alias("frame_timestamp"), F.max("n").alias("n"))


def longest_words(rows: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """key, words: a text's longest words of four letters and more, of equal length the earlier ones; numbers and stop words are left out.

    Each row is read by itself: its words are sorted and the first are taken that differ in more than case.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([A-Za-zА-Яа-яЁё0-9]{4,})"))
    # a word's later occurrences go before the words are told apart by case
    told = F.filter(F.array_distinct(words), lambda w: ~w.rlike(r"^\d+$") & ~F.lower(w).isin(*STOP_WORDS))
    longest = F.array_sort(F.transform(told, lambda w, i: F.struct((-F.length(w)).alias("size"), i.alias("i"), w.alias("w"))))
    new = lambda kept, x: (F.size(kept) < most) & ~F.exists(kept, lambda k: F.lower(k) == F.lower(x["w"]))
    first = F.aggregate(longest, F.array().cast("array<string>"), lambda kept, x: F.when(new(kept, x), F.array_append(kept, x["w"])).otherwise(kept))
    return rows.select(key, F.array_join(first, " ").alias("words"))
