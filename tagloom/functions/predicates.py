"""What counts as empty. A tag's field has three states: not recognised (null or blank), absent from
this kind of tag (the word "нет"), or a value; parts of the engine draw the line differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT = "нет"
EVALUATOR_NO = (ABSENT, "no", "n/a", "n\\a")


def norm(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def is_empty_or_no(x: Column) -> Column:
    """Parsers and catalog steps: blank, or any word for "none"."""
    return norm(x).isin("", "nan", ABSENT, "no", "n/a")


def analytics_empty(x: Column) -> Column:
    """Reports: "нет" counts as filled."""
    return norm(x).isin("", "nan", "none")


def screen_empty(x: Column) -> Column:
    return norm(x).isin("", "nan")


def metric_filled(x: Column) -> Column:
    """Metrics: any text that is not blank."""
    return x.isNotNull() & (F.trim(x.cast("string")) != "")


def evaluator_no(x: Column) -> Column:
    return norm(x).isin(*EVALUATOR_NO)


def evaluator_blank(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit(""))) == ""


def rerank_name_empty(x: Column) -> Column:
    return norm(x).isin("", "nan", ABSENT, "no")


def as_price(x: Column) -> Column:
    """A positive number, with a comma or a point; else null."""
    v = F.replace(F.trim(x.cast("string")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(v) & (v > 0), v)


def price_present(x: Column) -> Column:
    return ~norm(x).isin("", ABSENT, "nan") & as_price(x).isNotNull()
