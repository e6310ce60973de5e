"""The two prices of a tag out of its recognised tokens. Money is in integer cents.

A tag's tokens are read one after the other, as each roubles take the nearest free kopecks; this is done for a batch of
tags at a time in Python, where column expressions would read every token some ten times.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import DIGITS, LOOK_ALIKES

# Shapes of numbers in a token, how far kopecks may stand from their roubles, and how their heights may differ.
FULL = re.compile(r"([0-9]{1,4})[.,]([0-9]{2})(?![0-9])")
REACH, LEAST_RATIO, MOST_RATIO, MOST_VOTES = 3, 0.2, 1.1, 5
_READ_AS = str.maketrans(LOOK_ALIKES, DIGITS)
_NOISE, _BLANKS = re.compile(r"[^0-9.,\s]", re.ASCII), re.compile(r"\s+", re.ASCII)
_PAIR = T.StructType([T.StructField(c, T.LongType()) for c in ("price_default", "price_card")])


@lru_cache(maxsize=1 << 16)
def _number(text: str | None) -> tuple[str, int] | None:
    """A token as full price, roubles or kopecks, and its value; none for all others."""
    if text is None:
        return None
    s = _BLANKS.sub(" ", _NOISE.sub(" ", text.translate(_READ_AS))).strip(" ")
    full = FULL.search(s)
    if full and (cents := int(full[1] + full[2])) >= 100:
        return "full", cents
    if 2 <= len(s) <= 5 and s.isdigit():
        return ("kop" if len(s) == 2 else "rub"), int(s)
    return None


def tag_prices(texts: list, heights: list) -> tuple[int | None, int | None]:
    """Default and card price of one tag: full prices, and roubles with the nearest kopecks that no earlier roubles have taken."""
    numbers = [(i, *n, 0.0 if h is None else h) for i, (n, h) in enumerate(zip(map(_number, texts), heights, strict=True)) if n]
    kopecks = {i: (v, h) for i, kind, v, h in numbers if kind == "kop"}
    prices: dict[int, list[float]] = {}
    for i, kind, v, h in numbers:
        if kind == "kop":
            continue
        if kind == "rub":
            fits = lambda j: j in kopecks and (h <= 0 or kopecks[j][1] <= 0 or LEAST_RATIO <= kopecks[j][1] / h <= MOST_RATIO)  # noqa: B023, E731
            taken = next((j for d in range(1, REACH + 1) for j in (i - d, i + d) if fits(j)), None)
            v = v * 100 + (0 if taken is None else kopecks.pop(taken)[0])
        prices.setdefault(v, []).append(h)
    # a height that is no number counts as the greatest there is and, turned round, comes last
    tallest = lambda hs: (True, 0.0) if any(map(math.isnan, hs)) else (False, -max(hs))
    ranked = sorted(prices, key=lambda v: (-min(len(prices[v]), MOST_VOTES), *tallest(prices[v]), -v))[:2]
    first, second = (*ranked, None, None)[:2]
    return (first, second) if second is not None and second < first else (second, first)


@F.arrow_udf(_PAIR)
def _prices(texts: pa.Array, heights: pa.Array) -> pa.Array:
    none = (None, None)
    told = [none if t is None else tag_prices(t, h) for t, h in zip(texts.to_pylist(), heights.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([p[k] for p in told], pa.int64()) for k in (0, 1)], ["price_default", "price_card"])


def with_prices(df: DataFrame, tokens: str) -> DataFrame:
    """``df`` with price_default and price_card, from its array of tokens (text, height) in reading order.

    Equal values are one price; prices read more often (up to five times), then taller, then greater ones come
    first. The first is the card price and the second the default one, unless that would be the smaller.
    """
    read = df.withColumn("__prices", _prices(F.col(tokens)["text"], F.col(tokens)["height"].cast("array<double>")))
    return read.withColumns({c: F.col("__prices")[c] for c in ("price_default", "price_card")}).drop("__prices")
