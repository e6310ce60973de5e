"""Where engines that look at pixels or write language plug in: iterators of frames to iterators of frames.

None is shipped. A provider gets batches of its input table and yields rows of its contract; Spark
spreads the batches and checks the columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.joins import first_at_least, reached, running_sum, saved

Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
#: Contract of each kind of provider: the columns that it yields.
CONTRACTS = {
    "detect": "video string, frame_idx bigint, frame_ts_ms bigint, cls int, score double, x_min int, y_min int, x_max int, y_max int, sharpness double",
    "ocr": "video string, track_id int, rank int, frame_ts_ms bigint, ocr_angle int, ocr_text string, ocr_items array<struct<text:string,conf:double,height:double>>",
    "decode": "video string, frame_idx bigint, kind string, text string, x0 double, y0 double, x1 double, y1 double, pos int",
    "digits": "video string, track_id int, digits string, weight double",
    "name": "pos bigint, answer string",
    "frames": "video string, frame_idx bigint, frame_ts_ms bigint, sharpness double, difference double",
}


def run(table: DataFrame, provider: Provider, kind: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The provider's rows. order: columns that rows of a partition are sorted by, for reading videos in sequence."""
    if order:
        table = table.repartition(order[0]).sortWithinPartitions(*order)
    return table.mapInPandas(provider, CONTRACTS[kind])


STRETCH = 10_000  # frames that are ordered in one task


def kept_frames(frames: DataFrame, stride_ms: int, least_sharpness: float, least_difference: float) -> DataFrame:
    """video, frame_idx, in order: frames at least ``stride_ms`` after the last kept, sharp enough and different enough from it.

    frames: the ``frames`` contract; frame_idx is unique in a video, and times do not fall with it. ``difference`` is the
    change from the frame before, never negative; changes add up since the last kept, blurred frames included.

    The frame kept next depends on the last one alone: the first sharp one that is late enough, or the first
    whose running sum of changes is great enough, whichever comes later. So each sharp frame has one link,
    and the frames kept are those that links reach from the first sharp frame of a video.
    """
    summed = running_sum(frames.select("video", "frame_idx", "frame_ts_ms", "sharpness", "difference"), ["video"], "frame_idx", "difference", "moved", STRETCH)
    sharp = saved(summed.where(F.col("sharpness") >= least_sharpness).select("video", F.col("frame_idx").alias("n"), "frame_ts_ms", "moved"))
    if stride_ms <= 0 and least_difference <= 0:
        return sharp.select("video", F.col("n").alias("frame_idx")).orderBy("video", "frame_idx")
    late = first_at_least(sharp, ["video"], "n", "frame_ts_ms", stride_ms, "late", STRETCH)
    far = first_at_least(sharp, ["video"], "n", "moved", least_difference, "far", STRETCH)
    after = late.join(far, ["video", "n"]).where("late is not null and far is not null").select("video", "n", F.greatest("late", "far").alias("to"))
    starts = sharp.groupBy("video").agg(F.min("n").alias("n"))
    return reached(after, starts, ["video"]).select("video", F.col("n").alias("frame_idx")).orderBy("video", "frame_idx")
