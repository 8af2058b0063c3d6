"""Segment photometry over a stream of pixels.

The studied behaviour is batch only; this is the same aggregation (AGG-1) kept up to date as tiles of an
image arrive.  Totals are per (image, segment); with a time column and a watermark, images that
are complete leave the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_segment_flux(pixels: DataFrame, time: str | None = None, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Flux and pixels of each segment so far; ``pixels`` has image_id, segID, flux and, with ``time``, that column."""
    good = pixels.where("segID > 0")
    keys = ["image_id", "segID"]
    if time is not None:
        good = good.withWatermark(time, late)
        keys = [F.window(time, window).alias("window"), *keys]
    return good.groupBy(*keys).agg(F.coalesce(F.sum("flux"), F.lit(0.0)).alias("flux"), F.count("flux").alias("N100"))
