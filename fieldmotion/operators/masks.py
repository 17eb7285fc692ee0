"""Mask pixels as rows (clip, frame_idx, ch, px, py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shift_channel(pixels: DataFrame, channel: int, up: int) -> DataFrame:
    """Move one channel up by ``up`` pixels; rows leaving the image are dropped."""
    hit = F.col("ch") == channel
    return pixels.where(~hit | (F.col("py") >= up)).withColumn(
        "py", F.when(hit, F.col("py") - up).otherwise(F.col("py")).cast("int"))
