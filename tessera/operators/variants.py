"""Choosing one of several: floor lookup, nearest, best of a group, ordered fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_lookup(offers: DataFrame, group: str, size: str, asked: Column) -> DataFrame:
    """For each group the largest size that is at most what is asked, else the smallest."""
    return offers.groupBy(group).agg(F.coalesce(F.max(F.when(F.col(size) <= asked, F.col(size))), F.min(size)).alias("chosen"))


def best_of(rows: DataFrame, group: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row of each group that is greatest by order; one pass with partial aggregation, no window."""
    return rows.groupBy(*group).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("b")).select(*group, "b.*")


def first_answer(*sources: Column) -> Column:
    return F.coalesce(*sources)


def target_bitrate(width: Column, height: Column, fps: Column, per_pixel: float = 0.086) -> Column:
    return width * height * F.least(F.coalesce(fps, F.lit(30.0)), F.lit(60.0)) * per_pixel


def video_plan(bitrate: Column, target: Column, fits: Column) -> Column:
    """Encode anew only from 1.4 times the target; else keep, or rewrap if the container doesn't fit."""
    return F.when(bitrate >= 1.4 * target, "encode").when(fits, "keep").otherwise("remux")


def estimated_size(size: Column, bitrate: Column, seconds: Column) -> Column:
    return F.coalesce(size, bitrate * seconds / 8)
