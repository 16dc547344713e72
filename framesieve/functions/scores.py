"""Normalisation, rank fusion and answer scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def clean(x: Column) -> Column:
    """NaN, infinities and null as 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x.cast("double"), F.lit(0.0)))


def minmax(x: Column, over: WindowSpec, eps: float = 1e-12) -> Column:
    """To [0, 1] within a window; a constant becomes 1 if positive, else 0.  Missing values count as 0."""
    value = clean(x)
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high - low <= eps, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def rrf(score: Column, over: WindowSpec, k: int = 60) -> Column:
    """1 / (k + rank) by falling score; over orders ties.  Without evidence there is no term."""
    return F.when(score > 0, 1.0 / (max(k, 1) + F.row_number().over(over))).otherwise(0.0)


def logistic_gradient(delta: Column) -> Column:
    return 1 / (1 + F.exp(F.least(F.greatest(delta, F.lit(-40.0)), F.lit(40.0))))


def kis(video: Column, frame: Column, gt_video: Column, start: Column, end: Column) -> Column:
    return F.coalesce(((video == gt_video) & frame.between(start, end)).cast("double"), F.lit(0.0))


def same_answer(answer: Column, gt_answer: Column) -> Column:
    return F.lower(F.trim(answer)) == F.lower(F.trim(gt_answer))


def qa(video: Column, frame: Column, answer: Column, gt_video: Column, start: Column, end: Column, gt_answer: Column, matcher=same_answer) -> Column:
    return F.coalesce(kis(video, frame, gt_video, start, end) * matcher(answer, gt_answer).cast("double"), F.lit(0.0))


def trake(video: Column, frames: Column, gt_video: Column, intervals: Column) -> Column:
    """Share of a sequence's events whose frame is in its interval; intervals: array of structs (s, e)."""
    fits = F.zip_with(frames, intervals, lambda f, i: F.when(f.between(i["s"], i["e"]), 1.0).otherwise(0.0))
    share = F.aggregate(fits, F.lit(0.0), lambda a, x: a + x) / F.size(intervals)
    usable = (video == gt_video) & (F.size(frames) == F.size(intervals)) & (F.size(frames) > 0)
    return F.when(usable, share).otherwise(0.0)
