"""Islands of a stream: session windows with a watermark.  The batch operator is operators.temporal.islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_islands(stream: DataFrame, gap: str = "1 second", lateness: str = "10 minutes", key: str = "video_id", time: str = "ts", score: str = "score") -> DataFrame:
    """(key, start, end, score) of runs of events at most gap apart; end is the last event, not the window's end."""
    late = stream.withWatermark(time, lateness)
    runs = late.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.max(score).alias("score"))
    return runs.select(key, "start", "end", "score")
