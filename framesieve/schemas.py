"""Column contracts of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FRAMES = T.StructType([
    T.StructField("row_id", T.LongType(), False), T.StructField("video_id", T.StringType(), False), T.StructField("keyframe_idx", T.LongType()),
    T.StructField("original_frame_id", T.LongType()), T.StructField("pts_time", T.DoubleType()), T.StructField("image_path", T.StringType()),
    T.StructField("object_path", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType(), False)),
])
MAPPING = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("pts_time", T.DoubleType()), T.StructField("fps", T.DoubleType()), T.StructField("frame_idx", T.LongType())])
EVIDENCE = T.StructType([T.StructField("modality", T.StringType()), T.StructField("video_id", T.StringType()), T.StructField("frame_id", T.LongType()), T.StructField("text", T.StringType())])
GROUND_TRUTH = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("video_ids", T.ArrayType(T.StringType())),
    T.StructField("frames", T.MapType(T.StringType(), T.ArrayType(T.LongType()))), T.StructField("intervals", T.MapType(T.StringType(), T.ArrayType(T.ArrayType(T.LongType())))),
])
VIDEO_MANIFEST = T.StructType([T.StructField(n, k) for n, k in (("video_id", T.StringType()), ("video_path", T.StringType()), ("fps", T.DoubleType()), ("frame_count", T.LongType()), ("duration_sec", T.DoubleType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("error", T.StringType()))])

MANIFEST_COLUMNS = ("video_id", "keyframe_idx", "original_frame_id", "pts_time", "image_path")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df itself; a ValueError names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
