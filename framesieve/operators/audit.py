"""Audits of a dataset's files: what they hold, how they fit together, a report."""

from __future__ import annotations

import json
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import parent, stem
from .manifest import ordinal

#: Files that are looked into, rows that are shown of each, and keys.
SAMPLES, SAMPLE_ROWS, SAMPLE_KEYS = 10, 3, 20


def sample(files: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first n files by path."""
    return files.orderBy("path").limit(n)


def inspect_json(files: DataFrame) -> DataFrame:
    """(path, type, keys, error) of JSON files (path, content): the document's type, and an object's keys by name."""
    parsed = files.select("path", F.expr("try_parse_json(cast(content AS string))").alias("v"))
    kind = F.regexp_extract(F.expr("schema_of_variant(v)"), "^[A-Z]+", 0)
    keys = F.when(kind == "OBJECT", F.array_sort(F.map_keys(F.expr("try_cast(v AS map<string, variant>)"))))
    error = F.when(F.col("v").isNull(), "not JSON")
    return parsed.select("path", F.lower(kind).alias("type"), keys.alias("keys"), error.alias("error"))


def inspect_csv(files: DataFrame) -> DataFrame:
    """(path, rows, columns, dtypes, sample, error) of CSV files (path, content); sample: the first rows as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    made = pd.read_csv(BytesIO(content))
                    kinds = {str(c): str(t) for c, t in made.dtypes.items()}
                    out.append((path, len(made), list(kinds), kinds, made.head(SAMPLE_ROWS).to_json(orient="records"), None))
                except Exception as e:  # whatever is wrong with a file belongs to its row
                    out.append((path, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "rows", "columns", "dtypes", "sample", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, rows long, columns array<string>, dtypes map<string,string>, sample string, error string")


def frequency(inspected: DataFrame, names: str) -> DataFrame:
    """(name, n): how many of the inspected files have each key or column."""
    return inspected.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def manifest(images: DataFrame, features: DataFrame, mapping: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest of images as far as all of a video's inputs go, and (video_id, error) of what doesn't fit.

    images (video_id, keyframe_name, keyframe_path) are ordered by the number that ends their names; features (video_id,
    clip_path, rows); mapping (video_id, pos, n, pts_time, fps, frame_idx, error); objects (path): root/video/name.json.
    A video without features or mapping, or with an image without a number, has errors and no rows.
    """
    numbered = images.withColumn("number", F.regexp_extract("keyframe_name", r"(\d+)$", 1))
    counts = numbered.groupBy("video_id").agg(F.count("*").alias("keyframes"), F.max(F.col("number") == "").alias("unnumbered"))
    order = W.partitionBy("video_id").orderBy("pos")
    falls = lambda c: F.col(c) < F.lag(c).over(order)
    numeric = F.col("n").isNull() | F.col("pts_time").isNull() | F.col("fps").isNull() | F.col("frame_idx").isNull()
    rows = mapping.where("pos IS NOT NULL").join(counts.join(features.select("video_id", "rows"), "video_id").select("video_id", F.least("keyframes", "rows").alias("upto")), "video_id", "left")
    used = F.col("pos") < F.coalesce("upto", F.lit(0))
    mapped = rows.withColumns({"f": falls("frame_idx") & used, "t": falls("pts_time") & used}).groupBy("video_id").agg(F.count("*").alias("mapping_rows"), F.max(numeric).alias("odd"), F.max("f").alias("frames_fall"), F.max("t").alias("times_fall"))
    broken = mapping.where("error IS NOT NULL").groupBy("video_id").agg(F.min("error").alias("unreadable"))
    facts = counts.join(features.select("video_id", "clip_path", F.col("rows").alias("clip_rows")), "video_id", "left").join(mapped, "video_id", "left").join(broken, "video_id", "left")
    sizes = F.concat(F.lit("keyframes="), "keyframes", F.lit(", mapping_rows="), "mapping_rows", F.lit(", clip_rows="), "clip_rows")
    no_map = F.col("mapping_rows").isNull()
    whole = F.col("clip_path").isNotNull() & ~no_map & ~F.col("unnumbered")
    checks = [
        F.when(F.col("clip_path").isNull(), "missing feature file").when(no_map, F.coalesce("unreadable", F.lit("missing mapping"))).when(F.col("unnumbered"), "a keyframe's name has no number"),
        F.when(whole & ((F.col("keyframes") != F.col("mapping_rows")) | (F.col("keyframes") != F.col("clip_rows"))), sizes), F.when(whole & F.col("odd"), "mapping holds cells that are not numbers"),
        F.when(whole & F.col("frames_fall"), "frame_idx falls"), F.when(whole & F.col("times_fall"), "pts_time falls"),
    ]
    errors = facts.select("video_id", F.explode(F.filter(F.array(*checks), lambda e: e.isNotNull())).alias("error"))
    number = F.expr("try_cast(number AS BIGINT)")
    placed = ordinal(numbered, "video_id", number, "keyframe_name").join(facts.where(whole).select("video_id", "clip_path", "clip_rows"), "video_id").where("pos < clip_rows")
    joined = placed.join(mapping.where("pos IS NOT NULL").select("video_id", "pos", "pts_time", "fps", "frame_idx"), ["video_id", "pos"])
    paths = objects.select(parent(F.col("path")).alias("video_id"), stem(F.col("path")).alias("keyframe_name"), "path").groupBy("video_id", "keyframe_name").agg(F.min("path").alias("object_path"))
    made = joined.join(paths, ["video_id", "keyframe_name"], "left").select(
        "video_id", F.col("pos").cast("long").alias("keyframe_idx"), "keyframe_name", F.col("keyframe_path").alias("image_path"), F.col("frame_idx").cast("long").alias("original_frame_id"), "pts_time", "fps",
        F.col("pos").cast("long").alias("clip_idx"), "clip_path", F.coalesce("object_path", F.lit("")).alias("object_path"),
    )
    return made, errors


def report(summary: dict) -> str:
    """What a summary says in numbers, a line for each part, and its first hundred errors by video."""
    lines = [f"{part:<12}" + "  ".join(f"{name}={n}" for name, n in facts.items() if isinstance(n, int)) for part, facts in summary.items()]
    by: dict[str, list[str]] = {}
    for error in summary["integrity"]["errors"][:100]:
        video, _, what = error.rpartition(": ")
        by.setdefault(video or "(dataset)", []).append(what)
    return "\n".join([*lines, *(f"{video}\n" + "\n".join(f"    {w}" for w in what) for video, what in by.items())]) + "\n"


def rows(df: DataFrame) -> list[dict]:
    """The rows of a bounded table, as plain values."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"})).collect()]
