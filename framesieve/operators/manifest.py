"""Manifests: positional alignment, validation, audits, lookups of files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import parent, stem
from ..schemas import MANIFEST_COLUMNS, require
from .jsontext import json_text


def ordinal(df: DataFrame, key: str, *order, name: str = "pos", start: int = 0) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1 + start)


def numeric_name(name: str | Column) -> Column:
    """Sort key of numbered files: the number, or last of all."""
    return F.coalesce((F.col(name) if isinstance(name, str) else name).try_cast("bigint"), F.lit(10**18))


def trailing_number(name: Column) -> Column:
    """Digits at the end of a name; an error without any."""
    found = F.regexp_extract(name, r"(\d+)$", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no trailing number: "), name)).cast("bigint")).otherwise(found.cast("bigint"))


def align(vectors: DataFrame, mapping: DataFrame, images: DataFrame, key: str = "video_id") -> DataFrame:
    """Row i of each input of one video, side by side; inputs carry (key, pos).  Shorter inputs end the video."""
    return vectors.join(mapping, [key, "pos"]).join(images, [key, "pos"])


def align_errors(inputs: dict[str, DataFrame], key: str = "video_id") -> DataFrame:
    """Videos whose inputs differ in length or are missing: (key, a count for each input)."""
    out = None
    for name, df in inputs.items():
        n = df.groupBy(key).agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, key, "full")
    counts = [F.coalesce(n, F.lit(0)) for n in inputs]
    out = out.select(key, *(c.alias(n) for c, n in zip(counts, inputs, strict=True)))
    return out.where(F.greatest(*(F.col(n) for n in inputs)) != F.least(*(F.col(n) for n in inputs)))


def build_index(vectors: DataFrame, mapping: DataFrame, images: DataFrame, dim: int = 512) -> DataFrame:
    """The frame table of vectors (video_id, pos, embedding), mapping (video_id, n, pts_time, fps, frame_idx) and
    images (video_id, pos, image_path).  Any mismatch fails the build and names up to three videos."""
    placed = ordinal(mapping, "video_id", "n")
    bad = align_errors({"vectors": vectors, "mapping": mapping, "images": images})
    wrong = placed.where(F.col("n") != F.col("pos") + 1).select("video_id").union(vectors.where((F.size("embedding") != dim) | F.col("embedding").isNull()).select("video_id"))
    failed = [r[0] for r in bad.select("video_id").union(wrong).distinct().orderBy("video_id").limit(3).collect()]
    if failed:
        raise RuntimeError(f"videos could not be indexed: {', '.join(map(str, failed))}")
    rows = align(vectors, placed, images)
    first = rows.groupBy("video_id").agg(F.count("*").alias("n_rows"))
    base = first.select("video_id", F.coalesce(F.sum("n_rows").over(W.orderBy("video_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(base, "video_id").select((F.col("base") + F.col("pos")).alias("row_id"), "video_id", F.col("n").cast("long").alias("keyframe_idx"), F.col("frame_idx").alias("original_frame_id"), "pts_time", "image_path", "embedding")


def validate(manifest: DataFrame, base: int = 0) -> DataFrame:
    """(video_id, error) of a manifest: missing columns raise; an empty one has one error without a video.  Per video:
    repeated keys, nulls, falling frames and times, gaps, and a clip_idx (where there is one) other than the
    keyframe's.  Rows of a video are taken in order of row_id, where there is one, else of keyframe_idx."""
    require(manifest, *MANIFEST_COLUMNS)
    order = W.partitionBy("video_id").orderBy(*(["row_id"] if "row_id" in manifest.columns else ["keyframe_idx", "original_frame_id", "pts_time"]))
    falls_ = lambda c: F.col(c) < F.lag(c).over(order)
    again = F.count("*").over(W.partitionBy("video_id", "keyframe_idx")) > 1
    rows = manifest.withColumns({"again": again, "nth": F.row_number().over(order) - 1 + base, "frame_falls": falls_("original_frame_id"), "time_falls": falls_("pts_time")})
    checks = {
        "duplicate keyframe_idx": F.max("again"), "null original_frame_id": F.max(F.col("original_frame_id").isNull()), "null pts_time": F.max(F.col("pts_time").isNull()),
        "original_frame_id falls": F.max("frame_falls"), "pts_time falls": F.max("time_falls"), "keyframe_idx not contiguous": F.max(~F.col("keyframe_idx").eqNullSafe(F.col("nth"))),
    }
    if "clip_idx" in manifest.columns:
        checks["clip_idx differs from keyframe_idx"] = F.max(~(F.col("clip_idx") + base).eqNullSafe(F.col("keyframe_idx")))
    found = rows.groupBy("video_id").agg(F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda e: e.isNotNull()).alias("errors"))
    empty = manifest.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(None).cast(manifest.schema["video_id"].dataType).alias("video_id"), F.lit("manifest is empty").alias("error"))
    return found.select("video_id", F.explode("errors").alias("error")).unionByName(empty)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def falls(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, n_falls): how often the value is smaller than the one before."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("fall", F.col(value) < F.lag(value).over(w)).groupBy(key).agg(F.count_if("fall").alias("n_falls"))


def not_contiguous(df: DataFrame, key: str, value: str, start: int = 1) -> DataFrame:
    """Keys whose values aren't start, start + 1 and so on."""
    return ordinal(df, key, value, name="nth", start=start).where(~F.col(value).eqNullSafe(F.col("nth"))).select(key).distinct()


def audit_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").alias("non_empty"))


def most_common(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


#: Rows among which a cut is sought by sorting them, and characters that a prefix grows by otherwise.
SORTED, STEP = 10_000, 2


def first_rows(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows of df, a written table, that come first by a column of strings, without a sort of all: counts by ever longer
    prefixes lead to the n-th row's value, and rows up to that are kept.  Nulls count as the empty string."""
    value = F.coalesce(F.col(column), F.lit(""))
    total, low, high = df.agg(F.count("*"), F.min(value), F.max(value)).first()
    if total <= n or n <= 0:
        return df if n > 0 else df.limit(0)
    prefix, left, size = os.path.commonprefix([low, high]), n, total
    while size > SORTED:
        inside = df.where(value.startswith(prefix))
        width = len(prefix) + STEP
        groups = sorted((r[0], r[1]) for r in inside.groupBy(F.substring(value, 1, width)).count().collect())  # a level of the tree of prefixes
        for prefix, size in groups:  # noqa: B007
            if left <= size:
                break
            left -= size
        if len(prefix) < width:  # a value that is no longer than that
            break
    last = prefix if size > SORTED else sorted(r[0] for r in df.where(value.startswith(prefix)).select(value).collect())[left - 1]
    before = df.where(value < last)
    return before.unionByName(df.where(value == last).limit(n - before.count()))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def resolve_videos(paths: DataFrame, path: str = "path") -> DataFrame:
    """(stem, path, n_paths): the first path of every stem; more than one are duplicates."""
    return paths.groupBy(stem(F.col(path)).alias("stem")).agg(F.min(path).alias("path"), F.count("*").alias("n_paths")).where("stem <> ''")


def object_paths(frames: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """frames with object_path: the JSON of the image's stem in its video's folder; '' without any.  Of several, that
    in root/video, then in root/objects/video, then in root/video/objects, then the first elsewhere by path whose
    folder is the video."""
    name = F.col("path")
    folder, above = parent(name), parent(F.regexp_extract(name, r"^(.*)/[^/]*$", 1))
    base = F.lit(root.rstrip("/").removeprefix("file:").replace("//", "/")) if root else None
    plain = F.regexp_replace(F.regexp_replace(name, "^file:", ""), "^/+", "/")
    at = lambda *parts: plain == F.concat_ws("/", base, *parts, F.concat(stem(name), F.lit(".json")))
    inside = (folder == "objects") & (above != "")
    video = F.when(inside, above).otherwise(folder)
    if root:
        place = F.when(at(folder), 0).when(at(F.lit("objects"), folder), 1).when(inside & at(above, F.lit("objects")), 2).otherwise(3)
    else:
        depth = F.length(name) - F.length(F.replace(name, F.lit("/"), F.lit("")))
        place = depth + inside.cast("int")
    placed = files.select(video.alias("video_id"), stem(name).alias("stem"), "path", place.alias("place"))
    if root:
        placed = placed.where((F.col("place") == 2) | ~inside)
    best = placed.groupBy("video_id", "stem").agg(F.min_by("path", F.struct("place", "path")).alias("object_path"))
    return frames.drop("object_path").withColumn("stem", stem(F.col("image_path"))).join(best, ["video_id", "stem"], "left").drop("stem").withColumn("object_path", F.coalesce("object_path", F.lit("")))


def media_documents(files: DataFrame, root: str) -> DataFrame:
    """(video_id, priority, text) of JSON files (path, content) that may describe a video: root/video.json, then
    root/media-info/video.json, root/video/media_info.json and root/video/video.json."""
    plain = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^/+", "/")
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    rest = F.substring(plain, len(base) + 2, 1 << 20)
    one = lambda pattern: F.regexp_extract(rest, pattern, 1)
    video = F.array(one(r"^([^/]+)\.json$"), one(r"^media-info/([^/]+)\.json$"), one(r"^([^/]+)/media_info\.json$"), one(r"^([^/]+)/\1\.json$"))
    inside = files.where(plain.startswith(base + "/"))
    each = inside.select(F.posexplode(video).alias("priority", "video_id"), F.col("content").cast("string").alias("text"))
    return each.where("video_id <> ''").select("video_id", "priority", "text")


def media_text(frames: DataFrame, media: DataFrame) -> DataFrame:
    """frames with metadata_text: the video's media document (video_id, priority, text) of lowest priority
    number that is valid JSON, as it stands; '' without any."""
    valid = media.where(F.expr("try_parse_json(text) IS NOT NULL"))
    best = valid.groupBy("video_id").agg(F.min_by(F.expr("to_json(parse_json(text))"), F.struct("priority", "text")).alias("metadata_text"))
    return frames.drop("metadata_text").join(best, "video_id", "left").withColumn("metadata_text", F.coalesce("metadata_text", F.lit("")))


def object_text(frames: DataFrame, files: DataFrame) -> DataFrame:
    """frames with object_text: the text of the JSON document (path, content) at object_path; '' without one."""
    texts = files.select(F.col("path").alias("object_path"), json_text(F.col("content").cast("string")).alias("object_text"))
    return frames.drop("object_text").join(texts, "object_path", "left").withColumn("object_text", F.coalesce("object_text", F.lit("")))


def ordered_matrix(manifest: DataFrame, vectors: DataFrame, dim: int = 512) -> DataFrame:
    """(row_id, video_id, keyframe_idx, embedding) of a manifest (video_id, keyframe_idx, clip_idx), by video and
    keyframe from 0: each row's vector is that of its clip_idx in vectors (video_id, pos, embedding).  Videos without
    vectors, indexes outside them and vectors of another width fail it, and up to fifty videos are named."""
    require(manifest, "video_id", "keyframe_idx", "clip_idx")
    have = vectors.groupBy("video_id").agg(F.count("*").alias("have"))
    found = manifest.select("video_id", "keyframe_idx", F.col("clip_idx").cast("long").alias("pos")).join(have, "video_id", "left")
    gathered = found.join(vectors.select("video_id", "pos", "embedding"), ["video_id", "pos"], "left")
    reason = F.when(F.col("have").isNull(), "missing vectors").when(F.col("embedding").isNull(), "clip_idx outside the matrix").when(F.size("embedding") != dim, f"width is not {dim}")
    wrong = gathered.select("video_id", reason.alias("reason")).where("reason IS NOT NULL").distinct().orderBy("video_id", "reason").limit(50).collect()
    if wrong:
        raise RuntimeError("; ".join(f"{r['video_id']}: {r['reason']}" for r in wrong))
    before = W.orderBy("video_id").rowsBetween(W.unboundedPreceding, -1)
    base = gathered.groupBy("video_id").agg(F.count("*").alias("n")).select("video_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = ordinal(gathered, "video_id", "keyframe_idx", "pos", name="nth").join(base, "video_id")
    return placed.select((F.col("base") + F.col("nth")).alias("row_id"), "video_id", "keyframe_idx", "embedding")
