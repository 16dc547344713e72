"""The audit of a whole dataset: inspections, a tolerant manifest, its integrity, a report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem
from ..operators import audit as a
from ..operators.manifest import first_rows, most_common
from ..sources import files, python_sources
from ..steps import written

FEATURES = (".npy", ".npz")
MAX_ROWS = 5_000_000


def read_config(spark: SparkSession, path: str) -> dict:
    """A YAML document of folders and settings; an empty one is {}."""
    import yaml

    return yaml.safe_load("\n".join(r[0] for r in spark.read.text(path).toLocalIterator())) or {}


def _inspected(found: DataFrame, inspect, names: str) -> dict:
    shown = inspect(a.sample(found)).cache()
    try:
        counts = {r["name"]: r["n"] for r in a.frequency(shown, names).collect()}
        samples = [r | {names: r[names][: a.SAMPLE_KEYS]} if names in r else r for r in a.rows(shown.orderBy("path"))]
        return {"count": found.count(), "samples": samples, "frequency": counts}
    finally:
        shown.unpersist()


def audit(spark: SparkSession, config: dict) -> tuple[dict, DataFrame]:
    """The summary of a dataset, of what config's keyframes_dir, clip_dir, mapping_dir, media_info_dir and objects_dir
    hold, and its manifest; audit.max_manifest_rows caps the images that the manifest takes, by path."""
    images = written(files.image_inventory(spark, config["keyframes_dir"]))
    headers = python_sources.feature_headers(files.inventory(spark, config["clip_dir"], FEATURES)).cache()
    mapped = files.contents(spark, config["mapping_dir"], (".csv",))
    none = spark.createDataFrame([], "path string, length long, content binary")
    objects = files.contents(spark, config["objects_dir"], (".json",)) if config.get("objects_dir") else none
    capped = first_rows(images, "keyframe_path", int((config.get("audit") or {}).get("max_manifest_rows", MAX_ROWS)))
    matrices = headers.where("error IS NULL AND suffix = '.npy' AND ndim = 2")
    features = matrices.groupBy(stem(F.col("path")).alias("video_id")).agg(F.min("path").alias("clip_path"), F.min_by(F.col("shape")[0], "path").alias("rows"))
    manifest, errors = a.manifest(capped, features, files.read_mapping_tolerant(spark, config["mapping_dir"]), objects)
    counted = manifest.agg(F.count("*").alias("rows"), F.count_distinct("video_id").alias("videos"), F.count_if(F.col("object_path") != "").alias("objects")).first()
    named = errors.orderBy("video_id", "error").cache()
    used = capped.agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos")).first()
    total = images.agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos")).first()
    summary = {
        "keyframes": {"total": total["n"], "videos": total["videos"], "top_videos_by_keyframes": [[r["video_id"], r["n"]] for r in most_common(images, "video_id").collect()]},
        "features": {"count": headers.select("path").distinct().count(), "samples": a.rows(a.sample(headers)), "errors": headers.where("error IS NOT NULL").count()},
        "mapping": _inspected(mapped, a.inspect_csv, "columns"),
        "media_info": _inspected(files.contents(spark, config["media_info_dir"], (".json",)), a.inspect_json, "keys"),
        "objects": _inspected(objects, a.inspect_json, "keys"),
        "integrity": {
            "videos_checked": used["videos"], "videos_with_manifest": counted["videos"], "keyframes_found": used["n"], "manifest_rows": counted["rows"], "object_matches": counted["objects"],
            "n_errors": named.count(), "errors": [f"{r['video_id']}: {r['error']}" for r in named.limit(1000).collect()],
        },
    }
    headers.unpersist()
    named.unpersist()
    if not used["n"]:
        summary["integrity"] |= {"n_errors": 1, "errors": ["no keyframes found"]}
    return summary, manifest


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file at a path of any file system that Spark reads."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write(spark: SparkSession, summary: dict, manifest: DataFrame, folder: str) -> None:
    """dataset_manifest as Parquet and CSV, dataset_audit.json and audit_report.txt."""
    ordered = manifest.orderBy("video_id", "keyframe_idx")
    ordered.write.mode("overwrite").parquet(f"{folder}/dataset_manifest.parquet")
    spark.read.parquet(f"{folder}/dataset_manifest.parquet").write.mode("overwrite").option("header", True).csv(f"{folder}/dataset_manifest.csv")
    write_text(spark, f"{folder}/dataset_audit.json", json.dumps(summary, ensure_ascii=False, indent=2))
    write_text(spark, f"{folder}/audit_report.txt", a.report(summary))
