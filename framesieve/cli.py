"""Commands over files; each prints one JSON line."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce
from io import BytesIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import RetrieveConfig
from .functions.text import stem, task_type
from .functions.vector import normalized
from .operators import manifest as m
from .operators import cells, evidence, search
from .plans import audit, pipeline
from .schemas import EVIDENCE, GROUND_TRUTH, VIDEO_MANIFEST
from .sources import containers, files, models, python_sources
from .steps import written


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framesieve")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, required: tuple[str, ...], optional: dict[str, object] | None = None) -> None:
        c = sub.add_parser(name)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        for o, default in (optional or {}).items():
            if isinstance(default, bool):
                c.add_argument(f"--{o}", action="store_true")
            elif isinstance(default, list):
                c.add_argument(f"--{o}", action="append", default=default)
            else:
                c.add_argument(f"--{o}", default=default, type=type(default) if default is not None else str)

    # fixed values: where files lie that are used if they exist
    dbs = {f"{kind}-db": f"artifacts/{kind}.sqlite" for kind in STORES}
    stores = dbs | {"evidence-index": None, "evidence-rrf-k": 60}
    support = {"media-info-dir": "data/media_info", "objects-dir": "data/objects"}
    window = {"videos-dir": None, "video-manifest": None, "radius-frames": 24, "max-decode-frames": 96, "fine-score": False}
    channel = {"second-channel": False, "second-weight": 0.35}
    index = {"index": None, "metadata": None}
    command("video-manifest", ("video-dir", "output"), {"report-output": None, "extension": []})
    command("dataset-index", ("clip-dir", "mapping-dir", "keyframes-dir", "output-manifest"), {"objects-dir": None, "dim": 512, "output-embeddings": None, "report-output": None})
    command("build-index", ("manifest", "output-index"), {"metadata-output": None, "cells": 0})
    command("inspect-evidence", ("db",))
    command("evidence-index", ("name",), dbs)
    command("retrieve", ("manifest", "query", "output"), stores | support | window | channel | index | {"query-translated": None, "query-embedding": None, "top-k": 100})
    command("benchmark", ("queries", "manifest", "output-dir"), stores | support | window | channel | index | {"query-column": "Trans", "ground-truth": None, "localize-top-k": 0, "frame-tolerance": 10, "top-k": 100})
    command("benchmark-unified", ("queries", "manifest", "output-dir"), stores | support | window | channel | index | {"query-column": "Description", "translated-query-column": "Trans", "task-prefix": [], "top-k": 100})
    command("ground-truth-template", ("queries", "output"), {"query-column": "Description"})
    command("ordered-matrix", ("manifest", "clip-dir", "output"), {"report": None, "dim": 512})
    command("index-diagnostics", ("index",), {"metadata": None})
    command("validate", ("manifest",), {"base": 0})
    command("audit", ("config",))
    return p


#: Kinds of evidence stores, in the order in which they are read.
STORES = ("asr", "ocr", "caption")


def _modalities(spark: SparkSession, a) -> list[str]:
    """The stores whose files exist."""
    return [kind for kind in STORES if getattr(a, f"{kind}_db") and files.exists(spark, getattr(a, f"{kind}_db"))]


def _evidence(spark: SparkSession, a):
    """The index that is named, or a function that gives the texts about videos of all stores whose files exist; None
    without any."""
    if a.evidence_index:
        return evidence.read(spark, a.evidence_index)
    stores = [(kind, getattr(a, f"{kind}_db")) for kind in _modalities(spark, a)]
    if not stores:
        return None

    def of(videos):
        made = [
            python_sources.evidence_of(videos, path, kind) if path.endswith((".db", ".sqlite")) else files.read_json_evidence(spark, path, kind).join(videos, "video_id", "left_semi").select(*EVIDENCE.names)
            for kind, path in stores
        ]
        return reduce(DataFrame.unionByName, made)

    return of


def _evidence_index(spark, a, *_) -> int:
    """Writes the inverted index of all stores whose files exist, as tables of that name."""
    python_sources.register(spark)
    read = lambda kind, path: spark.read.format("sqlite_evidence").option("modality", kind).load(path) if path.endswith((".db", ".sqlite")) else files.read_json_evidence(spark, path, kind)
    kinds = _modalities(spark, a)
    if not kinds:
        raise SystemExit("evidence-index needs a store")
    evidence.write(evidence.build(reduce(DataFrame.unionByName, (read(kind, getattr(a, f"{kind}_db")) for kind in kinds))), a.name)
    made = evidence.read(spark, a.name)
    _say(name=a.name, postings=made.postings.count(), videos=made.present.select("video_id").distinct().count(), evidence_modalities=kinds)
    return 0


def _support(spark: SparkSession, a) -> dict[str, bool]:
    """Whether there are folders of object and media documents."""
    return {f"{name}_enabled": bool(path) and files.exists(spark, path) for name, path in (("metadata", a.media_info_dir), ("objects", a.objects_dir))}


def _supported(frames, a):
    """frames with the texts of object and media documents, where their folders are given."""
    spark = frames.sparkSession
    there = _support(spark, a)
    if there["objects_enabled"]:
        if "object_path" not in frames.columns or not frames.where("object_path <> ''").limit(1).count():
            frames = m.object_paths(frames, files.inventory(spark, a.objects_dir, (".json",)), a.objects_dir)
        frames = m.object_text(frames, files.contents(spark, a.objects_dir, (".json",)))
    if there["metadata_enabled"]:
        frames = m.media_text(frames, m.media_documents(files.contents(spark, a.media_info_dir, (".json",)), a.media_info_dir))
    return frames


def _videos(spark: SparkSession, root: str, suffixes: tuple[str, ...] = files.VIDEOS):
    """(video_id, video_path) of a folder's videos: the first path of every name."""
    found = m.resolve_videos(files.inventory(spark, root, suffixes))
    return found.select(F.col("stem").alias("video_id"), F.col("path").alias("video_path"))


def _window_sources(spark: SparkSession, a, prober):
    """(videos, frame_counts) of the commands that look into videos; both None where neither option is given."""
    videos = _videos(spark, a.videos_dir) if a.videos_dir else None
    if a.video_manifest:
        known = spark.read.option("header", True).schema(T.StructType(VIDEO_MANIFEST.fields[:-1])).csv(a.video_manifest)
        return videos if videos is not None else known.select("video_id", "video_path"), known.select("video_id", "frame_count")
    if videos is None:
        return None, None
    return videos, models.probe_videos(videos, prober or containers.prober).where("frame_count > 0").select("video_id", "frame_count")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, encoder=models.hashing_encoder, prober=None, decoder=None, scorer=None, second_encoder=None) -> int:
    """encoder(dim), decoder and scorer stand for the text model, the video decoder and the scorer of decoded frames
    (operators.decoding), which are injected; without a prober videos' own headers are read.  second_encoder(queries, text,
    out) adds the second channel's vectors, as models.encode_ids does; without it they come from encoder, too."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("framesieve").getOrCreate()
    return _COMMANDS[a.command](spark, a, encoder, prober, decoder, scorer, second_encoder)


def _say(**x) -> None:
    print(json.dumps(x, ensure_ascii=False))


def _report(spark: SparkSession, path: str | None, **x) -> None:
    if path:
        audit.write_text(spark, path, json.dumps(x, ensure_ascii=False, indent=2))
    _say(**x)


def _inspect_evidence(spark, a, *_) -> int:
    _say(**python_sources.inspect_sqlite(a.db))
    return 0


def _video_manifest(spark, a, encoder, prober, *_) -> int:
    suffixes = tuple("." + e.lower().lstrip(".") for e in a.extension) or files.VIDEOS
    found = files.inventory(spark, a.video_dir, suffixes).select(stem(F.col("path")).alias("video_id"), F.col("path").alias("video_path"))
    made = written(models.probe_videos(found, prober or containers.prober))
    made.where("error IS NULL").drop("error").orderBy(F.lower("video_path"), "video_path").coalesce(1).write.mode("overwrite").option("header", True).csv(a.output)
    errors = [f"{r['video_path']}: {r['error']}" for r in made.where("error IS NOT NULL").orderBy("video_path").limit(1000).collect()]
    _report(spark, a.report_output, found=made.count(), indexed=made.where("error IS NULL").count(), errors=errors)
    return 0


def _dataset_index(spark, a, *_) -> int:
    python_sources.register(spark)
    vectors = spark.read.format("npy").option("dim", a.dim).load(a.clip_dir)
    images = files.image_inventory(spark, a.keyframes_dir, (".jpg", ".jpeg", ".png"))
    images = m.ordinal(images, "video_id", m.numeric_name("keyframe_name"), "keyframe_name").select("video_id", "pos", F.col("keyframe_path").alias("image_path"))
    made = m.build_index(vectors, files.read_mapping(spark, a.mapping_dir), images, a.dim)
    if a.objects_dir:
        made = m.object_paths(made, files.inventory(spark, a.objects_dir, (".json",)), a.objects_dir)
    made.write.mode("overwrite").parquet(a.output_manifest)
    made = spark.read.parquet(a.output_manifest)
    if a.output_embeddings:
        _npy(made, a.output_embeddings, a.dim)
    found = made.agg(F.count("*").alias("rows"), F.count_distinct("video_id").alias("videos"), (F.count_if(F.col("object_path") != "") if "object_path" in made.columns else F.lit(0)).alias("object_matches")).first()
    _report(spark, a.report_output, dimension=a.dim, **found.asDict())
    return 0


def _npy(rows, path: str, dim: int) -> None:
    """One NPY matrix in order of row_id, for programs that read such files."""
    rows.select("row_id", "embedding").repartitionByRange("row_id").sortWithinPartitions("row_id").write.format("npy_matrix").option("dim", dim).option("path", path).mode("append").save()


def _build_index(spark, a, *_) -> int:
    """The manifest's unit vectors as one table or, with cells, as an index that searches read in part."""
    made = files.read_table(spark, a.manifest).withColumn("embedding", normalized(F.col("embedding")).cast("array<float>"))
    if a.cells:
        cells.build(made, a.output_index, a.cells)
    else:
        made.write.mode("overwrite").parquet(a.output_index)
    found = search.index_contract(_index(spark, a.output_index)).first().asDict()
    meta = {"rows": found["size"], "dimension": found["dim_max"], "metric": found["metric"], "backend": "cells" if a.cells else "parquet"}
    _report(spark, a.metadata_output, **meta)
    return 0


def _in_cells(spark, path: str) -> bool:
    return files.exists(spark, f"{path}/cells")


def _index(spark, path: str):
    """The vectors of an index of either form."""
    return spark.read.parquet(f"{path}/vectors").drop("cell") if _in_cells(spark, path) else spark.read.parquet(path)


def _metadata(spark, path: str | None) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect())) if path else {}


def _index_diagnostics(spark, a, *_) -> int:
    rows = _index(spark, a.index)
    search.check_index(rows, _metadata(spark, a.metadata))
    _say(**search.index_contract(rows).first().asDict())
    return 0


def _ordered_matrix(spark, a, *_) -> int:
    python_sources.register(spark)
    manifest = files.read_table(spark, a.manifest)
    made = m.ordered_matrix(manifest, spark.read.format("npy").option("dim", a.dim).load(a.clip_dir), a.dim)
    _npy(made, a.output, a.dim)
    found = manifest.agg(F.count("*").alias("rows"), F.count_distinct("video_id").alias("videos")).first()
    _report(spark, a.report, manifest_rows=found["rows"], embedding_shape=[found["rows"], a.dim], dtype="float32", videos=found["videos"])
    return 0


def _config(a) -> RetrieveConfig:
    return RetrieveConfig(rrf_k=a.evidence_rrf_k, radius=a.radius_frames, max_decode=a.max_decode_frames, channel2_weight=getattr(a, "second_weight", 0.35))


def _answers(spark, a, queries, encoder, prober, decoder, scorer, second_encoder, localize_top_k: int | None, k: int):
    """Answers to queries (query_id, query_text[, translated][, vector])."""
    frames, searcher = _index(spark, a.index) if a.index else files.read_table(spark, a.manifest), None
    if a.index and _in_cells(spark, a.index):
        searcher = lambda asked, k, carry: cells.search(spark, a.index, asked, k, carry=carry).hits
    if a.index:
        search.check_index(frames, _metadata(spark, a.metadata), files.read_table(spark, a.manifest).count())
    dim = len(frames.select("embedding").first()["embedding"])
    encode = lambda df, text, out: models.encode_text(df, text, lambda: encoder(dim), out)
    config = _config(a)
    if "vector" not in queries.columns:
        queries = encode(queries, "query_text", "vector")
        if "translated" in queries.columns:
            queries = pipeline.translated(encode(queries, "translated", "translated_vector"), config)
    second = None
    if a.second_channel:
        wide = len(frames.select("embedding2").first()["embedding2"])
        by = second_encoder or (lambda df, text, out: models.encode_text(df, text, lambda: encoder(wide), out))
        second = by(queries.select("query_id", "query_text"), "query_text", "vector").select("query_id", "vector")
    videos, counts = _window_sources(spark, a, prober)
    fine = None
    if a.fine_score:
        if decoder is None or scorer is None or videos is None:
            raise SystemExit("fine-score needs videos (videos-dir or video-manifest), a decoder and a scorer")
        score = pipeline.fine_scorer(videos, decoder, scorer, ("query_text", "vector"), counts, config)
        fine = lambda head: score(head.join(queries.select("query_id", "vector"), "query_id"))
    return pipeline.run(
        _supported(frames, a), queries, k, evidence=_evidence(spark, a), second=second, config=config, localize_top_k=localize_top_k, frame_counts=counts, fine=fine, stores=None if a.evidence_index else tuple(_modalities(spark, a)), searcher=searcher,
    )


def _retrieve(spark, a, *models_) -> int:
    queries = spark.createDataFrame([("query", a.query, a.query_translated or "")], "query_id string, query_text string, translated string")
    if a.query_embedding:
        data = bytes(spark.read.format("binaryFile").load(a.query_embedding).first()["content"])
        vector = np.load(BytesIO(data), allow_pickle=False).reshape(-1)
        text = F.when(F.trim("translated") != "", F.col("translated")).otherwise(F.col("query_text"))
        queries = queries.select("query_id", text.alias("query_text"), F.array(*(F.lit(float(x)) for x in vector)).alias("vector"))
    made = _answers(spark, a, queries, *models_, None, a.top_k)
    made.orderBy("rank").coalesce(1).write.mode("overwrite").json(a.output)
    _say(
        rows=spark.read.schema("rank int").json(a.output).count(), output=a.output, fine_score=a.fine_score, evidence_modalities=_modalities(spark, a), **_support(spark, a),
        translated_query_enabled=bool(a.query_translated), evidence_rrf_k=a.evidence_rrf_k, second_channel_enabled=a.second_channel, second_weight=a.second_weight if a.second_channel else 0.0,
    )
    return 0


def _benchmark(spark, a, *models_) -> int:
    queries = files.read_queries(spark, a.queries, a.query_column).select("query_id", "query_text")
    made = _answers(spark, a, queries, *models_, a.localize_top_k, a.top_k)
    made.write.mode("overwrite").partitionBy("query_id").json(f"{a.output_dir}/results")
    made = spark.read.json(f"{a.output_dir}/results").withColumn("query_id", F.col("query_id").cast("string"))
    truth = files.read_ground_truth(spark, a.ground_truth) if a.ground_truth else spark.createDataFrame([], GROUND_TRUTH)
    each, total = pipeline.benchmark(made, truth, a.frame_tolerance)
    each.coalesce(1).write.mode("overwrite").json(f"{a.output_dir}/per_query")
    _report(spark, f"{a.output_dir}/summary.json", output=a.output_dir, **total.first().asDict())
    return 0


def _benchmark_unified(spark, a, *models_) -> int:
    """Answers for every query of an organizer's sheet, with its translation where there is one."""
    queries = files.read_queries(spark, a.queries, a.query_column, a.translated_query_column, a.task_prefix or None)
    k = min(max(a.top_k, 1), 100)
    made = _answers(spark, a, queries, *models_, None, k)
    made.write.mode("overwrite").partitionBy("query_id").json(f"{a.output_dir}/results")
    _say(
        queries=queries.count(), output_dir=a.output_dir, top_k=k, translated_query=queries.where("translated <> ''").limit(1).count() > 0, evidence_modalities=_modalities(spark, a),
        fine_score=a.fine_score, **_support(spark, a),
    )
    return 0


def _template(spark, a, *_) -> int:
    queries = files.read_queries(spark, a.queries, a.query_column)
    files.ground_truth_template(queries, task_type).coalesce(1).write.mode("overwrite").json(a.output)
    _say(counts={r[0]: r[1] for r in queries.groupBy(task_type(F.col("query_id"))).count().collect()})
    return 0


def _validate(spark, a, *_) -> int:
    errors = [f"{r[0]}: {r[1]}" for r in m.validate(files.read_table(spark, a.manifest), a.base).orderBy("video_id", "error").limit(100).collect()]
    _say(errors=errors)
    return int(bool(errors))


def _audit(spark, a, *_) -> int:
    config = audit.read_config(spark, a.config)
    summary, manifest = audit.audit(spark, config)
    audit.write(spark, summary, manifest, config["artifacts_dir"])
    _say(**summary)
    return 0


_COMMANDS = {
    "video-manifest": _video_manifest, "dataset-index": _dataset_index, "build-index": _build_index, "inspect-evidence": _inspect_evidence, "evidence-index": _evidence_index, "retrieve": _retrieve, "benchmark": _benchmark,
    "benchmark-unified": _benchmark_unified, "ground-truth-template": _template, "ordered-matrix": _ordered_matrix, "index-diagnostics": _index_diagnostics, "validate": _validate, "audit": _audit,
}


if __name__ == "__main__":
    sys.exit(main())
