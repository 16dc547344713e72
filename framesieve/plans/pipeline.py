"""Whole retrieval plans, for any number of queries at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RetrieveConfig, frame_budget
from ..functions.vector import combined
from ..operators import decoding, evaluate, fuse, search, temporal
from ..steps import written


def translated(queries: DataFrame, config: RetrieveConfig = RetrieveConfig()) -> DataFrame:
    """(query_id, query_text, vector) of queries with translated and translated_vector: where the translation isn't
    blank it is the text that is scored, and the vector is the unit vector of both, weighted."""
    there = F.trim(F.coalesce("translated", F.lit(""))) != ""
    both = combined(F.col("vector"), F.coalesce("translated_vector", "vector"), *config.translated)
    return queries.select("query_id", F.when(there, F.col("translated")).otherwise(F.col("query_text")).alias("query_text"), F.when(there, both).otherwise(F.col("vector").cast("array<double>")).alias("vector"))


#: Candidates whose keys are broadcast to look up texts of their frames; more are joined by a shuffle of both.
LOOKED_UP = 500_000


def _texts(frames: DataFrame, videos: DataFrame, names: list[str]) -> DataFrame:
    """videos with the texts of their best frames, '' where there are none: of several rows of a frame the first by row_id
    counts.  Only the frames that candidates name are grouped."""
    keys = ["video_id", "best_frame_id"]
    wanted = videos.select(*keys).distinct()
    wanted = F.broadcast(wanted) if videos.count() <= LOOKED_UP else wanted
    named = frames.select("video_id", F.col("original_frame_id").alias("best_frame_id"), "row_id", *names).join(wanted, keys, "left_semi")
    first = named.groupBy(*keys).agg(F.min_by(F.struct(*names), "row_id").alias("first"))
    return videos.join(first, keys, "left").select(*videos.columns, *(F.coalesce(F.col(f"first.{c}"), F.lit("")).alias(c) for c in names))


def retrieve(frames: DataFrame, queries: DataFrame, evidence=None, second: DataFrame | None = None, config: RetrieveConfig = RetrieveConfig(), stores: tuple[str, ...] | None = None, searcher=None) -> DataFrame:
    """Ranked candidates (query_id, video_id, …, rank_score, rank) of queries (query_id, query_text, vector).

    frames: the frame table, with object_text and metadata_text where known; of several rows for a candidate's
    frame the first by row_id counts.  evidence: texts or their index (operators.evidence).  second: queries' vectors for a
    second embedding column, embedding2.  stores: names of the evidence stores, for those without rows.  searcher(queries,
    top_k, carry) gives the hits of the first channel where an index has them; else all frames are searched.
    """
    texts = [c for c in ("object_text", "metadata_text") if c in frames.columns]
    carry = ("video_id", "keyframe_idx", "original_frame_id", "pts_time")
    hits = searcher(queries, config.top_k_frames, carry) if searcher else search.search_batch(frames, queries, config.top_k_frames, carry=carry)
    videos = search.video_evidence(hits, config.per_video_k, ("query_id",))
    if second is not None:
        hits2 = search.search_batch(frames, second, config.top_k_frames, "embedding2", carry)
        videos2 = search.video_evidence(hits2, config.channel2_k, ("query_id",), "channel2").drop("channel2_score_std")
        videos = fuse.fuse_channels(videos, videos2, config.channel2_weight)
    if texts:
        videos = _texts(frames, written(videos), texts)
    videos = videos.withColumns({c: F.lit("") for c in ("object_text", "metadata_text") if c not in texts})
    fused = fuse.multimodal(videos.join(queries.select("query_id", "query_text"), "query_id"), evidence, config.fusion, config.rrf_k, stores)
    return fuse.submission(fuse.rerank(fused.withColumn("temporal_score", F.lit(0.0)), config.ranking), config.top_k_videos)


def run(
    frames: DataFrame, queries: DataFrame, k: int = 100, dense: DataFrame | None = None, evidence=None, second: DataFrame | None = None,
    config: RetrieveConfig = RetrieveConfig(), localize_top_k: int | None = None, frame_counts: DataFrame | None = None, fine=None, stores: tuple[str, ...] | None = None, searcher=None,
) -> DataFrame:
    """retrieve, localise (all, or the first localize_top_k of each query), rerank over the survivors.

    dense: scores of decoded frames (query_id, video_id, pos, frame_id, score); fine(candidates) gives them for the
    candidates that are localised, as fine_scorer() does.  Without either the known keyframes count as the frames observed
    in a candidate's window.  A candidate without any keeps its best frame, and a temporal score of 0.  Candidates are
    written once, and read by every later step.
    """
    n_frames, n_videos = frame_budget(k)
    config = replace(config, top_k_frames=n_frames, top_k_videos=n_videos)
    found = written(retrieve(frames, queries, evidence, second, config, stores, searcher).drop("rank_score", "temporal_score").withColumnRenamed("rank", "first_rank"))
    head = found if localize_top_k is None else found.where(F.col("first_rank") <= localize_top_k)
    if fine is not None:
        dense = fine(head)
    observed = frames.select("video_id", F.col("original_frame_id").alias("frame_id"))
    events = temporal.localize(head, dense, config.temporal, config.radius, observed, config.max_decode, frame_counts)
    located = found.join(events.withColumnRenamed("score", "temporal_score"), ["query_id", "video_id"], "left")
    located = located.withColumn("semantic_keyframe", F.coalesce("semantic_keyframe", "best_frame_id")).withColumn("temporal_score", F.coalesce("temporal_score", F.lit(0.0)))
    return fuse.submission(fuse.rerank(located, config.ranking), k)


def fine_scorer(videos: DataFrame, decoder, scorer, payload: tuple[str, ...] = ("query_text",), frame_counts: DataFrame | None = None, config: RetrieveConfig = RetrieveConfig()):
    """A function from candidates to the scores of the decoded frames of their windows, for run(): videos (video_id,
    video_path), and the factories that operators.decoding takes."""
    return lambda candidates: decoding.score_decoded(candidates, videos, decoder, scorer, payload, frame_counts, config.radius, config.max_decode)


def benchmark(ranked: DataFrame, truth: DataFrame, tolerance: int = 10, ks: tuple[int, ...] = evaluate.KS) -> tuple[DataFrame, DataFrame]:
    """Per-query results and their summary, of ranked answers and ground truth (query_id, video_ids, frames)."""
    joined = ranked.join(truth, "query_id", "left")
    frame = F.coalesce(F.col("semantic_keyframe"), F.col("best_frame_id")) if "semantic_keyframe" in ranked.columns else F.col("best_frame_id")
    graded = joined.select(
        "query_id", "rank", "rank_score", F.coalesce(F.array_contains("video_ids", F.col("video_id")), F.lit(False)).alias("relevant"),
        evaluate.frame_hit(frame, F.col("frames")[F.col("video_id")], tolerance).alias("frame_hit"), F.col("video_ids").isNotNull().alias("has_ground_truth"),
    )
    each = evaluate.per_query(graded, ks)
    return each, evaluate.summary(each, ks)


class Engine:
    """Everything that a query needs, bound once: frames, evidence, models and settings; queries come many at a time."""

    def __init__(self, frames: DataFrame, encode, evidence=None, fine=None, frame_counts: DataFrame | None = None, config: RetrieveConfig = RetrieveConfig()):
        """encode(queries, text, out) adds a vector column; fine(candidates) gives the scores of decoded frames (query_id,
        video_id, pos, frame_id, score), where a decoder and a scorer are at hand (fine_scorer)."""
        self.frames, self.encode, self.evidence, self.fine, self.frame_counts, self.config = frames, encode, evidence, fine, frame_counts, config

    def answer(self, queries: DataFrame, k: int = 100) -> DataFrame:
        """Answers of queries (query_id, query_text[, translated]), at most a hundred of each."""
        asked = self.encode(queries, "query_text", "vector")
        if "translated" in queries.columns:
            asked = translated(self.encode(asked, "translated", "translated_vector"), self.config)
        k = min(max(k, 1), 100)
        return run(self.frames, asked, k, evidence=self.evidence, config=self.config, frame_counts=self.frame_counts, fine=self.fine)
