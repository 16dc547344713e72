"""Scores of decoded frames for many queries at once: every frame is decoded once, and meets only the queries that want it.

Candidates' windows are merged per video by a sweep over their starts into disjoint runs of frames, and runs are cut into pieces
of `span` frames.  A piece is one task's work: the decoder is asked once for the frames that any of its candidates wants, in
ascending order, and each frame is scored against just the candidates whose windows hold it before the next is decoded, so
that a task holds one frame at a time.  Where more than `crowd` candidates want a piece they are dealt by a hash, and its
frames are decoded once for each of these parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .temporal import windows

#: Frames of a piece, and candidates that one pass over it serves.
SPAN, CROWD = 256, 4096

Decoder = Callable[[str, list[int]], Iterator[tuple[int, bytes]]]
Scorer = Callable[[bytes, list[dict]], list[float]]


def runs(spans: DataFrame) -> DataFrame:
    """(video_id, low, high, base) of closed intervals: base is the first frame of the run of overlapping or adjacent
    intervals that each belongs to.  Equal intervals are one row, so that a video has no more rows than frames times widths."""
    each = spans.select("video_id", "low", "high").distinct()
    order = W.partitionBy("video_id").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col("low") > reach + 1)
    marked = each.withColumn("fresh", F.when(fresh, F.col("low")))
    return marked.select("video_id", "low", "high", F.max("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("base"))


def pieces(rows: DataFrame, span: int = SPAN) -> DataFrame:
    """rows (video_id, ids, …) once for every piece (base, piece) of a run that holds some of their ids, with those ids as
    `ids`, and in `first` how many came before."""
    bounded = rows.where(F.size("ids") > 0).withColumn("low", F.col("ids")[0]).withColumn("high", F.element_at("ids", -1))
    placed = bounded.join(runs(bounded), ["video_id", "low", "high"])
    number = F.sequence(F.expr(f"(low - base) div {span}"), F.expr(f"(high - base) div {span}"))
    placed = placed.withColumn("piece", F.explode(number)).withColumn("from_", F.col("base") + F.col("piece") * span)
    placed = placed.withColumn("first", F.size(F.filter("ids", lambda x: x < F.col("from_"))))
    placed = placed.withColumn("ids", F.filter("ids", lambda x: (x >= F.col("from_")) & (x < F.col("from_") + span)))
    return placed.where(F.size("ids") > 0).drop("low", "high", "from_")


def score_decoded(
    candidates: DataFrame, videos: DataFrame, decoder: Callable[[], Decoder], scorer: Callable[[], Scorer], payload: tuple[str, ...] = ("query_text",),
    frame_counts: DataFrame | None = None, radius: int = 24, max_decode: int = 96, span: int = SPAN, crowd: int = CROWD,
) -> DataFrame:
    """(query_id, video_id, pos, frame_id, score, error) of the decoded frames in the windows of candidates (query_id,
    video_id, best_frame_id, payload); pos is a frame's place in its candidate's window.

    videos: (video_id, video_path).  decoder() is made once in a task and gives decode(path, ids), which yields (frame_id,
    content) in ascending order and ends with the video; scorer() gives score(content, payloads), one number for each of
    the candidates that want the frame, whose payloads are dicts of query_id and the payload columns.  What the decoder raises
    is a row per candidate of the piece, with an error and no frame; a scorer that gives another number of
    scores is an error of the job.  A candidate without a video has no row.  Equal (query_id, video_id) are one candidate.
    """
    given = ["query_id", *payload]
    rows = windows(candidates.select("query_id", "video_id", "best_frame_id", *payload), frame_counts, radius, max_decode)
    cut = pieces(rows.join(videos.select("video_id", "video_path"), "video_id"), span)
    parts = cut.groupBy("video_id", "base", "piece").agg(F.ceil(F.count("*") / crowd).alias("parts"))
    dealt = cut.join(parts, ["video_id", "base", "piece"]).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts"))
    models: list = []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not models:  # this function lives as long as its task
            models.extend((decoder(), scorer()))
        decode, score = models
        sizes = pdf["ids"].map(len).to_numpy()
        flat, owner = np.concatenate(pdf["ids"].to_numpy()).astype(np.int64), np.repeat(np.arange(len(pdf)), sizes)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + pdf["first"].to_numpy()[owner]
        order = np.argsort(flat, kind="stable")
        flat, owner, pos = flat[order], owner[order], pos[order]
        wanted, asked = np.unique(flat), pdf[given].to_dict("records")
        found = []
        try:
            for frame, content in decode(pdf["video_path"].iloc[0], wanted.tolist()):
                a, b = np.searchsorted(flat, frame), np.searchsorted(flat, frame, "right")
                if a < b:
                    found.append((a, b, _scored(score, content, [asked[i] for i in owner[a:b].tolist()])))
        except _Scorer as e:
            raise ValueError(str(e)) from e.__cause__
        except Exception as e:  # whatever an injected decoder raises belongs to its video
            return pd.DataFrame({"query_id": pdf["query_id"], "video_id": pdf["video_id"], "pos": None, "frame_id": None, "score": None, "error": f"{type(e).__name__}: {e}"})
        at = np.concatenate([np.arange(a, b) for a, b, _ in found]) if found else np.zeros(0, np.int64)
        of = owner[at]
        return pd.DataFrame({
            "query_id": pdf["query_id"].to_numpy()[of], "video_id": pdf["video_id"].to_numpy()[of], "pos": pos[at], "frame_id": flat[at],
            "score": np.concatenate([s for _, _, s in found]) if found else np.zeros(0), "error": None,
        })

    kind = candidates.schema["query_id"].dataType.simpleString()
    keys = ["video_id", "base", "piece", "part"]
    return dealt.groupBy(*keys).applyInPandas(run, f"query_id {kind}, video_id string, pos long, frame_id long, score double, error string")


class _Scorer(Exception):
    """What a scorer raised, told apart from what a decoder did."""


def _scored(score: Scorer, content: bytes, asked: list[dict]) -> np.ndarray:
    try:
        out = np.asarray(list(score(content, asked)), float)
    except Exception as e:
        raise _Scorer(f"the scorer failed: {e}") from e
    if len(out) != len(asked):
        raise _Scorer("the scorer must return one score per query of the frame")
    return out
