"""Events in time: islands, peaks, event scores, windows of frames, monotonic alignment."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import TemporalScoreConfig
from ..functions.scores import minmax
from ..steps import written


def islands(scores: DataFrame, max_gap: int = 1, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """(keys, start_frame, end_frame, center_frame, score) of runs of frames at most max_gap apart."""
    order = W.partitionBy(*keys).orderBy("frame_id", "score")
    new = F.when(F.col("frame_id") - F.lag("frame_id").over(order) <= max_gap, 0).otherwise(1)
    numbered = scores.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.groupBy(*keys, "island").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"), F.max("score").alias("score"))
    return runs.select(*keys, "start_frame", "end_frame", F.expr("(start_frame + end_frame) div 2").alias("center_frame"), "score")


#: Frames of a part, or positions of a block, that one task handles of a long video or sequence.
PART = 65_536


def islands_spread(scores: DataFrame, max_gap: int = 1, keys: tuple[str, ...] = ("video_id",), part: int = PART) -> DataFrame:
    """What islands() gives, with every video spread over tasks by parts of its frames.  Runs that come near a part's ends,
    two of a part at most, are stitched over all parts; all others are whole where they are found."""
    width = max(part, 2 * max_gap + 1)
    rows = scores.withColumn("part", F.floor(F.col("frame_id") / width))
    runs = islands(rows.drop("island"), max_gap, (*keys, "part")).drop("center_frame")
    first = F.col("part") * width
    near = (F.col("start_frame") - (first - 1) <= max_gap) | (first + width - F.col("end_frame") <= max_gap)
    order = W.partitionBy(*keys).orderBy("start_frame")
    ends = runs.where(near)
    fresh = F.when(F.col("start_frame") - F.lag("end_frame").over(order) <= max_gap, 0).otherwise(1)
    ends = ends.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    stitched = ends.groupBy(*keys, "island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.max("score").alias("score"))
    names = [*keys, "start_frame", "end_frame", "score"]
    whole = runs.where(~near).select(*names).unionByName(stitched.select(*names))
    return whole.select(*keys, "start_frame", "end_frame", F.expr("(start_frame + end_frame) div 2").alias("center_frame"), "score")


def peak_frame(scores: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """The frame of the largest score; of equal ones the first by pos."""
    return scores.groupBy(*keys).agg(F.max_by("frame_id", F.struct("score", -F.col("pos"))).alias("peak_frame"), F.max("score").alias("peak_score"))


def event_score(scores: DataFrame, keys: tuple[str, ...] = ("video_id",), config: TemporalScoreConfig = TemporalScoreConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the top fraction of min-maxed scores, and a little of the peak's better neighbour.  carry: columns that
    are the same for all of a key's rows, and come along."""
    all_, order, best = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("pos"), W.partitionBy(*keys).orderBy(F.desc("x"), "pos")
    rows = scores.withColumn("x", minmax(F.col("score"), all_, 1e-8)).withColumn("n", F.count("*").over(all_))
    beside = F.greatest(F.coalesce(F.lag("x").over(order), F.lit(0.0)), F.coalesce(F.lead("x").over(order), F.lit(0.0)))
    rows = rows.withColumn("beside", beside).withColumn("nth", F.row_number().over(best))
    top = F.greatest(F.lit(1), F.ceil(config.top_fraction * F.col("n")))
    made = rows.groupBy(*keys).agg(F.avg(F.when(F.col("nth") <= top, F.col("x"))).alias("mean"), F.max(F.when(F.col("nth") == 1, F.col("beside"))).alias("beside"), *(F.any_value(c).alias(c) for c in carry))
    return made.select(*keys, *carry, (F.col("mean") + config.continuity * F.col("beside")).alias("event_score"))


def semantic_keyframe(scores: DataFrame, keys: tuple[str, ...], low: Column | None = None, high: Column | None = None) -> DataFrame:
    """The best frame within optional closed bounds, its score and its original position as rank."""
    inside = F.lit(True)
    inside = inside & (F.col("frame_id") >= low) if low is not None else inside
    inside = inside & (F.col("frame_id") <= high) if high is not None else inside
    best = F.max_by(F.struct("frame_id", "score", "pos"), F.struct("score", -F.col("pos")))
    return scores.where(inside).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.frame_id").alias("frame_id"), F.col("b.score").alias("score"), F.col("b.pos").alias("rank"))


def window_frames(center: Column, frame_count: Column, radius: int = 24, cap: int = 96) -> Column:
    """Frame ids within radius of the center, at most cap of them, evenly spread from the first to the last."""
    first, last = F.greatest(F.lit(0).cast("bigint"), center - radius), F.least(frame_count - 1, center + radius)
    n = last - first + 1
    step = (n - 1) / F.lit(float(max(cap - 1, 1)))
    spread = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: first + F.when((i == cap - 1) & F.lit(cap > 1), n - 1).otherwise(F.floor(i * step)))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= cap, F.sequence(first, last)).otherwise(spread)


def windows(candidates: DataFrame, frame_counts: DataFrame | None = None, radius: int = 24, max_decode: int = 96) -> DataFrame:
    """candidates with coarse_frame_id, frame_count (of unknown videos: as far as the window reaches) and ids, the frames
    of each one's window, at most max_decode of them, evenly spread."""
    rows = candidates.withColumn("coarse_frame_id", F.col("best_frame_id").cast("bigint"))
    reach = F.col("coarse_frame_id") + radius + 1
    if frame_counts is None:
        rows = rows.withColumn("frame_count", reach)
    else:
        counts = frame_counts.select("video_id", F.col("frame_count").cast("bigint").alias("frame_count"))
        rows = rows.drop("frame_count").join(counts, "video_id", "left").withColumn("frame_count", F.coalesce("frame_count", reach))
    return rows.withColumn("ids", window_frames(F.col("coarse_frame_id"), F.col("frame_count"), radius, max_decode))


def strided_frames(n: Column, step: int) -> Column:
    """Every step-th frame id of n frames; a negative count is an error."""
    if step <= 0:
        raise ValueError("step must be positive")
    n = F.when(n < 0, F.raise_error(F.lit("frame count must not be negative")).cast("bigint")).otherwise(n.cast("bigint"))
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(step).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def refine_window(scores: DataFrame, start: Column, end: Column, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """The best scored frame of each closed window, the first of equal ones; a window without any has no row."""
    return semantic_keyframe(scores, keys, start, end).select(*keys, "frame_id")


def localize(
    candidates: DataFrame, dense: DataFrame | None, config: TemporalScoreConfig = TemporalScoreConfig(), radius: int = 24,
    observed: DataFrame | None = None, max_decode: int = 96, frame_counts: DataFrame | None = None,
) -> DataFrame:
    """Localised events of candidates (query_id, video_id, best_frame_id, multimodal_score).

    A candidate's window is the frames within radius of its best one, cut at the video's ends where frame_counts
    (video_id, frame_count) has it; of these at most max_decode, evenly spread, are looked at.  With dense scores
    (query_id, video_id, pos, frame_id, score; without a query_id they hold for all queries): the peak over these,
    the island of the largest score, and the event score of the frames inside it; candidates without a scored frame in the
    window have no row.  Without: the whole window, its observed frame (video_id, frame_id) nearest to the best one, the
    earlier of two, and the multimodal score; without observed frames every frame of the window counts as observed.
    """
    keys = ("query_id", "video_id")
    rows = windows(candidates.select(*keys, "best_frame_id", "multimodal_score"), frame_counts, radius, max_decode)
    seen = rows.select(*keys, "coarse_frame_id", F.explode("ids").alias("frame_id"))
    if dense is None:
        near = seen if observed is None else seen.join(observed.select("video_id", F.col("frame_id").cast("bigint").alias("frame_id")).distinct(), ["video_id", "frame_id"])
        best = near.groupBy(*keys).agg(F.min_by("frame_id", F.struct(F.abs(F.col("frame_id") - F.col("coarse_frame_id")), "frame_id")).alias("semantic_keyframe"))
        start, end = F.greatest(F.lit(0).cast("bigint"), F.col("coarse_frame_id") - radius), F.least(F.col("frame_count") - 1, F.col("coarse_frame_id") + radius)
        return rows.join(best, list(keys)).select(*keys, "coarse_frame_id", start.alias("start_frame"), end.alias("end_frame"), "semantic_keyframe", F.col("multimodal_score").alias("score"))
    scores = dense.where("frame_id IS NOT NULL").withColumn("frame_id", F.col("frame_id").cast("bigint"))
    if "query_id" in dense.columns:
        near = scores.select(*keys, "pos", "frame_id", "score").join(rows.select(*keys, "coarse_frame_id", "ids"), list(keys)).where(F.array_contains("ids", F.col("frame_id"))).drop("ids")
    else:
        near = seen.join(scores.select("video_id", "pos", "frame_id", "score"), ["video_id", "frame_id"])
    # islands, the best of them, the peak and the event score are windows over one and the same partitioning
    each = W.partitionBy(*keys)
    order = each.orderBy("frame_id", "score")
    fresh = F.when(F.col("frame_id") - F.lag("frame_id").over(order) <= config.max_gap, 0).otherwise(1)
    near = near.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    island = W.partitionBy(*keys, "island")
    near = near.withColumns({"start_frame": F.min("frame_id").over(island), "end_frame": F.max("frame_id").over(island), "best": F.max("score").over(island)})
    near = near.withColumn("first", F.max(F.struct("best", (-F.col("start_frame")).alias("before"))).over(each))
    near = near.withColumn("semantic_keyframe", F.max(F.struct(F.col("score"), -F.col("pos"), "frame_id")).over(each)["frame_id"])
    inside = near.where(F.col("first")["best"].eqNullSafe(F.col("best")) & (F.col("first")["before"] == -F.col("start_frame")))
    made = event_score(inside, keys, config, ("coarse_frame_id", "start_frame", "end_frame", "semantic_keyframe"))
    return made.select(*keys, "coarse_frame_id", "start_frame", "end_frame", "semantic_keyframe", F.col("event_score").alias("score"))


def align_events(matrix: DataFrame, events: int, min_separation: int = 0, key: str = "seq_id") -> DataFrame:
    """(key, frames, score): for each sequence the frames of events 1..events that rise by at least
    min_separation positions and have the largest total score; one window per event, earliest on ties.
    matrix: (key, event_ord, frame_pos, frame_id, score).  A sequence without any such choice has no row."""
    if min_separation < 0:
        raise ValueError("min_separation must not be negative")
    state = matrix.where("event_ord = 1").select(key, "frame_pos", F.col("score").alias("dp"), F.array("frame_id").alias("path"))
    for e in range(2, events + 1):
        upto = W.partitionBy(key).orderBy("frame_pos").rowsBetween(W.unboundedPreceding, -min_separation if min_separation else 0)
        ahead = state.withColumn("best", F.max(F.struct(F.col("dp"), (-F.col("frame_pos")).alias("neg"), F.col("path"))).over(upto))
        here = matrix.where(F.col("event_ord") == e).select(key, "frame_pos", "frame_id", "score")
        joined = ahead.select(key, "frame_pos", "best").join(here, [key, "frame_pos"])
        # rows without a predecessor stay, as holes, so that positions keep counting rows
        state = joined.select(key, "frame_pos", (F.col("best.dp") + F.col("score")).alias("dp"), F.concat(F.col("best.path"), F.array("frame_id")).alias("path"))
        state = state.withColumn("dp", F.coalesce("dp", F.lit(-math.inf)))
    best = state.where(F.col("dp") > -math.inf).groupBy(key).agg(F.max_by(F.struct("path", "dp"), F.struct(F.col("dp"), -F.col("frame_pos"))).alias("b"))
    return best.select(key, F.col("b.path").alias("frames"), F.col("b.dp").alias("score"))


def _numbered(matrix: DataFrame, key: str, block: int) -> DataFrame:
    """matrix with at, the place of a position among its sequence's from 0, counted in two levels."""
    places = matrix.select(key, "frame_pos").distinct().withColumn("part", F.floor(F.col("frame_pos") / block))
    counts = places.groupBy(key, "part").agg(F.count("*").alias("n"))
    before = counts.select(key, "part", F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy(key, "part").orderBy("frame_pos"))
    placed = places.withColumn("inside", inside).join(before, [key, "part"]).select(key, "frame_pos", (F.col("before") + F.col("inside") - 1).alias("at"))
    return matrix.join(placed, [key, "frame_pos"])


def align_long(matrix: DataFrame, events: int, min_separation: int = 0, key: str = "seq_id", block: int = PART) -> DataFrame:
    """What align_events() gives, for sequences of any length and any number of events.

    An event's state is a score and a pointer for each position: to the best earlier position of the event before, found by
    maxima within blocks of positions and over the blocks before, so that neither a sequence nor its paths are one
    task's.  States are written, and the best path is read back along the pointers, one row of each sequence at a time.
    Positions are counted over all events, and one without a score for an event is none of that event's choices.
    """
    if min_separation < 0:
        raise ValueError("min_separation must not be negative")
    rows = written(_numbered(matrix.select(key, "event_ord", "frame_pos", "frame_id", "score"), key, block).drop("frame_pos"))
    best = F.struct("dp", (-F.col("at")).alias("before"))
    state, pointers = rows.where("event_ord = 1").select(key, "at", F.col("score").alias("dp")), []
    for e in range(2, events + 1):
        cut = state.withColumn("block", F.floor(F.col("at") / block))
        inside = F.max(best).over(W.partitionBy(key, "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
        tops = cut.groupBy(key, "block").agg(F.max(best).alias("top"))
        ahead = tops.select(key, "block", F.max("top").over(W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("ahead"))
        upto = cut.withColumn("inside", inside).join(ahead, [key, "block"]).select(key, "at", F.greatest("inside", "ahead").alias("best"))
        # the best up to a position holds until the next one that is scored
        here = rows.where(F.col("event_ord") == e).select(key, "at", "score")
        made = _latest(upto, here, min_separation, key, block)
        pointers.append(written(made.select(key, "at", (F.col("best.dp") + F.col("score")).alias("dp"), (-F.col("best.before")).alias("from_"))))
        state = pointers[-1].select(key, "at", "dp")
    last = state.groupBy(key).agg(F.max(best).alias("b")).select(key, (-F.col("b.before")).alias("at"), F.col("b.dp").alias("dp"))
    path, steps = last.select(key, "at"), []
    for e in range(events, 0, -1):
        steps.append(path.select(key, F.lit(e).alias("event_ord"), "at"))
        if e > 1:
            path = path.join(pointers[e - 2], [key, "at"]).select(key, F.col("from_").alias("at"))
    chosen = reduce(DataFrame.unionByName, steps).join(rows, [key, "event_ord", "at"])
    frames = chosen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_ord", "frame_id"))), lambda c: c["frame_id"]).alias("frames"))
    return frames.join(last.select(key, F.col("dp").alias("score")), key)


def _latest(upto: DataFrame, here: DataFrame, shift: int, key: str, block: int) -> DataFrame:
    """here (key, at, score) with the best of the last row of upto (key, at, best) that is at least shift before; rows
    without any are left out.  Looked for within blocks, and else the last of the blocks before."""
    moved = upto.select(key, (F.col("at") + shift).alias("at"), "best", F.lit(None).cast("double").alias("score"), F.lit(0).alias("asks"))
    asking = here.select(key, "at", F.lit(None).cast(upto.schema["best"].dataType).alias("best"), F.col("score").cast("double").alias("score"), F.lit(1).alias("asks"))
    both = moved.unionByName(asking).withColumn("block", F.floor(F.col("at") / block))
    inside = F.last("best", ignorenulls=True).over(W.partitionBy(key, "block").orderBy("at", "asks").rowsBetween(W.unboundedPreceding, 0))
    tops = both.where("asks = 0").groupBy(key, "block").agg(F.max_by("best", "at").alias("top"))
    every = both.select(key, "block").distinct().join(tops, [key, "block"], "left")
    ahead = every.select(key, "block", F.last("top", ignorenulls=True).over(W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("ahead"))
    found = both.withColumn("inside", inside).where("asks = 1").join(ahead, [key, "block"]).withColumn("best", F.coalesce("inside", "ahead"))
    return found.where("best IS NOT NULL").select(key, "at", "score", "best")
