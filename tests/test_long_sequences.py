"""Islands and alignments of videos that are spread over tasks, against those that aren't."""

import random

import pytest

from framesieve.operators import temporal


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("gap,part", [(1, 1), (1, 4), (3, 7), (10, 5), (2, 1000)])
def test_islands(spark, gap, part):
    rng = random.Random(gap * part)
    data = [("hot", rng.randint(-300, 900), rng.random()) for _ in range(700)] + [(f"v{k}", rng.randint(0, 40), rng.random()) for k in range(5) for _ in range(12)]
    scores = spark.createDataFrame(data, "video_id string, frame_id long, score double")
    assert rows(temporal.islands_spread(scores, gap, part=part)) == rows(temporal.islands(scores, gap))
    assert temporal.islands_spread(scores.limit(0), gap, part=part).count() == 0


def test_one_video_over_tasks(spark):
    """One island of all of a video's frames, found in many parts."""
    scores = spark.range(200_000).selectExpr("'V' AS video_id", "id AS frame_id", "CAST(id % 1000 AS DOUBLE) AS score")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = temporal.islands_spread(scores, part=1000)
        assert [tuple(r) for r in made.collect()] == [("V", 0, 199_999, 99_999, 999.0)]
        parts = temporal.islands(scores.selectExpr("*", "floor(frame_id / 1000) AS part"), 1, ("video_id", "part"))
        assert parts.rdd.glom().map(len).filter(lambda n: n > 0).count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def matrix(spark, seed, sequences, length, events, holes=False):
    rng = random.Random(seed)
    data = [
        (s, e, 3 * p - 5, 100 * s + p, round(rng.choice([rng.random(), 0.5]), 3))
        for s in range(sequences) for p in range(length) for e in range(1, events + 1) if not holes or rng.random() < 0.6
    ]
    return data, spark.createDataFrame(data, "seq_id long, event_ord int, frame_pos long, frame_id long, score double")


@pytest.mark.parametrize("sep", [0, 1, 3])
@pytest.mark.parametrize("block", [1, 4, 1000])
def test_alignment(spark, sep, block):
    _, df = matrix(spark, sep, 4, 11, 4)
    short = temporal.align_long(df, 4, sep, block=block)
    assert [(a, b, round(c, 9)) for a, b, c in rows(short.select("seq_id", "frames", "score").withColumnsRenamed({"seq_id": "a", "frames": "b", "score": "c"}))] == [
        (a, b, round(c, 9)) for a, b, c in rows(temporal.align_events(df, 4, sep).withColumnsRenamed({"seq_id": "a", "frames": "b", "score": "c"}))
    ]


def test_alignment_with_holes(spark):
    data, df = matrix(spark, 9, 3, 9, 3, holes=True)
    made = {r.seq_id: (list(r.frames), r.score) for r in temporal.align_long(df, 3, 2, block=3).collect()}
    for s in range(3):
        places = sorted({p for q, _, p, _, _ in data if q == s})
        of = {(e, places.index(p)): (f, x) for q, e, p, f, x in data if q == s}
        best = max(((of[1, i][1] + of[2, j][1] + of[3, k][1], -k, -j, -i) for (e, i) in of if e == 1 for (f, j) in of if f == 2 and j >= i + 2 for (g, k) in of if g == 3 and k >= j + 2), default=None)
        assert (s in made) == (best is not None)
        if best:
            assert made[s][1] == pytest.approx(best[0])
            at = [places.index(next(p for q, e, p, g, _ in data if q == s and g == f)) for f in made[s][0]]
            assert at[1] >= at[0] + 2 and at[2] >= at[1] + 2 and sum(of[e + 1, a][1] for e, a in enumerate(at)) == pytest.approx(best[0])


def test_states_do_not_grow_with_events(spark, monkeypatch):
    _, df = matrix(spark, 2, 2, 30, 6)
    seen = []
    real = temporal.written
    monkeypatch.setattr(temporal, "written", lambda d: seen.append(d.schema.simpleString()) or real(d))
    assert temporal.align_long(df, 6, 1, block=8).count() == 2
    assert len(set(seen[1:])) == 1 and "array" not in seen[1]
    with pytest.raises(ValueError):
        temporal.align_long(df, 3, -1)
