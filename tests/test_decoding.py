"""Frames scored for many queries, decoders over readers that lie, and the commands that look into videos."""

import collections
import json
import random
import sys

import pytest
from pyspark import cloudpickle

from framesieve import cli
from framesieve.operators import decoding, temporal
from framesieve.plans import pipeline
from framesieve.sources import decoder, models
from test_containers import mp4

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests

CANDIDATES = "query_id string, video_id string, best_frame_id long, multimodal_score double, query_text string"


def logged(path):
    """A decoder that notes every frame that it decodes; videos have 1,000 frames, one is broken."""

    def made():
        def decode(video, ids):
            if "broken" in video:
                raise OSError("broken file")
            for i in ids:
                if i >= 1000:
                    return
                with open(path, "a") as f:
                    f.write(f"{video} {i}\n")
                yield i, str(i).encode()

        return decode

    return made


def near_peak(content, asked):
    """Best at the frame that the query names."""
    return [-abs(int(content) - int(a["query_text"])) for a in asked]


def brute(candidates, radius, cap):
    out = {}
    for q, v, best, _, text in candidates:
        low, high = max(0, best - radius), best + radius
        n = high - low + 1
        ids = range(low, high + 1) if n <= cap else [low + (n - 1 if i == cap - 1 else int(i * ((n - 1) / (cap - 1)))) for i in range(cap)]
        for pos, i in enumerate(ids):
            if i < 1000:
                out[q, v, i] = (pos, float(-abs(i - int(text))))
    return out


@pytest.mark.parametrize("span,crowd", [(256, 4096), (7, 4096), (1, 4096), (64, 3)])
def test_every_frame_once_and_only_for_its_queries(spark, tmp_path, span, crowd):
    rng = random.Random(span)
    rows = [(f"q{k}", f"V{rng.randint(0, 3)}", rng.choice([0, 5, 100, 130, 131, 500, 990, 2000]), 0.5, str(rng.randint(0, 999))) for k in range(40)]
    rows = list({r[:2]: r for r in rows}.values()) + [("q99", "nowhere", 1, 0.5, "1")]
    candidates = spark.createDataFrame(rows, CANDIDATES)
    videos = spark.createDataFrame([(f"V{k}", f"/v/V{k}.mp4") for k in range(4)], "video_id string, video_path string")
    made = decoding.score_decoded(candidates, videos, logged(str(tmp_path / "log")), lambda: near_peak, radius=24, max_decode=30, span=span, crowd=crowd).collect()
    wanted = brute(rows[:-1], 24, 30)
    assert {(r.query_id, r.video_id, r.frame_id): (r.pos, r.score) for r in made} == wanted and len(made) == len(wanted)
    times = collections.Counter((tmp_path / "log").read_text().split("\n")[:-1])
    assert set(times) == {f"/v/{v}.mp4 {i}" for _, v, i in wanted}
    if crowd > 40:
        assert max(times.values()) == 1
    else:
        assert max(times.values()) > 1  # a crowd is served in parts


def test_queries_keep_their_own_peaks(spark, tmp_path):
    rows = [("a", "V", 10, 0.5, "9"), ("b", "V", 10, 0.5, "11"), ("c", "W", 10, 0.5, "3")]
    candidates = spark.createDataFrame(rows, CANDIDATES)
    videos = spark.createDataFrame([("V", "V"), ("W", "broken")], "video_id string, video_path string")
    dense = decoding.score_decoded(candidates, videos, logged(str(tmp_path / "log")), lambda: near_peak)
    errors = dense.where("error IS NOT NULL").collect()
    assert [(r.query_id, r.frame_id, r.error) for r in errors] == [("c", None, "OSError: broken file")]
    found = {r.query_id: (r.semantic_keyframe, r.start_frame, r.end_frame) for r in temporal.localize(candidates, dense).collect()}
    assert found == {"a": (9, 0, 34), "b": (11, 0, 34)}
    with pytest.raises(Exception, match="one score per query"):
        decoding.score_decoded(candidates, videos, logged(str(tmp_path / "log")), lambda: lambda content, asked: [1.0] * (len(asked) + 1)).collect()
    empty = decoding.score_decoded(candidates.limit(0), videos, logged(str(tmp_path / "log")), lambda: near_peak)
    assert temporal.localize(candidates.limit(0), empty).count() == 0


def test_runs(spark):
    rows = [("V", 0, 5), ("V", 0, 5), ("V", 3, 4), ("V", 6, 9), ("V", 11, 12), ("W", 1, 100), ("W", 50, 60), ("W", 90, 120)]
    made = {(r.video_id, r.low, r.high): r.base for r in decoding.runs(spark.createDataFrame(rows, "video_id string, low long, high long")).collect()}
    assert made == {("V", 0, 5): 0, ("V", 3, 4): 0, ("V", 6, 9): 0, ("V", 11, 12): 11, ("W", 1, 100): 1, ("W", 50, 60): 1, ("W", 90, 120): 1}


def test_run_with_frame_scores(spark, tmp_path):
    rows = [(0, "V1", 0, 30, 1.0, [1.0, 0.0]), (1, "V2", 0, 60, 2.0, [0.9, 0.1]), (2, "V3", 0, 90, 2.0, [0.0, 1.0])]
    frames = spark.createDataFrame(rows, "row_id long, video_id string, keyframe_idx long, original_frame_id long, pts_time double, embedding array<float>")
    queries = spark.createDataFrame([("a", "33", [1.0, 0.0]), ("b", "66", [1.0, 0.1])], "query_id string, query_text string, vector array<float>")
    videos = spark.createDataFrame([("V1", "V1"), ("V2", "V2")], "video_id string, video_path string")
    counts = spark.createDataFrame([("V1", 40), ("V2", 1000)], "video_id string, frame_count long")
    fine = pipeline.fine_scorer(videos, logged(str(tmp_path / "log")), lambda: near_peak, frame_counts=counts)
    made = {(r.query_id, r.video_id): r for r in pipeline.run(frames, queries, 10, fine=fine, frame_counts=counts, localize_top_k=2).collect()}
    assert len(made) == 6 and made["a", "V1"].semantic_keyframe == 33 and made["b", "V2"].semantic_keyframe == 66 and made["a", "V1"].end_frame == 39
    assert made["a", "V3"].semantic_keyframe == 90 and made["a", "V3"].temporal_score == 0  # not localised
    assert max(collections.Counter((tmp_path / "log").read_text().split("\n")[:-1]).values()) == 1


class Lying:
    """A video of 300 numbered frames whose seeks do as told: exact, off, deaf, or silent about where they are."""

    def __init__(self, by_frame, by_time, fps=25.0):
        self.by_frame, self.by_time, self.fps, self.at, self.opened = by_frame, by_time, fps, 0, True
        self.read_ = 0

    def seek_frame(self, frame):
        return self._seek(self.by_frame, frame)

    def seek_seconds(self, seconds):
        return self._seek(self.by_time, int(seconds * (self.fps or 30.0)))

    def _seek(self, how, frame):
        self.at = {"exact": frame, "near": frame + 3, "far": frame + 200, "before": frame - 2, "refused": 0, "unsure": frame, "deaf": 0}[how]
        self.silent = how == "unsure"
        return how not in ("refused", "deaf")

    def position(self):
        return -1.0 if getattr(self, "silent", False) else float(self.at)

    def read(self):
        assert self.opened
        self.read_ += 1
        self.at += 1
        return str(self.at - 1).encode() if self.at <= 300 else None

    def close(self):
        self.opened = False


@pytest.mark.parametrize("by_frame", ["exact", "near", "far", "before", "refused", "unsure", "deaf"])
@pytest.mark.parametrize("by_time", ["exact", "far", "before", "refused", "unsure"])
def test_selective_decoder(by_frame, by_time):
    made = []

    def opened(path):
        made.append(Lying(by_frame, by_time, 0.0 if path == "slow" else 25.0))
        return made[-1]

    decode = decoder.selective(opened)
    for path in ("fast", "slow"):
        made.clear()
        wanted = [103, 100, 250, 100, -4, 299, 305]
        frames = list(decode(path, wanted))
        first = 103 if by_frame == "near" else 100
        assert frames == [(i, str(i).encode()) for i in (100, 103, 250, 299) if i >= first]
        assert not any(r.opened for r in made)
        whole = sum(r.read_ for r in made) > 240  # began at the first frame
        assert whole == (by_frame not in ("exact", "near", "before") and by_time not in ("exact", "before"))
    assert list(decode("fast", [])) == [] and list(decode("fast", [-1])) == [] and list(decode("fast", [400])) == []


def test_commands_with_videos(spark, tmp_path, capsys):
    (tmp_path / "v/sub").mkdir(parents=True)
    for name, n in (("V1", 50), ("V2", 500)):
        (tmp_path / f"v/sub/{name}.mp4").write_bytes(mp4(n))
    (tmp_path / "v/V9.mkv").write_bytes(b"not a video")
    frames = spark.createDataFrame([(0, "V1", 0, 45, 1.0, "a.jpg", [1.0, 0.0]), (1, "V2", 0, 60, 2.0, "b.jpg", [0.6, 0.8])], "row_id long, video_id string, keyframe_idx long, original_frame_id long, pts_time double, image_path string, embedding array<float>")
    frames.write.parquet(str(tmp_path / "frames.parquet"))
    assert cli.main(["video-manifest", "--video-dir", str(tmp_path / "v"), "--output", str(tmp_path / "m"), "--report-output", str(tmp_path / "m.json")], spark) == 0
    report = json.loads((tmp_path / "m.json").read_text())
    assert (report["found"], report["indexed"]) == (3, 2) and "V9.mkv: neither" in report["errors"][0]
    known = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "m")).orderBy("video_id").collect()
    assert [(r.video_id, r.frame_count, r.fps, r.width, r.height, r.duration_sec) for r in known] == [("V1", 50, 25.0, 320, 240, 2.0), ("V2", 500, 25.0, 320, 240, 20.0)]
    assert cli.main(["video-manifest", "--video-dir", str(tmp_path / "v"), "--output", str(tmp_path / "m2"), "--extension", "MKV"], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["found"] == 1
    args = ["--manifest", str(tmp_path / "frames.parquet"), "--query", "48"]
    for source in (["--videos-dir", str(tmp_path / "v")], ["--video-manifest", str(tmp_path / "m")]):
        out = str(tmp_path / source[0])
        assert cli.main(["retrieve", *args, *source, "--output", out], spark) == 0
        assert {r.video_id: r.end_frame for r in spark.read.json(out).collect()} == {"V1": 49, "V2": 84}
        decode = logged(str(tmp_path / "log"))
        assert cli.main(["retrieve", *args, *source, "--fine-score", "--output", out], spark, decoder=decode, scorer=lambda: near_peak) == 0
        assert {r.video_id: r.semantic_keyframe for r in spark.read.json(out).collect()} == {"V1": 48, "V2": 48}
    with pytest.raises(SystemExit):
        cli.main(["retrieve", *args, "--fine-score", "--output", str(tmp_path / "x")], spark, decoder=decode, scorer=lambda: near_peak)


def test_embedding_scorer():
    score = models.embedding_scorer(lambda: lambda content: [len(content), 0.0])()
    assert score(b"abc", [{"vector": [2.0, 0.0]}, {"vector": [0.0, 5.0]}, {"vector": [-1.0, 0.0]}]).tolist() == [1.0, 0.0, -1.0]
    with pytest.raises(ValueError, match="zero-norm"):
        score(b"abc", [{"vector": [0.0, 0.0]}])


def test_windows_are_dealt_without_contents(spark):
    """Only ids, payloads and keys are shuffled before frames are decoded."""
    candidates = spark.createDataFrame([("a", "V", 10, 0.5, "9")], CANDIDATES)
    videos = spark.createDataFrame([("V", "V")], "video_id string, video_path string")
    plan = decoding.score_decoded(candidates, videos, lambda: None, lambda: None)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
