"""Hand-computed cases of the retrieval operators."""

import json
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve import cli
from framesieve.config import RankingWeights, RetrieveConfig, frame_budget
from framesieve.functions import scores as S
from framesieve.functions import text as X
from framesieve.operators import evaluate, fuse, manifest, search, temporal
from framesieve.operators.jsontext import flatten
from framesieve.plans import pipeline
from framesieve.sources import files, models, python_sources


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(0, "V1", 0, 0, 0.0, "V1/0000.jpg", [1.0, 0.0]), (1, "V1", 1, 30, 1.0, "V1/0001.jpg", [0.8, 0.6]), (2, "V2", 0, 0, 0.0, "V2/0000.jpg", [0.0, 1.0])]
    return spark.createDataFrame(rows, "row_id long, video_id string, keyframe_idx long, original_frame_id long, pts_time double, image_path string, embedding array<float>")


def test_search(spark, frames):
    hits = search.search_frames(frames, [1.0, 0.0], 2)
    found = hits.collect()
    assert [(r.video_id, r.original_frame_id) for r in found] == [("V1", 0), ("V1", 30)]
    videos = search.search_videos(search.search_frames(frames, [1.0, 0.0], 3), "max", top_k=2).collect()
    assert videos[0].video_id == "V1" and videos[0].best_frame_id == 0
    with pytest.raises(Exception, match="differ in width"):
        search.search_frames(frames, [1.0, 0.0, 0.0], 2).collect()
    with pytest.raises(ValueError):
        search.search_videos(hits, "median")
    asked = spark.createDataFrame([(f"q{i}", [1.0, 0.1 * i]) for i in range(5)], "query_id string, vector array<float>")
    many = search.search_batch(frames, asked, 2)
    old, search.BLOCK, search.TILE = (search.BLOCK, search.TILE), 2, 1
    try:
        blocks = search.search_batch(frames, asked, 2)
    finally:
        search.BLOCK, search.TILE = old
    same = lambda df: sorted((r.query_id, r.row_id, round(r.score, 12), r["rank"]) for r in df.collect())
    assert same(many) == same(blocks) and many.count() == 10
    assert search.search_batch(frames, asked.limit(0), 2).count() == 0
    zero = spark.createDataFrame([(9, "V3", 0, 0, 0.0, "", [0.0, 0.0])], frames.schema)
    with pytest.raises(Exception, match="zero-norm"):
        search.search_batch(frames.unionByName(zero), asked, 2).collect()
    with pytest.raises(ValueError, match="zero-norm"):
        search.search_batch(frames, spark.createDataFrame([("q", [0.0, 0.0])], asked.schema), 2)
    per_query = search.search_videos(search.search_batch(frames, asked, 3).join(frames.drop("embedding"), "row_id"), "max", top_k=1, keys=("query_id",))
    assert per_query.count() == 5
    assert search.check_index(frames, {"rows": 3, "dimension": 2, "metric": "inner_product"}, 3) is frames
    for bad, rows in (({"rows": 4}, None), ({"dimension": 3}, None), ({"metric": "l2"}, None), ({}, 4)):
        with pytest.raises(ValueError):
            search.check_index(frames, bad, rows)
    with pytest.raises(ValueError, match="ids"):
        search.check_index(frames.where("row_id > 0"), {})


def test_video_evidence(spark):
    rows = [("V1", 3, 30, 1.0, 0.95, "o3", 0), ("V1", 4, 40, 1.3, 0.90, "o4", 1), ("V1", 5, 50, 1.6, 0.85, "o5", 2), ("V2", 1, 10, 0.3, 0.94, "o1", 3)]
    hits = spark.createDataFrame(rows, "video_id string, keyframe_idx long, original_frame_id long, pts_time double, score double, object_path string, row_id long")
    v1 = search.video_evidence(hits, 2).where("video_id = 'V1'").first()
    assert v1.best_frame_id == 30 and v1.object_path == "o3"
    assert v1.retrieval_topk_mean == pytest.approx(0.925) and v1.retrieval_score == pytest.approx(0.94375)


def test_rerank_and_submission(spark):
    df = spark.createDataFrame([("q", "V1", 0.9, 0.1, 0.1), ("q", "V2", 0.8, 0.9, 0.9)], "query_id string, video_id string, retrieval_score double, temporal_score double, multimodal_score double")
    first = lambda w: fuse.submission(fuse.rerank(df, w), 1).first().video_id
    assert first(RankingWeights()) == "V1"
    assert first(RankingWeights(0.45, 0.15, 0.40)) == "V2"
    with pytest.raises(ValueError):
        fuse.submission(df.withColumn("rank_score", F.lit(1.0)), 0)
    assert frame_budget(3) == (1000, 3) and frame_budget(500) == (5000, 100)
    with pytest.raises(ValueError):
        RetrieveConfig(channel2_weight=2)


def test_multimodal_by_hand(spark):
    """Three videos of one query.  Retrieval 0.9, 0.5, 0.1 become 1, 0.5, 0; overlaps with objects and metadata count as
    they are; of the evidence ranks 1/61 and 1/62 and none become 1, 61/62 and 0."""
    c = spark.createDataFrame(
        [("q", "A", "red car", 0.9, "a car", "", 10), ("q", "B", "red car", 0.5, "", "red car race", 10), ("q", "C", "red car", 0.1, "red car", "blue", 10)],
        "query_id string, video_id string, query_text string, retrieval_score double, object_text string, metadata_text string, best_frame_id long",
    )
    stores = [("asr", "B", 10, "the red car"), ("asr", "A", 10, "one car"), ("asr", "A", 100, "red car"), ("ocr", "Z", 1, "red")]
    evidence = spark.createDataFrame(stores, "modality string, video_id string, frame_id long, text string")
    made = {r.video_id: r for r in fuse.multimodal(c, evidence).collect()}
    assert made["A"].fused_score == pytest.approx(0.70 * 1 + 0.10 * 0.5 + 0.15 * ((1 / 62) / (1 / 61)))
    assert made["B"].fused_score == pytest.approx(0.70 * 0.5 + 0.05 * 1 + 0.15 * 1)
    assert made["C"].fused_score == pytest.approx(0.10 * 1)
    assert made["A"].evidence_modalities == "asr,ocr" and made["A"].object_score == 0.5
    alone = {r.video_id: r.fused_score for r in fuse.multimodal(c, None).collect()}
    assert alone["B"] == pytest.approx(0.70 * 0.5 + 0.05 * 1)


def test_localize_by_hand(spark):
    c = spark.createDataFrame([("q", "V", 5, 0.4), ("q", "W", 50, 0.6), ("q", "X", 9, 0.1)], "query_id string, video_id string, best_frame_id long, multimodal_score double")
    seen = spark.createDataFrame([("V", 3), ("V", 7), ("V", 90), ("W", 30), ("W", 55), ("X", 400)], "video_id string, frame_id long")
    counts = spark.createDataFrame([("V", 20), ("W", 53)], "video_id string, frame_count long")
    made = {r.video_id: tuple(r)[2:] for r in temporal.localize(c, None, observed=seen, frame_counts=counts).collect()}
    # V: frames 0 to 19, 3 and 7 are as near, the earlier counts; W: 26 to 52, so that 55 is outside; X: none observed
    assert made == {"V": (5, 0, 19, 3, 0.4), "W": (50, 26, 52, 30, 0.6)}
    whole = {r.video_id: tuple(r)[2:] for r in temporal.localize(c.where("video_id = 'W'"), None, radius=2).collect()}
    assert whole == {"W": (50, 48, 52, 50, 0.6)}
    dense = spark.createDataFrame([("V", f, f, float(f == 6)) for f in range(0, 11)], "video_id string, pos long, frame_id long, score double")
    few = temporal.localize(c.where("video_id = 'V'"), dense, radius=5, max_decode=3).first()  # looks at 0, 5 and 10 only
    assert (few.semantic_keyframe, few.start_frame, few.end_frame) == (0, 0, 0)
    every = temporal.localize(c.where("video_id = 'V'"), dense, radius=5).first()
    assert (every.semantic_keyframe, every.start_frame, every.end_frame) == (6, 0, 10)


def test_first_match(spark):
    rows = [(0, "V", 0, 30, 0.0, [1.0, 0.0], "car"), (1, "V", 1, 30, 1.0, [0.9, 0.1], "boat")]
    frames = spark.createDataFrame(rows, "row_id long, video_id string, keyframe_idx long, original_frame_id long, pts_time double, embedding array<float>, object_text string")
    asked = spark.createDataFrame([("q", "car", [1.0, 0.0])], "query_id string, query_text string, vector array<float>")
    made = pipeline.retrieve(frames, asked).collect()
    assert [(r.video_id, r.object_text, r.object_score) for r in made] == [("V", "car", 1.0)]


def test_translated(spark):
    asked = spark.createDataFrame([("a", "xe", [1.0, 0.0], "car", [0.0, 1.0]), ("b", "xe", [1.0, 0.0], " ", None)], "query_id string, query_text string, vector array<float>, translated string, translated_vector array<float>")
    made = {r.query_id: r for r in pipeline.translated(asked).collect()}
    assert made["a"].query_text == "car" and made["a"].vector == pytest.approx([0.2 / 0.68**0.5, 0.8 / 0.68**0.5])
    assert made["b"].query_text == "xe" and list(made["b"].vector) == [1.0, 0.0]
    frames = spark.createDataFrame([(0, "V", 0, 0, 0.0, [1.0, 0.0]), (1, "W", 0, 0, 0.0, [0.0, 1.0])], "row_id long, video_id string, keyframe_idx long, original_frame_id long, pts_time double, embedding array<float>")
    vectors = {"xe": [1.0, 0.0], "car": [0.0, 1.0]}
    encode = lambda df, text, out: models.encode_text(df, text, lambda: lambda ts: np.array([vectors.get(t, [1.0, 1.0]) for t in ts]), out)
    first = {r.query_id: r.video_id for r in pipeline.Engine(frames, encode).answer(asked.select("query_id", "query_text", "translated"), 500).where("rank = 1").collect()}
    assert first == {"a": "W", "b": "V"}


def test_text(spark):
    row = spark.range(1).select(X.lexical_overlap(F.lit("red car"), F.lit("A red car appears")).alias("a"), X.lexical_overlap(F.lit(""), F.lit("x")).alias("b"), X.task_type(F.lit("TKIS-1")).alias("c"), X.task_type(F.lit("vkis-1")).alias("d")).first()
    assert tuple(row) == (1.0, 0.0, "TKIS", "UNKNOWN")
    assert flatten('{"label":"car","n":1,"x":[{"name":"a b"},"dropped"]}') == "car a b"
    assert flatten("[" * 5000 + '{"name":"x"}' + "]" * 5000) in ("x", "") and flatten('{"a":{"b":[{"Class":7},{"text":true}]}}') == "7 True"
    assert flatten('{"detection_class_names":["person"]}') == "" and flatten('{"detection_class_names":["person"]}', True) == "person" and flatten("{") == ""


def test_scores(spark):
    slope = spark.range(1).select(S.logistic_gradient(F.lit(0.0)), S.logistic_gradient(F.lit(-99.0)), S.logistic_gradient(F.lit(2.0))).first()
    assert tuple(slope) == pytest.approx((0.5, 1 / (1 + np.exp(-40)), 1 / (1 + np.exp(2))))
    names = spark.createDataFrame([("f12",), ("7",)], "n string").select(manifest.trailing_number(F.col("n"))).collect()
    assert [r[0] for r in names] == [12, 7]
    with pytest.raises(Exception, match="no trailing number"):
        spark.range(1).select(manifest.trailing_number(F.lit("x"))).collect()
    iv = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in ((95, 105), (145, 155), (195, 205), (245, 255))))
    fr = F.array(*(F.lit(x) for x in (101, 156, 203, 251)))
    row = spark.range(1).select(
        S.kis(F.lit("a"), F.lit(505), F.lit("a"), F.lit(500), F.lit(510)).alias("a"), S.kis(F.lit("a"), F.lit(600), F.lit("a"), F.lit(500), F.lit(510)).alias("b"),
        S.qa(F.lit("a"), F.lit(505), F.lit(" Màu Xanh"), F.lit("a"), F.lit(500), F.lit(510), F.lit("màu xanh")).alias("c"),
        S.trake(F.lit("a"), fr, F.lit("a"), iv).alias("d"), S.trake(F.lit("b"), fr, F.lit("a"), iv).alias("e"),
    ).first()
    assert tuple(row) == (1.0, 0.0, 1.0, 0.75, 0.0)
    ranked = spark.createDataFrame([("q", i + 1, s) for i, s in enumerate([0.5, 0.0, 0.8] + [0.0] * 11 + [0.6])], "query_id string, rank int, r_score double")
    made = evaluate.ranking_profile(ranked).first()
    assert (made.r_at_1, made.r_at_5, made.r_at_100) == (0.5, 0.8, 0.8) and made.final_score == pytest.approx(0.74)
    with pytest.raises(ValueError):
        evaluate.r_at(0)


def test_temporal(spark):
    scores = spark.createDataFrame([("v", p, f, s) for p, (f, s) in enumerate(zip((10, 11, 12, 20), (0.2, 0.9, 0.5, 0.7), strict=True))], "video_id string, pos long, frame_id long, score double")
    assert [tuple(r)[1:] for r in temporal.islands(scores).orderBy(F.desc("score")).collect()] == [(10, 12, 11, 0.9), (20, 20, 20, 0.7)]
    assert temporal.peak_frame(scores).first().peak_frame == 11
    three = lambda *s: spark.createDataFrame([("v", i, i, float(x)) for i, x in enumerate(s)], "video_id string, pos long, frame_id long, score double")
    assert temporal.event_score(three(0, 1, 0)).first().event_score == pytest.approx(1.0)
    assert temporal.event_score(three(0.8, 1, 0.7)).first().event_score == pytest.approx(1 + 0.05 / 3)
    matrix = [[0.9, 0.2, 0.1, 0], [0, 0.3, 0.8, 0.2], [0, 0.1, 0.2, 0.95]]
    long = spark.createDataFrame([("s", e + 1, f, 10 + f, float(x)) for e, row in enumerate(matrix) for f, x in enumerate(row)], "seq_id string, event_ord int, frame_pos long, frame_id long, score double")
    assert temporal.align_events(long, 3, 1).first().frames == [10, 12, 13]
    assert temporal.align_events(long, 3, 3).count() == 0
    ids = spark.range(1).select(temporal.window_frames(F.lit(5).cast("bigint"), F.lit(100).cast("bigint"), 24, 96).alias("a"), temporal.window_frames(F.lit(500).cast("bigint"), F.lit(1000).cast("bigint"), 100, 7).alias("b"), temporal.strided_frames(F.lit(0), 2).alias("c")).first()
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(temporal.strided_frames(F.lit(-1), 2)).collect()
    assert temporal.refine_window(scores, F.lit(12), F.lit(30)).first().frame_id == 20 and temporal.refine_window(scores, F.lit(30), F.lit(40)).count() == 0
    with pytest.raises(ValueError):
        temporal.align_events(long, 3, -1)
    assert spark.range(1).select(temporal.strided_frames(F.lit(5), 2).alias("x")).first().x == [0, 2, 4]
    assert ids.a == list(range(0, 30)) and ids.b == [400 + int(x) for x in np.linspace(0, 200, 7, dtype=int)] and ids.c == []


@pytest.mark.parametrize("sep", [0, 1, 2])
def test_alignment_against_brute_force(spark, sep):
    rng = np.random.default_rng(sep)
    m = rng.integers(0, 5, (3, 7)).astype(float)
    long = spark.createDataFrame([("s", e + 1, f, f, float(m[e, f])) for e in range(3) for f in range(7)], "seq_id string, event_ord int, frame_pos long, frame_id long, score double")
    best = max(m[0, a] + m[1, b] + m[2, c] for a in range(7) for b in range(a + sep, 7) for c in range(b + sep, 7))
    assert temporal.align_events(long, 3, sep).first().score == best


def test_pairwise_ranker():
    x = [[0.9, 0.9, 0.85, 0.02, 0.8, 0.9], [0.4, 0.4, 0.35, 0.04, 0.3, 0.2], [0.2, 0.2, 0.15, 0.03, 0.1, 0.1]]
    w, mean, std = fuse.fit_pairwise(x, [2, 1, 0], epochs=20)
    s = ((np.array(x) - mean) / std) @ np.array(w)
    assert list(np.argsort(-s)) == [0, 1, 2]
    for wrong in ([1, 1, 1], [1, 0]):
        with pytest.raises(ValueError):
            fuse.fit_pairwise(x, wrong)


def test_pipeline_and_benchmark(spark, frames):
    queries = spark.createDataFrame([("q1", "red car", [1.0, 0.0]), ("q2", "blue", [0.0, 1.0])], "query_id string, query_text string, vector array<float>")
    evidence = spark.createDataFrame([("asr", "V1", 0, "a red car"), ("ocr", "V2", None, "blue sky")], "modality string, video_id string, frame_id long, text string")
    made = pipeline.run(frames.withColumn("embedding2", F.col("embedding")), queries, 10, evidence=evidence, second=queries.select("query_id", "vector"), localize_top_k=1)
    first = {r.query_id: r.video_id for r in made.where("rank = 1").collect()}
    assert first == {"q1": "V1", "q2": "V2"}
    truth = spark.createDataFrame([("q1", ["V1"], {"V1": [0]}, {})], "query_id string, video_ids array<string>, frames map<string,array<bigint>>, intervals map<string,array<array<bigint>>>")
    each, total = pipeline.benchmark(made, truth)
    assert total.first().mrr == 1.0 and total.first().with_ground_truth == 1 and each.where("query_id = 'q2'").first().mrr is None


def test_sources_and_commands(spark, tmp_path, capsys):
    for d in ("clip", "map", "keys/V001", "objects/V001"):
        (tmp_path / d).mkdir(parents=True)
    np.save(tmp_path / "clip/V001.npy", np.array([[1, 0], [0, 1]], np.float16))
    (tmp_path / "map/V001.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,30.0,0\n2,1.5,30.0,45\n")
    for n in ("001", "002"):
        (tmp_path / f"keys/V001/{n}.JPG").write_bytes(b"x")
    (tmp_path / "objects/V001/001.json").write_text("{}")
    out = tmp_path / "manifest.parquet"
    args = ["dataset-index", "--clip-dir", str(tmp_path / "clip"), "--mapping-dir", str(tmp_path / "map"), "--keyframes-dir", str(tmp_path / "keys"), "--objects-dir", str(tmp_path / "objects"), "--output-manifest", str(out), "--dim", "2"]
    assert cli.main(args, spark) == 0
    rows = spark.read.parquet(str(out)).orderBy("row_id").collect()
    assert [(r.original_frame_id, r.keyframe_idx) for r in rows] == [(0, 1), (45, 2)] and rows[0].object_path.endswith("001.json") and rows[1].object_path == ""
    assert cli.main(["validate", "--manifest", str(out), "--base", "1"], spark) == 0 and cli.main(["validate", "--manifest", str(out)], spark) == 1
    (tmp_path / "map/V001.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,30.0,0\n")
    with pytest.raises(RuntimeError, match="V001"):
        cli.main(args, spark)
    assert cli.main(["build-index", "--manifest", str(out), "--output-index", str(tmp_path / "index.parquet"), "--metadata-output", str(tmp_path / "index.json")], spark) == 0
    assert json.loads((tmp_path / "index.json").read_text()) == {"rows": 2, "dimension": 2, "metric": "inner_product", "backend": "parquet"}
    assert cli.main(["index-diagnostics", "--index", str(tmp_path / "index.parquet"), "--metadata", str(tmp_path / "index.json")], spark) == 0
    db = tmp_path / "asr.db"
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE t (vid TEXT, frame_idx TEXT, transcript TEXT)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [("V001", "12", "red car"), ("V001", "x", None)])
    python_sources.register(spark)
    found = spark.read.format("sqlite_evidence").load(str(db)).collect()
    assert [(r.video_id, r.frame_id, r.text) for r in found] == [("V001", 12, "red car"), ("V001", None, None)]
    (tmp_path / "e.jsonl").write_text('{"video":"V1","frame_idx":"7","caption":"sky"}\n\nbroken\n{"video_id":"V2","text":null}\n')
    got = files.read_json_evidence(spark, str(tmp_path / "e.jsonl"), "ocr").collect()
    assert [(r.video_id, r.frame_id, r.text) for r in got] == [("V1", 7, "sky"), ("V2", None, "None")]
    (tmp_path / "q.csv").write_text("Query Name,Description\nqa-1,what\nqa-1,again\ntkis-2,  \ntrake-3,then\n")
    assert [r.query_id for r in files.read_queries(spark, str(tmp_path / "q.csv")).collect()] == ["qa-1", "trake-3"]
    with zipfile.ZipFile(tmp_path / "q.xlsx", "w") as z:
        cell = lambda r, c, t: f'<c r="{c}{r}" t="inlineStr"><is><t>{t}</t></is></c>'
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row>' + cell(1, "A", "id") + cell(1, "C", "Description") + "</row><row>" + cell(2, "A", "q") + cell(2, "C", "text") + "</row></sheetData></worksheet>")
    assert files.read_queries(spark, str(tmp_path / "q.xlsx")).first().query_text == "text"
    (tmp_path / "gt.json").write_text(json.dumps({"qa-1": {"video_ids": ["V001"], "intervals": {"V001": [[0, 9]]}}}))
    assert tuple(files.ground_truth_intervals(files.read_ground_truth(spark, str(tmp_path / "gt.json"))).first()) == ("qa-1", "V001", 0, 0, 9)
    encoder = lambda dim: models.hashing_encoder(dim)
    assert cli.main(["retrieve", "--manifest", str(out), "--query", "red car", "--output", str(tmp_path / "r"), "--asr-db", str(db), "--top-k", "5"], spark, encoder) == 0
    assert cli.main(["benchmark", "--queries", str(tmp_path / "q.csv"), "--query-column", "Description", "--manifest", str(out), "--output-dir", str(tmp_path / "b"), "--ground-truth", str(tmp_path / "gt.json")], spark, encoder) == 0
    assert cli.main(["ground-truth-template", "--queries", str(tmp_path / "q.csv"), "--output", str(tmp_path / "t")], spark) == 0
    assert files.inventory(spark, str(tmp_path / "nowhere"), (".jpg",)).count() == 0


def test_manifest(spark):
    media = spark.createDataFrame([("V1", 2, '{"title":"b"}'), ("V1", 1, "{broken"), ("V2", 1, '{"title":"c"}')], "video_id string, priority int, text string")
    rows = {r.video_id: r.metadata_text for r in manifest.media_text(spark.createDataFrame([("V1",), ("V3",)], "video_id string"), media).collect()}
    assert "b" in rows["V1"] and rows["V3"] == ""
    bad = spark.createDataFrame([("V", 0, 5, 0.0, ""), ("V", 0, 4, 0.0, ""), ("V", 2, None, 0.0, "")], "video_id string, keyframe_idx long, original_frame_id long, pts_time double, image_path string")
    assert {r.error for r in manifest.validate(bad).collect()} == {"duplicate keyframe_idx", "null original_frame_id", "keyframe_idx not contiguous"}
    rows = [("V", 0, 5, 3.0, "", 0), ("V", 1, 4, None, "", 1), ("V", 2, 6, 2.0, "", 3), ("W", 0, 1, 5.0, "", 0), ("W", 1, 2, 4.0, "", 1), ("X", 0, 0, 0.0, "", 0)]
    found = manifest.validate(spark.createDataFrame(rows, bad.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", clip_idx long"))
    assert {tuple(r) for r in found.collect()} == {("V", "original_frame_id falls"), ("V", "null pts_time"), ("V", "clip_idx differs from keyframe_idx"), ("W", "pts_time falls")}
    assert [tuple(r) for r in manifest.validate(bad.limit(0)).collect()] == [(None, "manifest is empty")]
    with pytest.raises(ValueError, match="image_path"):
        manifest.validate(bad.drop("image_path"))


def test_sources_by_role(spark, tmp_path):
    assert files.pick_column(["id", "content"], files.ROLES["text"]) == "content" and files.pick_column(["Original_Frame_ID "], files.ROLES["frame_id"]) == "Original_Frame_ID "
    db = tmp_path / "caption.db"
    with sqlite3.connect(db) as con:
        con.execute("CREATE TABLE notes (x TEXT)")
        con.execute("CREATE TABLE c (videoid TEXT, keyframe_id INT, content TEXT)")
        con.executemany("INSERT INTO c VALUES (?, ?, ?)", [(f"V{i % 3}", i, f"text {i}") for i in range(10)])
    python_sources.register(spark)
    old, python_sources.PART_ROWS = python_sources.PART_ROWS, 4
    try:
        rows = spark.read.format("sqlite_evidence").option("modality", "caption").load(str(db))
        assert sorted((r.video_id, r.frame_id, r.text) for r in rows.collect()) == sorted((f"V{i % 3}", i, f"text {i}") for i in range(10))
        rows = spark.read.format("sqlite_evidence").load(str(db))
        assert sorted(r.frame_id for r in rows.where("video_id = 'V1'").collect()) == [1, 4, 7]
        assert sorted(r.frame_id for r in rows.where("video_id IN ('V1', 'V2') AND frame_id > 4").collect()) == [5, 7, 8]
    finally:
        python_sources.PART_ROWS = old
    assert [t["roles"]["text"] for t in python_sources.inspect_sqlite(str(db))["tables"]] == [None, "content"]
    (tmp_path / "broken.db").write_text("no database at all")
    assert "error" in python_sources.inspect_sqlite(str(tmp_path / "broken.db")) and not python_sources.inspect_sqlite(str(tmp_path / "none.db"))["exists"]
    assert spark.read.format("sqlite_evidence").load(str(tmp_path / "broken.db")).count() == 0


def test_support_documents(spark, tmp_path):
    for at, text in (("objects/V1/001.json", '{"name":"late"}'), ("V1/001.json", '{"name":"first"}'), ("objects/V2/002.json", '{"name":"second"}'), ("V3/objects/003.json", '{"name":"third"}'), ("deep/down/V4/004.json", '{"name":"far"}')):
        (tmp_path / "o" / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "o" / at).write_text(text)
    frames = spark.createDataFrame([(f"V{i}", f"x/V{i}/00{i}.jpg") for i in range(1, 6)], "video_id string, image_path string")
    root = str(tmp_path / "o")
    found = manifest.object_text(manifest.object_paths(frames, files.inventory(spark, root, (".json",)), root), files.contents(spark, root, (".json",)))
    assert {r.video_id: r.object_text for r in found.collect()} == {"V1": "first", "V2": "second", "V3": "third", "V4": "far", "V5": ""}
    for at, text in (("V1.json", "{broken"), ("media-info/V1.json", '{"t":"one"}'), ("V2/media_info.json", '{"t":"two"}'), ("V2/V2.json", '{"t":"not this"}'), ("V3/V3.json", '{"t":"three"}'), ("V3/other.json", '{"t":"no"}')):
        (tmp_path / "m" / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "m" / at).write_text(text)
    root = str(tmp_path / "m")
    texts = {r.video_id: r.metadata_text for r in manifest.media_text(frames, manifest.media_documents(files.contents(spark, root, (".json",)), root)).collect()}
    assert {k: json.loads(v)["t"] if v else "" for k, v in texts.items()} == {"V1": "one", "V2": "two", "V3": "three", "V4": "", "V5": ""}


def test_audit_and_matrix(spark, tmp_path, capsys):
    for d in ("clip", "map", "keys/V1", "keys/V2", "keys/V3", "objects/V1", "media"):
        (tmp_path / d).mkdir(parents=True)
    np.save(tmp_path / "clip/V1.npy", np.arange(6, dtype=np.float16).reshape(3, 2) + 1)
    np.save(tmp_path / "clip/V2.npy", np.ones((1, 2), np.float32))
    np.save(tmp_path / "clip/by_column.npy", np.asfortranarray(np.arange(10.0).reshape(5, 2)))
    python_sources.register(spark)
    old, python_sources.PART_ROWS, python_sources.BATCH_ROWS = (python_sources.PART_ROWS, python_sources.BATCH_ROWS), 2, 1
    try:
        for at in (str(tmp_path / "clip/by_column.npy"), f"file://{tmp_path}/clip/by_column.npy"):
            rows = spark.read.format("npy").option("dim", 2).load(at).orderBy("pos").collect()
            assert [(r.video_id, r.pos, list(r.embedding)) for r in rows] == [("by_column", i, [2.0 * i, 2.0 * i + 1]) for i in range(5)]
    finally:
        python_sources.PART_ROWS, python_sources.BATCH_ROWS = old
    (tmp_path / "clip/by_column.npy").unlink()
    np.savez(tmp_path / "clip/more.npz", a=np.ones((2, 3)), b=np.arange(4))
    (tmp_path / "clip/bad.npy").write_bytes(b"nothing")
    (tmp_path / "map/V1.csv").write_text(" N ,PTS_Time,fps,frame_idx\n1,0.0,30,0\n2,1.0,30,45\n3,0.5,30,x\n")
    (tmp_path / "map/V2.csv").write_text("n,fps\n1,2\n")
    for v, n in (("V1", 3), ("V2", 1), ("V3", 2)):
        for i in range(n):
            (tmp_path / f"keys/{v}/f{i + 8}.webp").write_bytes(b"x")
    (tmp_path / "objects/V1/f8.json").write_text('{"name":"a","n":[1]}')
    (tmp_path / "objects/V1/f9.json").write_text("{")
    (tmp_path / "media/V1.json").write_text('[{"title":"b"}]')
    lines = [f"{k}: {tmp_path}/{d}" for k, d in (("keyframes_dir", "keys"), ("clip_dir", "clip"), ("mapping_dir", "map"), ("media_info_dir", "media"), ("objects_dir", "objects"), ("artifacts_dir", "out"))]
    (tmp_path / "c.yaml").write_text("\n".join([*lines, "audit:", "  max_manifest_rows: 5"]) + "\n")
    assert cli.main(["audit", "--config", str(tmp_path / "c.yaml")], spark) == 0
    made = json.loads((tmp_path / "out/dataset_audit.json").read_text())
    assert made["keyframes"]["total"] == 6 and made["keyframes"]["top_videos_by_keyframes"][0] == ["V1", 3]
    assert made["features"]["count"] == 4 and made["features"]["errors"] == 1 and {tuple(s["shape"]) for s in made["features"]["samples"] if "shape" in s} == {(3, 2), (1, 2), (2, 3), (4,)}
    assert made["mapping"]["count"] == 2 and made["mapping"]["frequency"]["fps"] == 2
    assert made["objects"]["frequency"] == {"name": 1, "n": 1} and made["media_info"]["samples"][0]["type"] == "array"
    found = made["integrity"]
    assert found["errors"] == ["V1: mapping holds cells that are not numbers", "V1: pts_time falls", "V2: mapping columns missing: pts_time, frame_idx", "V3: missing feature file"]
    assert (found["keyframes_found"], found["manifest_rows"], found["object_matches"]) == (5, 3, 2)
    assert "manifest_rows=3" in (tmp_path / "out/audit_report.txt").read_text()
    rows = spark.read.parquet(str(tmp_path / "out/dataset_manifest.parquet")).orderBy("keyframe_idx").collect()
    assert [(r.keyframe_name, r.clip_idx, r.original_frame_id) for r in rows] == [("f8", 0, 0), ("f9", 1, 45), ("f10", 2, None)]
    args = ["ordered-matrix", "--manifest", str(tmp_path / "out/dataset_manifest.parquet"), "--clip-dir", str(tmp_path / "clip/V*.npy"), "--output", str(tmp_path / "m.npy"), "--report", str(tmp_path / "r.json"), "--dim", "2"]
    assert cli.main(args, spark) == 0
    assert np.load(tmp_path / "m.npy").tolist() == [[1, 2], [3, 4], [5, 6]] and json.loads((tmp_path / "r.json").read_text())["embedding_shape"] == [3, 2]
    bad = spark.createDataFrame([("V1", 0, 7), ("V9", 0, 0)], "video_id string, keyframe_idx long, clip_idx long")
    with pytest.raises(RuntimeError, match="V1: clip_idx outside the matrix; V9: missing vectors"):
        manifest.ordered_matrix(bad, spark.read.format("npy").option("dim", 2).load(str(tmp_path / "clip/V*.npy")), 2)


def test_unified_benchmark(spark, frames, tmp_path, capsys):
    frames.withColumn("embedding2", F.col("embedding")).write.parquet(str(tmp_path / "frames.parquet"))
    (tmp_path / "q.csv").write_text("Query Name,Description,Trans\nqa-1,xe,red car\ntkis-2,sky,\ntrake-3,x,y\n")
    args = ["--manifest", str(tmp_path / "frames.parquet")]
    assert cli.main(["benchmark-unified", "--queries", str(tmp_path / "q.csv"), "--output-dir", str(tmp_path / "b"), "--task-prefix", "qa", "--task-prefix", "tkis", "--top-k", "500", *args], spark) == 0
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said["queries"] == 2 and said["top_k"] == 100 and said["translated_query"]
    assert {r[0] for r in spark.read.json(str(tmp_path / "b/results")).select("query_id").distinct().collect()} == {"qa-1", "tkis-2"}
    np.save(tmp_path / "v.npy", np.array([[0.0, 1.0]], np.float32))
    assert cli.main(["retrieve", "--query", "xe", "--query-translated", "car", "--query-embedding", str(tmp_path / "v.npy"), "--output", str(tmp_path / "r"), "--second-channel", "--second-weight", "0.5", *args], spark) == 0
    said = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert said["rows"] == 2 and said["second_channel_enabled"] and said["second_weight"] == 0.5
    assert spark.read.json(str(tmp_path / "r")).where("rank = 1").first().video_id == "V2"
    index = ["--index", str(tmp_path / "i.parquet"), "--metadata", str(tmp_path / "i.json")]
    assert cli.main(["build-index", *args, "--output-index", index[1], "--metadata-output", index[3]], spark) == 0
    assert cli.main(["retrieve", "--query", "xe", "--output", str(tmp_path / "i"), *index, *args], spark) == 0
    index[3] = str(tmp_path / "other.json")
    (tmp_path / "other.json").write_text('{"rows": 4, "dimension": 2, "metric": "inner_product"}')
    with pytest.raises(ValueError, match="rows"):
        cli.main(["retrieve", "--query", "xe", "--output", str(tmp_path / "i"), *index, *args], spark)
    with pytest.raises(SystemExit):
        cli.main(["retrieve", "--query", "xe", "--output", str(tmp_path / "f"), "--fine-score", *args], spark)


def test_models(spark):
    unit = models.grounded_scorer([3.0, 0.0, 0.0], lambda v, f: [float(v.sum())] * len(f))()
    assert unit([1, 2]) == [1.0, 1.0]
    paths = spark.createDataFrame([("a", "a.mp4"), ("b", "b.mp4")], "video_id string, video_path string")
    probed = models.probe_videos(paths, lambda: lambda p: {"fps": 25.0 if p[0] == "a" else 0.0, "frame_count": 50, "width": 2, "height": 2}).orderBy("video_id").collect()
    assert probed[0].duration_sec == 2.0 and "fps" in probed[1].error
    ask = spark.createDataFrame([("q", "what", "V", [1], [b"x"])], "query_id string, question string, video_id string, frame_ids array<bigint>, frames array<binary>")
    assert models.answer_questions(ask, lambda: lambda q, f: f" {q}! ").first().answer == X.prompt("what") + "!"


def test_stream_islands(spark, tmp_path):
    from framesieve.streaming.sessions import stream_islands

    spark.createDataFrame([("V", i, 1.0 * i) for i in (0, 1, 2, 10)], "video_id string, s long, score double").select("video_id", F.timestamp_seconds("s").alias("ts"), "score").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video_id string, ts timestamp, score double").parquet(str(tmp_path / "in"))
    q = stream_islands(stream, "2 seconds", "0 seconds").writeStream.outputMode("append").format("memory").queryName("islands_out").start()
    q.processAllAvailable()
    q.stop()
    assert [r.score for r in spark.sql("SELECT * FROM islands_out").collect()] == [2.0]


@pytest.mark.parametrize("few", [10_000, 5])
def test_first_rows(spark, monkeypatch, few):
    monkeypatch.setattr(manifest, "SORTED", few)
    rng = np.random.default_rng(few)
    names = ["a/" + "".join(rng.choice(list("ab/é"), rng.integers(0, 9))) for _ in range(300)] + ["a/b"] * 20 + ["a/"] * 4 + [None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, path string")
    order = sorted(n or "" for n in names)
    for n in (0, 1, 2, 7, 24, 100, 150, 299, 324, 325, 400):
        assert sorted(r.path or "" for r in manifest.first_rows(df, "path", n).collect()) == order[:n]
    plan = manifest.first_rows(df, "path", 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
