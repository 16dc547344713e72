"""The inverted index of evidence against texts compared one by one, built in place and written."""

import random

import pytest
from pyspark.sql import functions as F

from framesieve.functions.text import lexical_overlap
from framesieve.operators import evidence, fuse
from framesieve.plans import pipeline

WORDS = ["red", "car", "sky", "a", "blue", "über", "x1", "THE", "the"]


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices(WORDS, k=rng.randint(0, n)))
    docs = [(rng.choice(["asr", "ocr"]), f"V{rng.randint(0, 4)}", rng.choice(["0", "40", "90", None, "x"]), rng.choice([text(6), text(2), None])) for _ in range(80)]
    docs += docs[:5] + [("asr", "hot", str(i % 7), text(5)) for i in range(300)] + [("empty", "V0", "1", ""), ("ocr", "V9", "3", None)]
    asked = [(q, f"V{v}", rng.choice([0, 45, 100]), text(4)) for q in range(6) for v in range(6)] + [(7, "hot", 3, "red car"), (8, "hot", 3, None), (9, "V9", 3, "red"), (10, "V0", None, "red sky")]
    return spark.createDataFrame(asked, "query_id long, video_id string, best_frame_id long, query_text string"), spark.createDataFrame(docs, "modality string, video_id string, frame_id string, text string")


def one_by_one(candidates, docs):
    score = lexical_overlap(F.col("query_text"), F.col("text"))
    soft = F.when(F.abs(F.expr("try_cast(frame_id AS BIGINT)") - F.col("best_frame_id")) > 30, score * 0.5).otherwise(score)
    return candidates.join(docs, "video_id").groupBy("query_id", "video_id", "modality").agg(F.max(soft).alias("score"))


def rows(df):
    return sorted((r.query_id, r.video_id, r.modality, round(r.score, 12)) for r in df.collect())


def test_same_as_texts_one_by_one(spark, given):
    candidates, docs = given
    wanted = rows(one_by_one(candidates, docs))
    assert rows(evidence.scores(candidates, docs)) == wanted and len(wanted) > 60
    assert rows(evidence.scores(candidates, docs, tolerance=0)) != wanted
    assert evidence.scores(candidates.limit(0), docs).count() == 0 and evidence.scores(candidates, docs.limit(0)).count() == 0


def test_written_index(spark, given):
    candidates, docs = given
    evidence.write(evidence.build(docs), "evidence_test", 4)
    try:
        index = evidence.read(spark, "evidence_test")
        assert {r[0] for r in index.modalities().collect()} == {"asr", "ocr", "empty"}
        made = evidence.scores(candidates, index)
        assert rows(made) == rows(one_by_one(candidates, docs))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = evidence.scores(candidates, index)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        # the postings are read by bucket and not dealt again; no array of words is shuffled
        assert "Bucketed: true" in plan and "array<string>" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
        below = plan[plan.index("_postings") - 900 : plan.index("_postings")]
        assert "SelectedBucketsCount: 4 out of 4" in plan and "Exchange hashpartitioning(video_id" not in below
    finally:
        for part in ("postings", "present"):
            spark.sql(f"DROP TABLE IF EXISTS evidence_test_{part}")


def shuffled(spark, group, run):
    """Records that the jobs of run() wrote for shuffles."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(j).stageIds}
    made = [context._jsc.sc().statusStore().lastStageAttempt(s) for s in sorted(stages)]
    return sum(s.shuffleWriteRecords() for s in made if str(s.status()) == "COMPLETE")


def test_pairs_are_not_shuffled(spark):
    asked = spark.range(300).selectExpr("id AS query_id", "'V' AS video_id", "id AS best_frame_id", "concat('red car number ', id) AS query_text")
    docs = spark.range(2000).selectExpr("if(id % 2 = 0, 'asr', 'ocr') AS modality", "'V' AS video_id", "id AS frame_id", "concat('red number ', id % 500) AS text").repartition(4)
    made = []
    records = shuffled(spark, "pairs", lambda: made.extend(rows(evidence.scores(asked, docs))))
    assert made == rows(one_by_one(asked, docs)) and len(made) == 600
    assert records < 20_000  # a record of each pair that shares a word would be 600,000


@pytest.mark.parametrize("block,counted", [(40, 10_000), (500_000, 1), (7, 3)])
def test_blocks_and_parts(spark, given, monkeypatch, block, counted):
    candidates, docs = given
    monkeypatch.setattr(evidence, "BLOCK", block)
    monkeypatch.setattr(evidence, "COUNTED", counted)
    assert rows(evidence.scores(candidates, docs)) == rows(one_by_one(candidates, docs))
    index = evidence.build(docs)
    assert rows(evidence.scores(candidates, evidence.EvidenceIndex(index.postings, index.present))) == rows(one_by_one(candidates, docs))


def test_repeated_candidates_and_far_frames(spark):
    last = 2**63 - 1
    asked = spark.createDataFrame([(1, "V", last, "red car"), (1, "V", last, "red car"), (2, "V", -last, "red car"), (3, "V", 5, "")], "query_id long, video_id string, best_frame_id long, query_text string")
    docs = spark.createDataFrame([("asr", "V", str(-last), "red car"), ("ocr", "V", str(last), "red")], "modality string, video_id string, frame_id string, text string")
    assert rows(evidence.scores(asked, docs)) == [(1, "V", "asr", 0.5), (1, "V", "ocr", 0.5), (2, "V", "asr", 1.0), (2, "V", "ocr", 0.25), (3, "V", "asr", 0.0), (3, "V", "ocr", 0.0)]


@pytest.fixture(scope="module")
def many(spark):
    """Frames of one video, queries that all have it as their candidate, and its texts."""
    frames = spark.range(40).selectExpr("id AS row_id", "'V' AS video_id", "id AS keyframe_idx", "30 * id AS original_frame_id", "double(id) AS pts_time", "array(1.0, double(id)) AS embedding")
    asked = spark.range(300).selectExpr("id AS query_id", "concat('red car number ', id) AS query_text", "array(1.0, double(id % 40)) AS vector")
    docs = spark.range(2000).selectExpr("if(id % 2 = 0, 'asr', 'ocr') AS modality", "'V' AS video_id", "id AS frame_id", "concat('red number ', id % 500) AS text").repartition(4)
    return frames, asked, docs


def test_fused_scores_shuffle_no_pairs(spark, many):
    _, asked, docs = many
    candidates = asked.selectExpr("query_id", "'V' AS video_id", "query_text", "1.0 AS retrieval_score", "'' AS object_text", "'red' AS metadata_text", "query_id % 40 * 30 AS best_frame_id")
    made = []
    records = shuffled(spark, "fused", lambda: made.extend(fuse.multimodal(candidates, docs).select("query_id", "evidence_score", "fused_score").collect()))
    # the only candidate has a query's largest score and evidence, and one word in three or four with its video's metadata
    assert len(made) == 300 and all(r.evidence_score == 1 and 0.85 < r.fused_score < 0.9 for r in made) and records < 30_000


def test_retrieve_shuffles_no_pairs(spark, many):
    frames, asked, docs = many
    made = []
    records = shuffled(spark, "retrieve", lambda: made.extend(pipeline.retrieve(frames, asked, docs).collect()))
    assert len(made) == 300 and {r["rank"] for r in made} == {1} and {r.evidence_modalities for r in made} == {"asr,ocr"} and records < 60_000


def test_run_shuffles_no_pairs(spark, many):
    frames, asked, docs = many
    made = []
    records = shuffled(spark, "run", lambda: made.extend(pipeline.run(frames, asked, 20, evidence=docs, localize_top_k=3).collect()))
    assert len(made) == 300 and all(r.start_frame <= r.semantic_keyframe <= r.end_frame for r in made) and records < 100_000
