"""Registered queries over the driver's tables, and the same in SQL.

The tables hold no videos, so frames, candidates and evidence are derived from embeddings, documents,
events and the rest; floats are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .config import TemporalScoreConfig
from .functions import scores as S
from .functions import text as X
from .functions.vector import combined, cosine
from .operators import cells, decoding, evaluate, evidence, fuse, manifest, search, temporal
from .operators.jsontext import json_text
from .plans import pipeline
from .steps import step_folder, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.concat(F.lit("V"), F.lpad(F.col("label").cast("string"), 3, "0")).alias("video_id"), "embedding")
    e = e.withColumn("keyframe_idx", F.row_number().over(W.partitionBy("video_id").orderBy("row_id")).cast("long"))
    return e.withColumn("original_frame_id", F.col("keyframe_idx") * 30).withColumn("pts_time", F.col("keyframe_idx").cast("double"))


def _vector(spark: SparkSession, sf: str, vec_id: int) -> list[float]:
    return list(_t(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every hundredth vector, against all rows."""
    return _t(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _hits(spark: SparkSession, sf: str, k: int = 200, asked: DataFrame | None = None) -> DataFrame:
    frames = _frames(spark, sf)
    return search.search_batch(frames, _asked(spark, sf) if asked is None else asked, k).join(frames.drop("embedding"), "row_id")


def _hits2(spark: SparkSession, sf: str, k: int = 200) -> DataFrame:
    """The second channel's vectors: every number times its size."""
    other = lambda c: F.transform(F.col(c).cast("array<double>"), lambda x: x * F.abs(x))
    frames = _frames(spark, sf).withColumn("embedding", other("embedding"))
    asked = _asked(spark, sf).withColumn("vector", other("vector"))
    return search.search_batch(frames, asked, k).join(frames.drop("embedding"), "row_id")


_FRAMES = """frames AS (
  SELECT vec_id AS row_id, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS keyframe_idx,
         30 * row_number() OVER (PARTITION BY label ORDER BY vec_id) AS original_frame_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE) AS pts_time,
         CAST(embedding AS DOUBLE[]) AS v, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * abs(x)) AS v2 FROM embeddings
)"""


def _sql_hits(name: str, vector: str, k: int = 200, where: str = "vec_id % 100 = 0") -> str:
    cut = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * abs(x))" if vector == "v2" else "CAST(embedding AS DOUBLE[])"
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM (
    SELECT q.query_id, f.row_id, f.video_id, f.keyframe_idx, f.original_frame_id, f.pts_time,
           list_inner_product(f.{vector}, q.v) / (sqrt(list_inner_product(f.{vector}, f.{vector})) * sqrt(list_inner_product(q.v, q.v))) AS score
    FROM frames f, (SELECT vec_id AS query_id, {cut} AS v FROM embeddings WHERE {where}) q)) WHERE rank <= {k}
)"""


def _sql_videos(name: str, hits: str, k: int, prefix: str) -> str:
    return f"""{name} AS (
  SELECT query_id, video_id, 0.75 * max(score) + 0.25 * avg(score) AS {prefix}_score, max(score) AS {prefix}_best_score, avg(score) AS {prefix}_topk_mean, stddev_pop(score) AS {prefix}_score_std,
         arg_max(keyframe_idx, score) AS best_frame_idx, arg_max(original_frame_id, score) AS best_frame_id, arg_max(pts_time, score) AS best_pts_time
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, row_id) AS nth FROM {hits}) WHERE nth <= {k} GROUP BY query_id, video_id
)"""


def _sql_minmax(x: str, over: str = "PARTITION BY query_id", eps: str = "1e-12") -> str:
    low, high = f"min({x}) OVER ({over})", f"max({x}) OVER ({over})"
    return f"CASE WHEN {high} - {low} <= {eps} THEN CASE WHEN {high} > 0 THEN 1.0 ELSE 0.0 END ELSE ({x} - {low}) / ({high} - {low}) END"


_BASE = f"WITH {_FRAMES}, {_sql_hits('hits', 'v')}, {_sql_videos('videos', 'hits', 5, 'retrieval')}"
_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_\x{{00C0}}-\x{{1EF9}}]+')"


def _sql_tokens(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({_TOKENS.format(x)}, lambda t: length(t) > 1), lambda t: lower(t)))"


# search ------------------------------------------------------------------------------------------


@query(f"WITH {_FRAMES}, {_sql_hits('hits', 'v', 100, 'vec_id = 7')} SELECT row_id, video_id, keyframe_idx, round(score, 6) AS score FROM hits")
def frame_topk(spark, sf):
    hits = search.search_frames(_frames(spark, sf), _vector(spark, sf, 7), 100)
    return hits.select("row_id", "video_id", "keyframe_idx", F.round("score", 6).alias("score"))


@query(f"WITH {_FRAMES}, {_sql_hits('hits', 'v', 50)} SELECT query_id, row_id, round(score, 6) AS score, rank FROM hits")
def batch_frame_topk(spark, sf):
    return search.search_batch(_frames(spark, sf), _asked(spark, sf), 50).select("query_id", "row_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_FRAMES}, {_sql_hits('hits', 'v', 50)} SELECT query_id, row_id, round(score, 6) AS score, rank FROM hits")
def pruned_topk(spark, sf):
    """The same by an index in cells, written first, of which only the cells that may matter are read."""
    path = step_folder(spark, "cells")
    cells.build(_frames(spark, sf), path)
    return cells.search(spark, path, _asked(spark, sf), 50).hits.select("query_id", "row_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _sql_search(how: str, k: int) -> str:
    return f"""WITH {_FRAMES}, {_sql_hits('hits', 'v')}, videos AS (SELECT query_id, video_id, {how}(score) AS s, arg_max(original_frame_id, score) AS best_frame_id
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, row_id) AS nth FROM hits) WHERE nth <= {k} GROUP BY query_id, video_id)
SELECT query_id, video_id, round(s, 6) AS video_score, best_frame_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, video_id) AS nth FROM videos) WHERE nth <= 8"""


@query(_sql_search("max", 1))
def video_max(spark, sf):
    return search.search_videos(_hits(spark, sf), "max", top_k=8, keys=("query_id",)).select("query_id", "video_id", F.round("video_score", 6).alias("video_score"), "best_frame_id")


@query(_sql_search("avg", 3))
def video_topk_mean(spark, sf):
    return search.search_videos(_hits(spark, sf), "topk_mean", top_k=8, keys=("query_id",)).select("query_id", "video_id", F.round("video_score", 6).alias("video_score"), "best_frame_id")


_EVIDENCE_COLUMNS = ("retrieval_score", "retrieval_best_score", "retrieval_topk_mean", "retrieval_score_std")


@query(f"{_BASE} SELECT query_id, video_id, {', '.join(f'round({c}, 6) AS {c}' for c in _EVIDENCE_COLUMNS)}, best_frame_idx, best_frame_id, best_pts_time FROM videos")
def video_evidence_agg(spark, sf):
    return search.video_evidence(_hits(spark, sf), 5, ("query_id",)).withColumns(_r(*_EVIDENCE_COLUMNS))


@query(f"WITH {_FRAMES}, {_sql_hits('hits2', 'v2')}, {_sql_videos('videos2', 'hits2', 3, 'channel2')} SELECT query_id, video_id, round(channel2_score, 6) AS channel2_score, best_frame_id FROM videos2")
def channel2_agg(spark, sf):
    return search.video_evidence(_hits2(spark, sf), 3, ("query_id",), "channel2").select("query_id", "video_id", F.round("channel2_score", 6).alias("channel2_score"), "best_frame_id")


@query(f"""WITH {_FRAMES}, {_sql_hits('hits', 'v', 20)}, {_sql_videos('videos', 'hits', 5, 'retrieval')}, {_sql_hits('hits2', 'v2', 20)}, {_sql_videos('videos2', 'hits2', 3, 'channel2')},
both_ AS (SELECT query_id, video_id, coalesce(a.retrieval_score, 0) AS x, coalesce(b.channel2_score, 0) AS y, coalesce(a.best_frame_id, b.best_frame_id) AS best_frame_id, coalesce(a.best_frame_idx, 0) AS best_frame_idx FROM videos a FULL JOIN videos2 b USING (query_id, video_id))
SELECT query_id, video_id, best_frame_id, best_frame_idx, round(x, 6) AS clip_score, round(0.65 * ({_sql_minmax('x')}) + 0.35 * ({_sql_minmax('y')}), 6) AS retrieval_score FROM both_""")
def channel_fusion_outer(spark, sf):
    one = search.video_evidence(_hits(spark, sf, 20), 5, ("query_id",))
    two = search.video_evidence(_hits2(spark, sf, 20), 3, ("query_id",), "channel2")
    return fuse.fuse_channels(one, two).select("query_id", "video_id", "best_frame_id", "best_frame_idx", F.round("clip_score", 6).alias("clip_score"), F.round("retrieval_score", 6).alias("retrieval_score"))


@query("""WITH q AS (SELECT list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: 0.2 * p[1] + 0.8 * p[2]) AS v FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id = 8)
SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(v, v))), 6) AS score FROM embeddings, q""")
def embedding_fusion(spark, sf):
    a, b = (F.array(*(F.lit(x) for x in _vector(spark, sf, i))) for i in (7, 8))
    return _t(spark, sf, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), combined(a, b)), 6).alias("score"))


@query("SELECT count(*) AS size, min(vec_id) AS id_min, max(vec_id) AS id_max, min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max, count(*) = count(DISTINCT vec_id) AND min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AS sequential, count(*) FILTER (list_max(list_transform(embedding, lambda x: abs(x))) = 0) AS zero_vectors, 'inner_product' AS metric FROM embeddings")
def vector_index_contract(spark, sf):
    return search.index_contract(_t(spark, sf, "embeddings"), "vec_id")


@query(f"""WITH {_FRAMES}, pairs AS (SELECT a.vec_id AS query_id, CASE WHEN a.vec_id % 200 = 0 THEN list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: 0.2 * p[1] + 0.8 * p[2]) ELSE CAST(a.embedding AS DOUBLE[]) END AS q
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 100 = 0)
SELECT query_id, row_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank
  FROM (SELECT query_id, row_id, round(list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))), 6) AS score FROM frames, pairs)) WHERE rank <= 20""")
def translated_search(spark, sf):
    """Every other query has a translation, whose vector is the next row's."""
    other = _t(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("translated_vector"))
    asked = _asked(spark, sf).join(other, "query_id").withColumn("query_text", F.lit("a")).withColumn("translated", F.when(F.col("query_id") % 200 == 0, "b").otherwise(" "))
    hits = search.search_batch(_frames(spark, sf), pipeline.translated(asked), 40).withColumn("score", F.round("score", 6))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return hits.withColumn("nth", nth).where("nth <= 20").select("query_id", "row_id", "score")


# text and evidence -------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string(list_sort({_sql_tokens('text')}), ' ') AS tokens FROM documents")
def tokenize(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(X.tokens(F.col("text"))), " ").alias("tokens"))


@query(f"""WITH b AS (SELECT item_id, {_sql_tokens('text')} AS q FROM benchmark WHERE item_id % 100 = 0), d AS (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents)
SELECT item_id, doc_id, round(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END, 6) AS overlap FROM d, b""")
def lexical_overlap(spark, sf):
    """Every hundredth item against all documents."""
    asked = [(r["item_id"], r["text"]) for r in _t(spark, sf, "benchmark").where("item_id % 100 = 0").collect()]
    scores = F.array(*(F.struct(F.lit(i).cast("long").alias("item_id"), F.round(X.lexical_overlap(F.lit(t), F.col("text")), 6).alias("overlap")) for i, t in asked))
    return _t(spark, sf, "documents").select("doc_id", F.explode(scores).alias("s")).select("s.item_id", "doc_id", "s.overlap")


def _stores(spark, sf) -> DataFrame:
    d = _t(spark, sf, "documents")
    modality = F.when(F.col("doc_id") % 2 == 0, "asr").otherwise("ocr")
    return d.select(modality.alias("modality"), F.concat(F.lit("V"), F.lpad((F.col("doc_id") % 10).cast("string"), 3, "0")).alias("video_id"), F.col("doc_id").alias("frame_id"), "text")


def _candidates(spark, sf) -> DataFrame:
    texts = _t(spark, sf, "benchmark").select((F.col("item_id") * 100).alias("query_id"), F.col("text").alias("query_text"))
    # queries without a text have no candidates, and aren't searched
    videos = search.video_evidence(_hits(spark, sf, asked=_asked(spark, sf).join(texts, "query_id", "left_semi")), 5, ("query_id",))
    brands = _t(spark, sf, "part").groupBy(F.concat(F.lit("V"), F.lpad((F.col("p_partkey") % 10).cast("string"), 3, "0")).alias("video_id")).agg(F.min("p_name").alias("object_text"), F.max("p_type").alias("metadata_text"))
    return videos.join(texts, "query_id").join(brands, "video_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("object_text", "metadata_text")})


_CANDIDATES = f"""{_BASE}, texts AS (SELECT item_id * 100 AS query_id, text AS query_text FROM benchmark),
brands AS (SELECT 'V' || lpad(CAST(p_partkey % 10 AS VARCHAR), 3, '0') AS video_id, min(p_name) AS object_text, max(p_type) AS metadata_text FROM part GROUP BY 1),
candidates AS (SELECT v.*, query_text, coalesce(object_text, '') AS object_text, coalesce(metadata_text, '') AS metadata_text, {_sql_tokens('query_text')} AS q
  FROM videos v JOIN texts USING (query_id) LEFT JOIN brands USING (video_id)),
stores AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'asr' ELSE 'ocr' END AS modality, 'V' || lpad(CAST(doc_id % 10 AS VARCHAR), 3, '0') AS video_id, doc_id AS frame_id, {_sql_tokens('text')} AS t FROM documents),
evidence AS (SELECT query_id, video_id, modality, max(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END * CASE WHEN abs(frame_id - best_frame_id) > 30 THEN 0.5 ELSE 1 END) AS score
  FROM candidates JOIN stores USING (video_id) GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval_score DESC, video_id) AS pos FROM candidates),
terms AS (SELECT e.*, CASE WHEN score > 0 THEN 1.0 / (60 + row_number() OVER (PARTITION BY query_id, modality ORDER BY score DESC, pos)) ELSE 0 END AS term FROM evidence e JOIN placed p USING (query_id, video_id)),
rrf AS (SELECT query_id, video_id, sum(term ORDER BY modality) AS evidence_score FROM terms GROUP BY 1, 2)"""


@query(f"{_CANDIDATES} SELECT query_id, video_id, modality, round(score, 6) AS score FROM evidence")
def evidence_score(spark, sf):
    return evidence.scores(written(_candidates(spark, sf)), _stores(spark, sf)).withColumns(_r("score"))


@query(f"{_CANDIDATES} SELECT query_id, video_id, round(evidence_score, 6) AS evidence_score FROM rrf")
def rrf_fusion(spark, sf):
    c = written(_candidates(spark, sf))
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("retrieval_score"), "video_id"))
    found = evidence.scores(c, _stores(spark, sf)).join(c.select("query_id", "video_id", pos.alias("pos")), ["query_id", "video_id"])
    return fuse.rrf_scores(found).withColumns(_r("evidence_score"))


def _overlap_sql(column: str) -> str:
    return f"CASE WHEN len(q) = 0 OR len({_sql_tokens(column)}) = 0 THEN 0.0 ELSE len(list_intersect(q, {_sql_tokens(column)})) / len(q) END"


_FUSED = f"""{_CANDIDATES}, parts AS (SELECT query_id, video_id, retrieval_score, best_frame_id, {_overlap_sql('object_text')} AS o, {_overlap_sql('metadata_text')} AS m, coalesce(evidence_score, 0) AS e FROM candidates LEFT JOIN rrf USING (query_id, video_id)),
fused AS (SELECT query_id, video_id, retrieval_score, best_frame_id, 0.70 * ({_sql_minmax('retrieval_score')}) + 0.10 * o + 0.05 * m + 0.15 * ({_sql_minmax('e')}) AS fused_score FROM parts)"""


@query(f"{_FUSED} SELECT query_id, video_id, round(fused_score, 6) AS fused_score FROM fused")
def multimodal_fused(spark, sf):
    return fuse.multimodal(_candidates(spark, sf), _stores(spark, sf)).select("query_id", "video_id", F.round("fused_score", 6).alias("fused_score"))


def _supported(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Frames with the texts of their videos, and the queries that have one."""
    brands = _t(spark, sf, "part").groupBy(F.concat(F.lit("V"), F.lpad((F.col("p_partkey") % 10).cast("string"), 3, "0")).alias("video_id")).agg(F.min("p_name").alias("object_text"), F.max("p_type").alias("metadata_text"))
    texts = _t(spark, sf, "benchmark").select((F.col("item_id") * 100).alias("query_id"), F.col("text").alias("query_text"))
    return _frames(spark, sf).join(brands, "video_id", "left"), _asked(spark, sf).join(texts, "query_id")


_RANK = f"{_FUSED}, r AS (SELECT *, 0.55 * ({_sql_minmax('retrieval_score')}) + 0.30 * ({_sql_minmax('fused_score')}) AS rank_score FROM fused)"


@query(f"{_RANK} SELECT query_id, video_id, best_frame_id, round(fused_score, 6) AS multimodal_score, round(rank_score, 6) AS rank_score FROM r")
def retrieve(spark, sf):
    frames, asked = _supported(spark, sf)
    return pipeline.retrieve(frames, asked, _stores(spark, sf)).select("query_id", "video_id", "best_frame_id", F.round("multimodal_score", 6).alias("multimodal_score"), F.round("rank_score", 6).alias("rank_score"))


_RUN = f"""{_RANK.replace("WHERE rank <= 200", "WHERE rank <= 1000")}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, video_id) AS nth FROM r),
t AS (SELECT *, CASE WHEN nth <= 3 THEN fused_score ELSE 0 END AS temporal FROM f), z AS (SELECT *, 0.55 * ({_sql_minmax('retrieval_score')}) + 0.15 * ({_sql_minmax('temporal')}) + 0.30 * ({_sql_minmax('fused_score')}) AS final FROM t)"""


@query(f"""{_RUN} SELECT query_id, video_id, CASE WHEN nth <= 3 THEN greatest(0, best_frame_id - 24) END AS start_frame, CASE WHEN nth <= 3 THEN best_frame_id + 24 END AS end_frame, best_frame_id AS semantic_keyframe, round(final, 6) AS rank_score FROM z""")
def run_localized_head(spark, sf):
    """The whole plan, localising the first three videos of each query over their known frames."""
    frames, asked = _supported(spark, sf)
    made = pipeline.run(frames, asked, 20, evidence=_stores(spark, sf), localize_top_k=3)
    return made.select("query_id", "video_id", "start_frame", "end_frame", "semantic_keyframe", F.round("rank_score", 6).alias("rank_score"))


_RANKED = f"{_BASE}, ranked AS (SELECT *, 0.65 * ({_sql_minmax('retrieval_score')}) + 0.20 * ({_sql_minmax('retrieval_score_std')}) + 0.15 * ({_sql_minmax('retrieval_topk_mean')}) AS rank_score FROM videos)"
_SUBMITTED = f"{_RANKED}, submitted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank_score, 9) DESC, video_id) AS rank FROM ranked)"


def _ranked(spark, sf) -> DataFrame:
    videos = search.video_evidence(_hits(spark, sf), 5, ("query_id",))
    return fuse.rerank(videos.withColumn("temporal_score", F.col("retrieval_score_std")).withColumn("multimodal_score", F.col("retrieval_topk_mean")))


def _submitted(spark, sf, k: int = 100) -> DataFrame:
    return fuse.submission(_ranked(spark, sf).withColumn("rank_score", F.round("rank_score", 9)), k).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_RANKED} SELECT query_id, video_id, round(rank_score, 6) AS rank_score FROM ranked")
def rerank_weighted(spark, sf):
    return _ranked(spark, sf).select("query_id", "video_id", F.round("rank_score", 6).alias("rank_score"))


@query(f"{_SUBMITTED} SELECT query_id, video_id, rank FROM submitted WHERE rank <= 5")
def submission_topk(spark, sf):
    return _submitted(spark, sf, 5).select("query_id", "video_id", "rank")


@query(f"""SELECT c_custkey, round({_sql_minmax('c_acctbal', 'PARTITION BY c_nationkey')}, 6) AS by_nation, round({_sql_minmax('c_acctbal', 'PARTITION BY c_custkey', '1e-8')}, 6) AS constant FROM customer""")
def minmax_variants(spark, sf):
    x = F.col("c_acctbal")
    return _t(spark, sf, "customer").select("c_custkey", F.round(S.minmax(x, W.partitionBy("c_nationkey")), 6).alias("by_nation"), F.round(S.minmax(x, W.partitionBy("c_custkey"), 1e-8), 6).alias("constant"))


# time --------------------------------------------------------------------------------------------


def _dense(spark, sf) -> DataFrame:
    """Per user, one score for each hour with events: the hour is the frame."""
    e = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("video_id"), F.expr("unix_seconds(cast(ts AS timestamp)) div 3600").alias("frame_id"), "value")
    hours = e.groupBy("video_id", "frame_id").agg(F.max("value").alias("score"))
    return hours.withColumn("pos", F.row_number().over(W.partitionBy("video_id").orderBy("frame_id")).cast("long") - 1)


_DENSE = """WITH hours AS (SELECT CAST(user_id AS VARCHAR) AS video_id, epoch_us(ts) // 3600000000 AS frame_id, max(value) AS score FROM events GROUP BY 1, 2),
dense AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_id) - 1 AS pos FROM hours)"""
_GAP = 24


@query(f"""{_DENSE}, marked AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER w <= {_GAP} THEN 0 ELSE 1 END AS fresh FROM dense WINDOW w AS (PARTITION BY video_id ORDER BY frame_id, score)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame_id, score ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT video_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, (min(frame_id) + max(frame_id)) // 2 AS center_frame, round(max(score), 6) AS score FROM runs GROUP BY video_id, island""")
def islands(spark, sf):
    return temporal.islands(_dense(spark, sf), _GAP).withColumns(_r("score"))


@query(_SQL["islands"])
def islands_spread(spark, sf):
    """The same, with every user's hours spread over parts."""
    return temporal.islands_spread(_dense(spark, sf), _GAP, part=100).withColumns(_r("score"))


@query(f"{_DENSE} SELECT video_id, arg_max(frame_id, (score, -pos)) AS peak_frame, round(max(score), 6) AS peak_score FROM dense GROUP BY video_id")
def peak_frame(spark, sf):
    return temporal.peak_frame(_dense(spark, sf)).withColumns(_r("peak_score"))


@query(f"""{_DENSE}, x AS (SELECT *, {_sql_minmax('score', 'PARTITION BY video_id', '1e-8')} AS x, count(*) OVER (PARTITION BY video_id) AS n FROM dense),
y AS (SELECT *, greatest(coalesce(lag(x) OVER w, 0), coalesce(lead(x) OVER w, 0)) AS beside, row_number() OVER (PARTITION BY video_id ORDER BY x DESC, pos) AS nth FROM x WINDOW w AS (PARTITION BY video_id ORDER BY pos))
SELECT video_id, round(avg(x) FILTER (nth <= greatest(1, ceil(0.20 * n))) + 0.05 * max(beside) FILTER (nth = 1), 6) AS event_score FROM y GROUP BY video_id""")
def temporal_event_score(spark, sf):
    return temporal.event_score(_dense(spark, sf)).withColumns(_r("event_score"))




@query(f"{_DENSE} SELECT video_id, arg_max(frame_id, (score, -pos)) AS frame_id, round(max(score), 6) AS score, arg_max(pos, (score, -pos)) AS rank FROM dense WHERE frame_id >= (SELECT min(frame_id) + 100 FROM dense) AND frame_id <= (SELECT min(frame_id) + 500 FROM dense) GROUP BY video_id")
def semantic_keyframe(spark, sf):
    dense = _dense(spark, sf)
    first = dense.agg(F.min("frame_id")).first()[0] or 0
    return temporal.semantic_keyframe(dense, ("video_id",), F.lit(first + 100), F.lit(first + 500)).withColumns(_r("score"))


@query("""WITH f AS (SELECT vec_id, CAST(vec_id * 3 AS BIGINT) AS c, CAST((SELECT count(*) FROM embeddings) AS BIGINT) * 3 AS total FROM embeddings),
w AS (SELECT vec_id, greatest(0, c - 60) AS lo, least(total - 1, c + 60) AS hi FROM f)
SELECT vec_id, unnest(CASE WHEN hi - lo + 1 <= 24 THEN range(lo, hi + 1) ELSE list_transform(range(0, 24), lambda i: lo + CASE WHEN i = 23 THEN hi - lo ELSE CAST(floor(i * ((hi - lo) / 23.0::DOUBLE)) AS BIGINT) END) END) AS frame_id FROM w""")
def frame_window_expand(spark, sf):
    e = _t(spark, sf, "embeddings")
    total = e.count() * 3
    return e.select("vec_id", F.explode(temporal.window_frames((F.col("vec_id") * 3).cast("bigint"), F.lit(total).cast("bigint"), 60, 24)).alias("frame_id"))


def _coarse(spark, sf) -> DataFrame:
    """Each user's hour in the middle of its hours, as a candidate's best frame."""
    d = _dense(spark, sf)
    middle = d.groupBy("video_id").agg(F.expr("(max(pos) + 1) div 2").alias("pos"))
    return d.join(middle, ["video_id", "pos"]).select(F.lit(1).cast("long").alias("query_id"), "video_id", F.col("frame_id").alias("best_frame_id"), F.col("score").alias("multimodal_score"))


_COARSE = f"{_DENSE}, middle AS (SELECT video_id, (max(pos) + 1) // 2 AS pos FROM dense GROUP BY 1), coarse AS (SELECT video_id, frame_id AS best_frame_id, score AS multimodal_score FROM dense JOIN middle USING (video_id, pos))"


@query(f"""{_COARSE}, ids AS (SELECT video_id, best_frame_id, unnest(list_transform(range(0, 96), lambda i: best_frame_id - 72 + CASE WHEN i = 95 THEN 144 ELSE CAST(floor(i * (144 / 95.0::DOUBLE)) AS BIGINT) END)) AS frame_id FROM coarse),
near_ AS (SELECT d.*, best_frame_id FROM dense d JOIN ids USING (video_id, frame_id)),
marked AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER w <= {_GAP} THEN 0 ELSE 1 END AS fresh FROM near_ WINDOW w AS (PARTITION BY video_id ORDER BY frame_id)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
agg AS (SELECT video_id, island, min(frame_id) AS s, max(frame_id) AS e, max(score) AS m FROM runs GROUP BY 1, 2),
chosen AS (SELECT video_id, arg_max(s, (m, -s)) AS start_frame, arg_max(e, (m, -s)) AS end_frame FROM agg GROUP BY 1),
inside AS (SELECT n.* FROM near_ n JOIN chosen USING (video_id) WHERE frame_id BETWEEN start_frame AND end_frame),
x AS (SELECT *, {_sql_minmax('score', 'PARTITION BY video_id', '1e-8')} AS x, count(*) OVER (PARTITION BY video_id) AS n FROM inside),
y AS (SELECT *, greatest(coalesce(lag(x) OVER w, 0), coalesce(lead(x) OVER w, 0)) AS beside, row_number() OVER (PARTITION BY video_id ORDER BY x DESC, pos) AS nth FROM x WINDOW w AS (PARTITION BY video_id ORDER BY pos)),
ev AS (SELECT video_id, avg(x) FILTER (nth <= greatest(1, ceil(0.20 * n))) + 0.05 * max(beside) FILTER (nth = 1) AS score FROM y GROUP BY 1)
SELECT CAST(1 AS BIGINT) AS query_id, video_id, best_frame_id AS coarse_frame_id, start_frame, end_frame, (SELECT arg_max(frame_id, (score, -pos)) FROM near_ n WHERE n.video_id = c.video_id) AS semantic_keyframe, round(ev.score, 6) AS score
FROM coarse c JOIN chosen USING (video_id) JOIN ev USING (video_id)""")
def localize_scored(spark, sf):
    return temporal.localize(_coarse(spark, sf), _dense(spark, sf), TemporalScoreConfig(max_gap=_GAP), 72).withColumns(_r("score"))


@query(f"""{_COARSE}, c AS (SELECT video_id, best_frame_id + 7 AS c, multimodal_score FROM coarse), total AS (SELECT video_id, max(frame_id) + 3 AS n FROM dense GROUP BY 1)
SELECT CAST(1 AS BIGINT) AS query_id, c.video_id, max(c) AS coarse_frame_id, max(c - 24) AS start_frame, max(least(n - 1, c + 24)) AS end_frame, arg_min(frame_id, (abs(frame_id - c), frame_id)) AS semantic_keyframe, round(max(multimodal_score), 6) AS score
FROM c JOIN total USING (video_id) JOIN dense d ON d.video_id = c.video_id AND frame_id BETWEEN c - 24 AND least(n - 1, c + 24) GROUP BY c.video_id""")
def localize_unscored(spark, sf):
    dense, coarse = _dense(spark, sf), _coarse(spark, sf).withColumn("best_frame_id", F.col("best_frame_id") + 7)
    counts = dense.groupBy("video_id").agg((F.max("frame_id") + 3).alias("frame_count"))
    return temporal.localize(coarse, None, observed=dense, frame_counts=counts).withColumns(_r("score"))


def _shown(path: str, ids: list[int]):
    """A stand-in for a decoder: a frame shows its number, and the path ends with the number of the last one."""
    last = int(path.rpartition(":")[2])
    return ((i, str(i).encode()) for i in ids if i <= last)


def _likeness(content: bytes, asked: list[dict]) -> list[float]:
    """A stand-in for a scorer: a number that depends on the frame and the query."""
    return [(int(content) * 7919 + a["query_id"] * 104729) % 1000 / 1000 for a in asked]


@query(f"""{_DENSE}, middle AS (SELECT video_id, (max(pos) + 1) // 2 AS pos, max(frame_id) + 3 AS last FROM dense GROUP BY 1),
c AS (SELECT q.query_id, video_id, frame_id + 10 * (q.query_id - 1) AS best_frame_id, last FROM dense JOIN middle USING (video_id, pos), (SELECT unnest([1, 2, 3]) AS query_id) q),
ids AS (SELECT query_id, video_id, last, best_frame_id, unnest(list_transform(range(0, 20), lambda i: best_frame_id - 24 + CASE WHEN i = 19 THEN 48 ELSE CAST(floor(i * (48 / 19.0::DOUBLE)) AS BIGINT) END)) AS frame_id FROM c),
near_ AS (SELECT query_id, video_id, best_frame_id, frame_id, (frame_id * 7919 + query_id * 104729) % 1000 / 1000.0::DOUBLE AS score FROM ids WHERE frame_id <= last),
marked AS (SELECT *, CASE WHEN frame_id - lag(frame_id) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM near_ WINDOW w AS (PARTITION BY query_id, video_id ORDER BY frame_id)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, video_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS island FROM marked),
agg AS (SELECT query_id, video_id, island, min(frame_id) AS s, max(frame_id) AS e, max(score) AS m FROM runs GROUP BY 1, 2, 3),
chosen AS (SELECT query_id, video_id, arg_max(s, (m, -s)) AS start_frame, arg_max(e, (m, -s)) AS end_frame FROM agg GROUP BY 1, 2),
inside AS (SELECT n.* FROM near_ n JOIN chosen USING (query_id, video_id) WHERE frame_id BETWEEN start_frame AND end_frame),
x AS (SELECT *, {_sql_minmax('score', 'PARTITION BY query_id, video_id', '1e-8')} AS x, count(*) OVER (PARTITION BY query_id, video_id) AS n FROM inside),
y AS (SELECT *, greatest(coalesce(lag(x) OVER w, 0), coalesce(lead(x) OVER w, 0)) AS beside, row_number() OVER (PARTITION BY query_id, video_id ORDER BY x DESC, frame_id) AS nth FROM x WINDOW w AS (PARTITION BY query_id, video_id ORDER BY frame_id)),
ev AS (SELECT query_id, video_id, avg(x) FILTER (nth <= greatest(1, ceil(0.20 * n))) + 0.05 * max(beside) FILTER (nth = 1) AS score FROM y GROUP BY 1, 2),
peak AS (SELECT query_id, video_id, max(best_frame_id) AS best_frame_id, arg_max(frame_id, (score, -frame_id)) AS semantic_keyframe FROM near_ GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS query_id, video_id, best_frame_id AS coarse_frame_id, start_frame, end_frame, semantic_keyframe, round(ev.score, 6) AS score FROM peak JOIN chosen USING (query_id, video_id) JOIN ev USING (query_id, video_id)""")
def fine_scored(spark, sf):
    """Three queries' windows in every user's hours, decoded once and scored for each of them, and localised."""
    dense = _dense(spark, sf)
    videos = dense.groupBy("video_id").agg(F.concat_ws(":", "video_id", (F.max("frame_id") + 3)).alias("video_path"))
    one = _coarse(spark, sf).drop("query_id")
    asked = one.withColumn("query_id", F.explode(F.array(*(F.lit(q).cast("long") for q in (1, 2, 3)))))
    asked = asked.withColumn("best_frame_id", F.col("best_frame_id") + 10 * (F.col("query_id") - 1))
    scores = decoding.score_decoded(asked, videos, lambda: _shown, lambda: _likeness, (), max_decode=20)
    return temporal.localize(asked, scores, TemporalScoreConfig(max_gap=2), max_decode=20).withColumns(_r("score"))


def _matrix(spark, sf) -> DataFrame:
    """Three event types by twelve four-hour parts of two days, per hundred users: the largest value, or 0."""
    e = _t(spark, sf, "events").select((F.col("user_id") % 50).alias("seq_id"), F.expr("CAST(unix_seconds(cast(ts AS timestamp)) div 14400 % 12 AS BIGINT)").alias("frame_pos"), "event_type", "value")
    cells = e.groupBy("seq_id", "frame_pos").agg(*(F.coalesce(F.max(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0)).alias(str(i)) for i, t in enumerate(("view", "click", "purchase"), 1)))
    long = cells.select("seq_id", "frame_pos", F.explode(F.array(*(F.struct(F.lit(i).alias("event_ord"), F.col(str(i)).alias("score")) for i in (1, 2, 3)))).alias("c"))
    return long.select("seq_id", "frame_pos", F.col("c.event_ord").alias("event_ord"), (F.col("frame_pos") + 100).alias("frame_id"), F.col("c.score").alias("score"))


@query("""WITH cells AS (SELECT user_id % 50 AS seq_id, epoch_us(ts) // 14400000000 % 12 AS p, coalesce(max(value) FILTER (event_type = 'view'), 0) AS a, coalesce(max(value) FILTER (event_type = 'click'), 0) AS b, coalesce(max(value) FILTER (event_type = 'purchase'), 0) AS c FROM events GROUP BY 1, 2),
ord AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY p) AS n FROM cells),
best AS (SELECT x.seq_id, concat_ws(' ', x.p + 100, y.p + 100, z.p + 100) AS frames, x.a + y.b + z.c AS score, row_number() OVER (PARTITION BY x.seq_id ORDER BY x.a + y.b + z.c DESC, z.n, x.a + y.b DESC, y.n, x.a DESC, x.n) AS nth
  FROM ord x JOIN ord y ON x.seq_id = y.seq_id AND x.n + 1 <= y.n JOIN ord z ON y.seq_id = z.seq_id AND y.n + 1 <= z.n)
SELECT seq_id, frames, round(score, 6) AS score FROM best WHERE nth = 1""")
def monotonic_alignment(spark, sf):
    return temporal.align_events(_matrix(spark, sf), 3, 1).select("seq_id", F.array_join(F.transform("frames", lambda f: f.cast("string")), " ").alias("frames"), F.round("score", 6).alias("score"))


@query(_SQL["monotonic_alignment"])
def alignment_long(spark, sf):
    """The same by back pointers, in blocks of positions."""
    made = temporal.align_long(_matrix(spark, sf), 3, 1, block=5)
    return made.select("seq_id", F.array_join(F.transform("frames", lambda f: f.cast("string")), " ").alias("frames"), F.round("score", 6).alias("score"))


# evaluation --------------------------------------------------------------------------------------


_TRUTH = f"{_SUBMITTED}, truth AS (SELECT vec_id AS query_id, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS gt_video FROM embeddings WHERE vec_id % 100 = 0), graded AS (SELECT *, video_id = gt_video AS relevant, CASE WHEN video_id = gt_video AND best_frame_id BETWEEN 0 AND 900 THEN 1.0 ELSE 0.0 END AS r_score, abs(best_frame_id - 450) <= 200 AS frame_hit FROM submitted JOIN truth USING (query_id))"


def _graded(spark, sf) -> DataFrame:
    truth = _frames(spark, sf).where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("video_id").alias("gt_video"))
    rows = _submitted(spark, sf).join(truth, "query_id")
    kis = S.kis(F.col("video_id"), F.col("best_frame_id"), F.col("gt_video"), F.lit(0), F.lit(900))
    hit = evaluate.frame_hit(F.col("best_frame_id"), F.array(F.lit(450)), 200)
    return rows.withColumns({"relevant": F.col("video_id") == F.col("gt_video"), "r_score": kis, "frame_hit": hit, "has_ground_truth": F.lit(True)})


@query(f"{_TRUTH} SELECT query_id, rank, r_score FROM graded")
def kis_rscore(spark, sf):
    return _graded(spark, sf).select("query_id", "rank", "r_score")


@query(f"{_TRUTH} SELECT query_id, rank, CASE WHEN r_score = 1 AND lower(trim(' ' || video_id)) = lower(gt_video) THEN 1.0 ELSE 0.0 END AS r_score FROM graded")
def qa_rscore(spark, sf):
    c = F.col
    made = S.qa(c("video_id"), c("best_frame_id"), F.concat(F.lit(" "), c("video_id")), c("gt_video"), F.lit(0), F.lit(900), c("gt_video"))
    return _graded(spark, sf).select("query_id", "rank", made.alias("r_score"))


@query("""WITH e AS (SELECT o_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS f, l_linenumber * 10 AS hi, o_custkey % 3 AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, round(CASE WHEN v = 0 THEN avg(CASE WHEN f BETWEEN 0 AND hi THEN 1.0 ELSE 0.0 END) ELSE 0 END, 6) AS r_score FROM e GROUP BY o_orderkey, v""")
def trake_rscore(spark, sf):
    rows = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    event = F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("f"), F.struct(F.lit(0).alias("s"), (F.col("l_linenumber") * 10).alias("e")).alias("i"))
    made = rows.groupBy("o_orderkey", (F.col("o_custkey") % 3).alias("v")).agg(F.array_sort(F.collect_list(event)).alias("x"))
    score = S.trake(F.col("v"), F.transform("x", lambda e: e["f"]), F.lit(0), F.transform("x", lambda e: e["i"]))
    return made.select("o_orderkey", F.round(score, 6).alias("r_score"))


@query(f"{_TRUTH}, p AS (SELECT query_id, {', '.join(f'coalesce(max(r_score) FILTER (rank <= {k}), 0) AS r_at_{k}' for k in evaluate.KS)} FROM graded GROUP BY 1) SELECT *, round((r_at_1 + r_at_5 + r_at_20 + r_at_50 + r_at_100) / 5, 6) AS final_score FROM p")
def r_at_k_profile(spark, sf):
    return evaluate.ranking_profile(_graded(spark, sf)).withColumns(_r("final_score"))


@query(f"{_TRUTH} SELECT query_id, coalesce(max(CASE WHEN relevant THEN 1.0 ELSE 0.0 END) FILTER (rank <= 1), 0) AS recall_at_1, coalesce(max(CASE WHEN relevant THEN 1.0 ELSE 0.0 END) FILTER (rank <= 5), 0) AS recall_at_5, round(coalesce(1.0 / min(rank) FILTER (relevant), 0), 6) AS mrr, coalesce(max(CASE WHEN frame_hit THEN 1.0 ELSE 0.0 END) FILTER (rank <= 5), 0) AS frame_recall_at_5 FROM graded GROUP BY query_id")
def recall_and_mrr(spark, sf):
    return _graded(spark, sf).groupBy("query_id").agg(evaluate.recall_at(1).alias("recall_at_1"), evaluate.recall_at(5).alias("recall_at_5"), F.round(evaluate.reciprocal_rank(), 6).alias("mrr"), evaluate.recall_at(5, "frame_hit").alias("frame_recall_at_5"))


@query(f"""{_TRUTH}, q AS (SELECT query_id, max(round(rank_score, 9)) FILTER (rank = 1) - max(round(rank_score, 9)) FILTER (rank = 2) AS gap, coalesce(1.0 / min(rank) FILTER (relevant), 0) AS mrr, coalesce(max(CASE WHEN relevant THEN 1.0 ELSE 0.0 END) FILTER (rank <= 5), 0) AS r5, coalesce(max(CASE WHEN frame_hit THEN 1.0 ELSE 0.0 END) FILTER (rank <= 5), 0) AS f5 FROM graded GROUP BY 1)
SELECT count(*) AS queries, count(*) AS with_ground_truth, round(avg(gap), 6) AS mean_gap, round(avg(mrr), 6) AS mrr, round(avg(r5), 6) AS recall_at_5, round(avg(f5), 6) AS frame_recall_at_5 FROM q""")
def benchmark_summary(spark, sf):
    names = ("mean_gap", "mrr", "recall_at_5", "frame_recall_at_5")
    return evaluate.summary(evaluate.per_query(_graded(spark, sf), (5,)), (5,)).withColumns(_r(*names)).select("queries", "with_ground_truth", *names)


@query(f"{_SUBMITTED} SELECT query_id, count(*) AS candidates, round(max(rank_score) FILTER (rank = 1), 6) AS top1_score, round(max(rank_score) FILTER (rank = 2), 6) AS top2_score, round(max(round(rank_score, 9)) FILTER (rank = 1) - max(round(rank_score, 9)) FILTER (rank = 2), 6) AS top1_top2_gap FROM submitted GROUP BY 1")
def top1_top2_gap(spark, sf):
    return evaluate.per_query(_graded(spark, sf)).withColumns(_r("top1_score", "top2_score", "top1_top2_gap")).select("query_id", "candidates", "top1_score", "top2_score", "top1_top2_gap")


@query(f"""{_SUBMITTED}, truth AS (SELECT vec_id AS query_id, 'V' || lpad(CAST(label AS VARCHAR), 3, '0') AS gt FROM embeddings WHERE vec_id % 200 = 0),
g AS (SELECT s.*, gt IS NOT NULL AS known, video_id = gt AS relevant, video_id = gt AND abs(best_frame_id - 450) <= 300 AS hit FROM submitted s LEFT JOIN truth USING (query_id)),
q AS (SELECT query_id, bool_or(known) AS known, coalesce(1.0 / min(rank) FILTER (relevant), 0) AS mrr, max(CASE WHEN rank <= 1 AND relevant THEN 1.0 ELSE 0 END) AS r1, max(CASE WHEN rank <= 5 AND relevant THEN 1.0 ELSE 0 END) AS r5, max(CASE WHEN rank <= 5 AND hit THEN 1.0 ELSE 0 END) AS f5 FROM g GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (known) AS with_ground_truth, round(avg(mrr) FILTER (known), 6) AS mrr, round(avg(r1) FILTER (known), 6) AS recall_at_1, round(avg(r5) FILTER (known), 6) AS recall_at_5, round(avg(f5) FILTER (known), 6) AS frame_recall_at_5 FROM q""")
def benchmark_plan(spark, sf):
    """The benchmark plan over answers and ground truth of every other query."""
    gt = _frames(spark, sf).where("row_id % 200 = 0")
    truth = gt.select(F.col("row_id").alias("query_id"), F.array("video_id").alias("video_ids"), F.create_map("video_id", F.array(F.lit(450).cast("long"))).alias("frames"))
    names = ("mrr", "recall_at_1", "recall_at_5", "frame_recall_at_5")
    return pipeline.benchmark(_submitted(spark, sf), truth, 300, (1, 5))[1].withColumns(_r(*names)).select("queries", "with_ground_truth", *names)


# learning to rank --------------------------------------------------------------------------------


_LTR = ("retrieval_score", "retrieval_best_score", "retrieval_topk_mean", "retrieval_score_std")


@query(f"{_BASE} SELECT query_id, video_id, {', '.join(f'round(({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({f}) OVER () END, 6) AS {f}' for f in _LTR)} FROM videos")
def ltr_features(spark, sf):
    made = fuse.ltr_features(search.video_evidence(_hits(spark, sf), 5, ("query_id",)), _LTR)
    return made.select("query_id", "video_id", *(F.round(f, 6).alias(f) for f in _LTR))


@query(f"{_BASE} SELECT query_id, video_id, round({' + '.join(f'{w} * (({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({f}) OVER () END)' for f, w in zip(_LTR, (0.4, 0.3, 0.2, -0.1), strict=True))}, 6) AS learned_rank_score FROM videos")
def ltr_score(spark, sf):
    made = fuse.ltr_features(search.video_evidence(_hits(spark, sf), 5, ("query_id",)), _LTR)
    return fuse.ltr_score(made, [0.4, 0.3, 0.2, -0.1], _LTR).select("query_id", "video_id", F.round("learned_rank_score", 6).alias("learned_rank_score"))


@query(f"{_TRUTH}, r AS (SELECT query_id, video_id, CAST(relevant AS INTEGER) AS y FROM graded) SELECT a.query_id, a.video_id AS better, b.video_id AS worse FROM r a JOIN r b USING (query_id) WHERE a.y > b.y")
def pairwise_pairs(spark, sf):
    return fuse.ordered_pairs(_graded(spark, sf).withColumn("relevance", F.col("relevant").cast("int")))


# manifests and audits ----------------------------------------------------------------------------


@query("SELECT CASE WHEN lower(event_type) LIKE 'trake%' THEN 'TRAKE' WHEN lower(event_type) LIKE 'qa%' THEN 'QA' WHEN lower(event_type) LIKE 'tkis%' THEN 'TKIS' ELSE 'UNKNOWN' END AS task_type, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'TKIS-' WHEN 'view' THEN 'qa-' WHEN 'purchase' THEN 'trake-' ELSE 'vkis-' END || event_id AS event_type FROM events) GROUP BY 1")
def task_type_counts(spark, sf):
    name = F.when(F.col("event_type") == "click", "TKIS-").when(F.col("event_type") == "view", "qa-").when(F.col("event_type") == "purchase", "trake-").otherwise("vkis-")
    return _t(spark, sf, "events").groupBy(X.task_type(F.concat(name, F.col("event_id").cast("string"))).alias("task_type")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type FROM events WHERE starts_with(event_type, 'cl') OR starts_with(event_type, 'pur')")
def prefix_filter(spark, sf):
    return _t(spark, sf, "events").where(X.has_prefix(F.col("event_type"), ["cl", "pur"])).select("event_id", "event_type")


@query("SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_keep_first(spark, sf):
    return manifest.keep_first(_t(spark, sf, "documents"), ["text"], ["doc_id"]).select(F.md5("text").alias("text_key"), "doc_id")


def _lines(spark, sf, parity: int) -> DataFrame:
    rows = _t(spark, sf, "lineitem").where(F.col("l_linenumber") % 2 == parity).select(F.col("l_orderkey").alias("video_id"), "l_linenumber", "l_partkey")
    return manifest.ordinal(rows, "video_id", "l_linenumber", "l_partkey")


_LINES = "WITH a AS (SELECT l_orderkey AS video_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem WHERE l_linenumber % 2 = 1), b AS (SELECT l_orderkey AS video_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos FROM lineitem WHERE l_linenumber % 2 = 0)"


@query(f"{_LINES} SELECT video_id, pos, a.l_partkey AS odd_part, b.l_partkey AS even_part, o_custkey FROM a JOIN b USING (video_id, pos) JOIN orders ON o_orderkey = video_id WHERE pos = 0")
def manifest_align(spark, sf):
    """Odd and even lines of an order, and the order, which has one row, by position."""
    a, b = (_lines(spark, sf, p).select("video_id", F.col("pos").cast("long").alias("pos"), F.col("l_partkey").alias(n)) for p, n in ((1, "odd_part"), (0, "even_part")))
    return manifest.align(a, b, _t(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.lit(0).cast("long").alias("pos"), "o_custkey"))


@query(f"WITH {_FRAMES} SELECT row_number() OVER (ORDER BY video_id, keyframe_idx DESC) - 1 AS row_id, video_id, CAST(1000 - keyframe_idx AS BIGINT) AS keyframe_idx, round(v[1], 6) AS first FROM frames WHERE keyframe_idx % 2 = 0")
def ordered_matrix(spark, sf):
    """Every other vector of a video, backwards."""
    frames = _frames(spark, sf)
    vectors = frames.select("video_id", (F.col("keyframe_idx") - 1).alias("pos"), "embedding")
    rows = frames.where("keyframe_idx % 2 = 0").select("video_id", (1000 - F.col("keyframe_idx")).alias("keyframe_idx"), (F.col("keyframe_idx") - 1).alias("clip_idx"))
    made = manifest.ordered_matrix(rows, vectors, 64)
    return made.select("row_id", "video_id", "keyframe_idx", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query(f"{_LINES}, c AS (SELECT video_id, count(*) AS odd FROM a GROUP BY 1), d AS (SELECT video_id, count(*) AS even FROM b GROUP BY 1) SELECT video_id, coalesce(odd, 0) AS odd, coalesce(even, 0) AS even FROM c FULL JOIN d USING (video_id) WHERE coalesce(odd, 0) <> coalesce(even, 0)")
def manifest_align_errors(spark, sf):
    return manifest.align_errors({"odd": _lines(spark, sf, 1), "even": _lines(spark, sf, 0)})


@query("""WITH m AS (SELECT l_orderkey AS video_id, l_linenumber - 1 AS k, l_partkey AS f, CASE WHEN l_suppkey % 7 <> 0 THEN l_extendedprice END AS t, CASE WHEN l_quantity > 45 THEN 0 ELSE l_linenumber - 1 END AS i FROM lineitem),
o AS (SELECT *, row_number() OVER w - 1 AS nth, lag(f) OVER w AS f0, lag(t) OVER w AS t0, count(*) OVER (PARTITION BY video_id, k) > 1 AS again FROM m WINDOW w AS (PARTITION BY video_id ORDER BY k, f, t NULLS FIRST)),
e AS (SELECT video_id, bool_or(again) AS a, bool_or(f IS NULL) AS b, bool_or(f < f0) AS c, bool_or(k <> nth) AS d, bool_or(t IS NULL) AS g, bool_or(t < t0) AS h, bool_or(i <> k) AS j FROM o GROUP BY 1)
SELECT video_id, 'duplicate keyframe_idx' AS error FROM e WHERE a UNION ALL SELECT video_id, 'null original_frame_id' FROM e WHERE b UNION ALL SELECT video_id, 'original_frame_id falls' FROM e WHERE c UNION ALL SELECT video_id, 'keyframe_idx not contiguous' FROM e WHERE d
UNION ALL SELECT video_id, 'null pts_time' FROM e WHERE g UNION ALL SELECT video_id, 'pts_time falls' FROM e WHERE h UNION ALL SELECT video_id, 'clip_idx differs from keyframe_idx' FROM e WHERE j""")
def manifest_validate(spark, sf):
    c = F.col
    time, clip = F.when(c("l_suppkey") % 7 != 0, c("l_extendedprice")), F.when(c("l_quantity") > 45, 0).otherwise(c("l_linenumber") - 1)
    rows = _t(spark, sf, "lineitem").select(c("l_orderkey").alias("video_id"), (c("l_linenumber") - 1).alias("keyframe_idx"), c("l_partkey").alias("original_frame_id"), time.alias("pts_time"), clip.alias("clip_idx"), F.lit("").alias("image_path"))
    return manifest.validate(rows)


@query("SELECT user_id, count(*) FILTER (value < before) AS n_falls FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
def monotonic_check(spark, sf):
    return manifest.falls(_t(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")


@query("SELECT DISTINCT l_orderkey FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem) WHERE l_linenumber IS DISTINCT FROM nth")
def contiguity_check(spark, sf):
    return manifest.not_contiguous(_t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return manifest.duplicate_keys(_t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS rows, count(DISTINCT source) AS keys, count(*) FILTER (trim(coalesce(text, '')) <> '') AS non_empty FROM documents")
def audit_counts(spark, sf):
    return manifest.audit_counts(_t(spark, sf, "documents"), "source", "text")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def top20_counts(spark, sf):
    return manifest.most_common(_t(spark, sf, "lineitem"), "l_partkey")


@query("SELECT p_partkey, p_name || ' ' || p_type AS text FROM part")
def json_text_flatten(spark, sf):
    doc = F.to_json(F.struct(F.col("p_name").alias("Name"), F.struct(F.array(F.struct(F.col("p_type").alias("label"), F.col("p_size").alias("size"))).alias("items")).alias("more"), F.array(F.lit("dropped")).alias("tags")))
    return _t(spark, sf, "part").select("p_partkey", json_text(doc).alias("text"))


@query("SELECT stem, min(url) AS path, count(*) AS n_paths FROM (SELECT url, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem FROM pages) WHERE stem <> '' GROUP BY stem")
def video_resolver_dups(spark, sf):
    return manifest.resolve_videos(_t(spark, sf, "pages"), "url")
