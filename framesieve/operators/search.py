"""Exact vector search: one query by a literal, many by blocks of a matrix product; videos from frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.vector import cosine
from ..steps import written

#: Queries that one scan of the frames holds at most, and hits that a task keeps for them: what is broadcast, and what a
#: task holds, are bounded.  Further queries come in further scans; a matrix product takes TILE of them at once.
BLOCK, KEPT, TILE = 8192, 2_000_000, 1024


def search_frames(frames: DataFrame, query: list[float], top_k: int = 100, embedding: str = "embedding") -> DataFrame:
    """The top_k rows by cosine with the query, ties by row_id: a projection and TakeOrderedAndProject."""
    if not query or not any(query):
        raise ValueError("the query vector is empty or zero")
    literal = F.array(*(F.lit(float(x)) for x in query))
    return frames.withColumn("score", cosine(F.col(embedding), literal)).orderBy(F.desc("score"), "row_id").limit(max(1, top_k))


def search_batch(frames: DataFrame, queries: DataFrame, top_k: int, embedding: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, row_id, score, rank, carry): top_k rows of frames for every row of queries (query_id, vector), with
    columns of the frames that come along.

    Queries are dealt by a hash into blocks, each of which is broadcast for one scan; there, tasks multiply their
    rows with tiles of the block and keep their own top_k per query, and a window over these picks the result.
    Where there are several blocks, each one's result is written before the next is sent, and what was sent is let go.
    A zero vector, or one of another width, is an error.
    """
    rows = queries.select("query_id", "vector")
    spark, out = frames.sparkSession, None
    blocks = -(-rows.count() // max(1, min(BLOCK, KEPT // max(1, top_k)))) or 1
    cells = frames.select("row_id", F.col(embedding).alias("v"), *carry)
    schema = T.StructType([queries.schema["query_id"], T.StructField("row_id", T.LongType()), T.StructField("score", T.DoubleType()), *(frames.schema[c] for c in carry)])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    for i in range(blocks):
        taken = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect() if blocks > 1 else rows.collect()
        ids = [r[0] for r in taken]
        matrix = np.array([r[1] for r in taken], float).reshape(len(ids), -1 if len(ids) else 0)
        block = spark.sparkContext.broadcast((ids, _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            names, vectors = block.value
            best: list[pa.Table] = []
            for batch in batches:
                n = batch.num_rows
                if not n or not len(names):
                    continue
                x = _unit(_matrix(batch.column("v"), n))
                held = batch.drop_columns(["v"])
                keep = min(top_k, n)
                for low in range(0, len(names), TILE):
                    s = x @ vectors[low : low + TILE].T
                    # ties at the edge of the batch's own top_k must not be cut: take all that reach its last score
                    edge = np.partition(s, n - keep, axis=0)[n - keep]
                    at, q = np.nonzero(s >= edge)
                    made = pa.Table.from_batches([held.take(pa.array(at))])
                    best.append(made.append_column("q", pa.array(low + q)).append_column("score", pa.array(s[at, q])))
                if len(best) > 16 + len(names) // TILE:
                    best = [_top(pa.concat_tables(best), top_k)]
            if best:
                made = _top(pa.concat_tables(best), top_k)
                asked = pa.array(names).take(made.column("q").combine_chunks())
                columns = [asked, *(made.column(c).combine_chunks() for c in schema.names[1:])]
                yield from pa.Table.from_arrays(columns, schema.names).to_batches(4096)

        made = cells.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= top_k)
        if blocks > 1:
            made = written(made)
            block.unpersist()
        out = made if out is None else out.unionByName(made)
    return out.select("query_id", "row_id", "score", "rank", *carry)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat, sizes = column.flatten(), np.asarray(pc.list_value_length(column).fill_null(0))
    if flat.null_count or sizes.min() != sizes.max():
        raise ValueError("vectors of several widths, or with nulls")
    return np.asarray(flat).astype(float).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    if not (norms > 0).all():
        raise ValueError("zero-norm vector")
    return x / norms


def _top(hits: pa.Table, k: int) -> pa.Table:
    q = hits.column("q").to_numpy()
    order = np.lexsort((hits.column("row_id").to_numpy(), -hits.column("score").to_numpy(), q))
    q = q[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return hits.take(pa.array(order[nth < k]))


def best_frames(hits: DataFrame, per_video: int, *keys: str) -> DataFrame:
    order = W.partitionBy(*keys, "video_id").orderBy(F.desc("score"), "row_id")
    return hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_video)


def search_videos(hits: DataFrame, aggregation: str = "max", per_video_k: int = 3, top_k: int = 100, keys: tuple[str, ...] = ()) -> DataFrame:
    """Videos of frame hits by their best score or the mean of their best, with their best frame: the first top_k, of
    every query where keys name it."""
    if aggregation not in ("max", "topk_mean"):
        raise ValueError(f"unknown aggregation: {aggregation}")
    kept = best_frames(hits, 1 if aggregation == "max" else per_video_k, *keys)
    best = F.max_by(F.struct("keyframe_idx", "original_frame_id", "pts_time"), F.struct("score", -F.col("row_id")))
    videos = kept.groupBy(*keys, "video_id").agg((F.max if aggregation == "max" else F.avg)("score").alias("video_score"), best.alias("b"))
    found = videos.select(*keys, "video_id", "video_score", F.col("b.keyframe_idx").alias("best_frame_idx"), F.col("b.original_frame_id").alias("best_frame_id"), F.col("b.pts_time").alias("best_pts_time"))
    if not keys:
        return found.orderBy(F.desc("video_score"), "video_id").limit(top_k)
    order = W.partitionBy(*keys).orderBy(F.desc("video_score"), "video_id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top_k).drop("nth")


def video_evidence(hits: DataFrame, per_video_k: int = 5, keys: tuple[str, ...] = (), prefix: str = "retrieval") -> DataFrame:
    """Videos of frame hits: 0.75 of the best score and 0.25 of the mean of the best per_video_k, and their spread."""
    kept = best_frames(hits, per_video_k, *keys)
    extra = [c for c in ("image_path", "object_path") if c in hits.columns]
    best = F.max_by(F.struct("keyframe_idx", "original_frame_id", "pts_time", *extra), F.struct("score", -F.col("row_id")))
    videos = kept.groupBy(*keys, "video_id").agg(
        F.max("score").alias(f"{prefix}_best_score"), F.avg("score").alias(f"{prefix}_topk_mean"), F.stddev_pop("score").alias(f"{prefix}_score_std"), best.alias("b"),
    )
    blend = 0.75 * F.col(f"{prefix}_best_score") + 0.25 * F.col(f"{prefix}_topk_mean")
    return videos.select(
        *keys, "video_id", blend.alias(f"{prefix}_score"), f"{prefix}_best_score", f"{prefix}_topk_mean", f"{prefix}_score_std",
        F.col("b.keyframe_idx").alias("best_frame_idx"), F.col("b.original_frame_id").alias("best_frame_id"), F.col("b.pts_time").alias("best_pts_time"), *(F.col(f"b.{c}").alias(c) for c in extra),
    )


#: The only metric: inner product of unit vectors.
METRIC = "inner_product"


def index_contract(vectors: DataFrame, id_column: str = "row_id", embedding: str = "embedding") -> DataFrame:
    """One row: size, smallest and largest id, width, whether ids are exactly 0 to n - 1, zero vectors and metric."""
    return vectors.agg(
        F.count("*").alias("size"), F.min(id_column).alias("id_min"), F.max(id_column).alias("id_max"), F.min(F.size(embedding)).cast("long").alias("dim_min"), F.max(F.size(embedding)).cast("long").alias("dim_max"),
        ((F.count("*") == F.count_distinct(id_column)) & (F.coalesce(F.min(id_column), F.lit(0)) == 0) & (F.coalesce(F.max(id_column), F.lit(-1)) == F.count("*") - 1)).alias("sequential"),
        F.count_if(F.forall(embedding, lambda x: x == 0)).alias("zero_vectors"), F.lit(METRIC).alias("metric"),
    )


def check_index(vectors: DataFrame, metadata: dict, rows: int | None = None) -> DataFrame:
    """vectors themselves, once they keep the contract: ids 0 to n - 1, one width, no zero vector, and as many rows, as
    wide and by the metric that the metadata (and the manifest's row count) say; a ValueError names what they don't."""
    found = index_contract(vectors).first()
    wrong = []
    if not found["sequential"]:
        wrong.append("ids are not 0 to n - 1")
    if found["dim_min"] != found["dim_max"] or metadata.get("dimension", found["dim_max"]) != found["dim_max"]:
        wrong.append(f"dimension {found['dim_min']} to {found['dim_max']}, {metadata.get('dimension')} wanted")
    if any(n is not None and n != found["size"] for n in (metadata.get("rows"), rows)):
        wrong.append(f"{found['size']} rows, {metadata.get('rows')} in the metadata, {rows} in the manifest")
    if found["zero_vectors"]:
        wrong.append("zero-norm vector")
    if metadata.get("metric", METRIC) != METRIC:
        wrong.append(f"metric {metadata['metric']}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return vectors
