"""Exact search that reads a part of the vectors: cells around pivots, pruned by the triangle inequality of angles.

An index is a folder: `vectors`, the rows partitioned by cell, each in the cell of its nearest pivot, and `cells`, of every cell
its pivot, its number of rows and its radius, the largest angle between pivot and row.  No row of a cell is nearer to a query
than the angle between query and pivot less the radius, so that once a query has top_k scores, cells whose bound is below the
last of them hold nothing for it.  A search goes in rounds: every query looks into its most promising cells, twice as many as in
the round before; a round reads the files of the cells that any query still wants, and multiplies each cell's rows with just
these queries; the last of each query's scores so far prunes the next round.  It ends when no query wants a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..steps import written
from .search import _matrix, _top, _unit

#: Cells of an index and numbers of all pivots at most, rows of one file, queries of one pass, and what rounding may take
#: from an angle.
CELLS, NUMBERS, FILE_ROWS, BLOCK, SLACK = 16_384, 1 << 23, 100_000, 1024, 1e-6


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def build(frames: DataFrame, path: str, cells: int | None = None, embedding: str = "embedding") -> None:
    """Writes the index of frames (row_id, embedding, …) to a folder.  Pivots are rows chosen by a hash of their id: about
    the square root of all, or as many as said."""
    spark = frames.sparkSession
    total, width = frames.count(), len((frames.select(embedding).first() or [[]])[0])
    n = max(1, min(cells or round(total**0.5), CELLS, NUMBERS // max(1, width)))
    chosen = frames.select("row_id", F.col(embedding).alias("v")).orderBy(F.xxhash64("row_id"), "row_id").limit(n).collect()
    pivots = _unit(np.array([r.v for r in chosen], float).reshape(len(chosen), width))
    held = spark.sparkContext.broadcast(pivots)
    schema = T.StructType([*frames.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = _angles(_unit(_matrix(batch.column(embedding), batch.num_rows)), held.value)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], schema.names)

    placed = written(frames.mapInArrow(run, schema))
    found = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    of = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(pivots)], "cell int, pivot array<double>")
    found = written(found.join(of, "cell"))
    found.write.mode("overwrite").parquet(f"{path}/cells")
    # a cell of many rows is several files, so that none is one task's
    parts = found.select("cell", F.ceil(F.col("rows") / FILE_ROWS).alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("row_id"), "parts"))
    dealt.repartition("cell", "part").select(*frames.columns, "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")


@dataclass
class Found:
    """hits: (query_id, row_id, score, rank, carry); read: of every round the cells that it read."""

    hits: DataFrame
    read: list[list[int]] = field(default_factory=list)


def _bounds(vectors: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(queries, cells) largest cosines that rows of the cells may have."""
    return np.cos(np.maximum(_angles(vectors, pivots) - radius - SLACK, 0))


def _round(rows: DataFrame, names: list, vectors: np.ndarray, wants: dict[int, np.ndarray], top_k: int, kind: T.StructField, carry: tuple[str, ...], embedding: str) -> DataFrame:
    """The top_k of each query among the rows of the cells that it wants."""
    schema = T.StructType([kind, T.StructField("row_id", T.LongType()), T.StructField("score", T.DoubleType()), *(rows.schema[c] for c in carry)])
    held = rows.sparkSession.sparkContext.broadcast((names, vectors, wants))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, wants = held.value
        best: list[pa.Table] = []
        for batch in batches:
            cells = np.asarray(batch.column("cell"))
            for cell in np.unique(cells).tolist():
                at = np.flatnonzero(cells == cell)
                part = batch.take(pa.array(at))
                x, asked = _unit(_matrix(part.column("v"), len(at))), wants[cell]
                s = x @ vectors[asked].T
                keep = min(top_k, len(at))
                edge = np.partition(s, len(at) - keep, axis=0)[len(at) - keep]
                row, q = np.nonzero(s >= edge)
                made = pa.Table.from_batches([part.drop_columns(["v", "cell"]).take(pa.array(row))])
                best.append(made.append_column("q", pa.array(asked[q])).append_column("score", pa.array(s[row, q])))
            if len(best) > 64:
                best = [_top(pa.concat_tables(best), top_k)]
        if best:
            made = _top(pa.concat_tables(best), top_k)
            asked = pa.array(names).take(made.column("q").combine_chunks())
            yield from pa.Table.from_arrays([asked, *(made.column(c).combine_chunks() for c in schema.names[1:])], schema.names).to_batches(4096)

    return rows.select("row_id", F.col(embedding).alias("v"), "cell", *carry).mapInArrow(run, schema)


def search(spark: SparkSession, path: str, queries: DataFrame, top_k: int, embedding: str = "embedding", carry: tuple[str, ...] = ()) -> Found:
    """What search.search_batch gives for all rows of an index, from the cells that may matter: queries (query_id, vector),
    in passes of at most BLOCK."""
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # at most CELLS rows
    vectors = spark.read.parquet(f"{path}/vectors")
    ids, rows_of = np.array([r.cell for r in table], np.int64), np.array([r.rows for r in table], np.int64)
    pivots, radius = np.array([r.pivot for r in table], float).reshape(len(table), -1), np.array([r.radius for r in table], float)
    asked = queries.select("query_id", "vector")
    blocks = -(-asked.count() // BLOCK) or 1
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    out, found = None, Found(None)
    for b in range(blocks):
        taken = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        names = [r.query_id for r in taken]
        x = _unit(np.array([r.vector for r in taken], float).reshape(len(names), -1 if len(names) else 0))
        bound = _bounds(x, pivots, radius) if len(names) and len(table) else np.zeros((len(names), len(table)))
        left = np.argsort(-bound, axis=1, kind="stable")  # cells by promise
        at, last, hits, width = np.zeros(len(names), np.int64), np.full(len(names), -np.inf), None, 1
        while True:
            wants: dict[int, list[int]] = {}
            for q in range(len(names)):
                rows, stop = 0, min(at[q] + width, len(table))
                while at[q] < len(table) and (at[q] < stop or rows < top_k and not np.isfinite(last[q])):
                    cell = left[q, at[q]]
                    if bound[q, cell] < last[q]:  # nor can any after it
                        at[q] = len(table)
                        break
                    wants.setdefault(int(ids[cell]), []).append(q)
                    rows += rows_of[cell]
                    at[q] += 1
            if not wants and hits is not None:
                break
            found.read.append(sorted(wants))
            chosen = vectors.where(F.col("cell").isin(*wants)) if wants else vectors.limit(0)
            made = _round(chosen, names, x, {c: np.array(q) for c, q in wants.items()}, top_k, queries.schema["query_id"], carry, embedding)
            made = made if hits is None else made.unionByName(hits.drop("rank"))
            hits = written(made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k))
            kth = {r.query_id: r.score for r in hits.where(F.col("rank") == top_k).select("query_id", "score").collect()}
            last = np.array([kth.get(n, -np.inf) for n in names])
            width *= 2
        out = hits if out is None else out.unionByName(hits)
    found.hits = out.select("query_id", "row_id", "score", "rank", *carry)
    return found
