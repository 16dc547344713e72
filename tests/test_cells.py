"""Search by cells against the search of all rows, and how many cells it reads."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesieve import cli
from framesieve.operators import cells, search


def rows(spark, vectors, name="frames"):
    data = [(i, f"V{i % 5}", i // 5, i * 10, None if i % 7 == 0 else i * 0.5, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "row_id long, video_id string, keyframe_idx long, original_frame_id long, pts_time double, embedding array<float>")


def asked(spark, vectors):
    return spark.createDataFrame([(f"q{i}", [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id string, vector array<double>")


def same(df):
    return sorted((r.query_id, r.row_id, round(r.score, 9), r["rank"], r.pts_time) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    return rng, centres, centres[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 16))


@pytest.mark.parametrize("top_k,n", [(1, 40), (10, 40), (150, 12), (5000, 7)])
def test_same_as_all_rows(spark, tmp_path, clustered, top_k, n):
    rng, centres, vectors = clustered
    frames = rows(spark, [*vectors, *vectors[:30]])  # with ties
    cells.build(frames, str(tmp_path / "i"), n)
    queries = asked(spark, [*(centres[:6] + 0.1 * rng.normal(size=(6, 16))), rng.normal(size=16), vectors[3], 5 * vectors[3]])
    found = cells.search(spark, str(tmp_path / "i"), queries, top_k, carry=("pts_time",))
    assert same(found.hits) == same(search.search_batch(frames, queries, top_k, carry=("pts_time",)))
    table = spark.read.parquet(str(tmp_path / "i/cells")).collect()
    assert sum(r["rows"] for r in table) == 2030 and len(table) <= n


def test_reads_few_cells(spark, tmp_path, clustered):
    _, centres, vectors = clustered
    cells.build(rows(spark, vectors), str(tmp_path / "i"), 60)
    n = spark.read.parquet(str(tmp_path / "i/cells")).count()
    found = cells.search(spark, str(tmp_path / "i"), asked(spark, centres[:2]), 5)
    read = {c for r in found.read for c in r}
    assert len(read) < n / 3 and sum(map(len, found.read)) < n / 2
    vectors = spark.read.parquet(str(tmp_path / "i/vectors")).where(F.col("cell").isin(*read))
    assert "PartitionFilters: [isnotnull(cell" in vectors._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [cell" in vectors._jdf.queryExecution().executedPlan().toString()
    assert vectors.select(F.input_file_name()).distinct().count() == len(read)


def test_edges(spark, tmp_path, clustered, monkeypatch):
    _, centres, vectors = clustered
    frames = rows(spark, vectors[:50])
    monkeypatch.setattr(cells, "FILE_ROWS", 10)
    monkeypatch.setattr(cells, "BLOCK", 2)
    cells.build(frames, str(tmp_path / "one"), 1)
    queries = asked(spark, centres[:5])
    assert same(cells.search(spark, str(tmp_path / "one"), queries, 3, carry=("pts_time",)).hits) == same(search.search_batch(frames, queries, 3, carry=("pts_time",)))
    assert cells.search(spark, str(tmp_path / "one"), queries.limit(0), 3).hits.count() == 0
    opposite = rows(spark, [[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]])
    cells.build(opposite, str(tmp_path / "two"), 2)
    assert [r.row_id for r in cells.search(spark, str(tmp_path / "two"), asked(spark, [[1.0, 0.0]]), 2).hits.orderBy("rank").collect()] == [0, 2]
    with pytest.raises(ValueError, match="zero-norm"):
        cells.search(spark, str(tmp_path / "two"), asked(spark, [[0.0, 0.0]]), 2)
    with pytest.raises(Exception, match="zero-norm"):
        cells.build(rows(spark, [[1.0, 0.0], [0.0, 0.0]]), str(tmp_path / "zero"), 1)


def test_commands(spark, tmp_path, clustered, capsys):
    _, _, vectors = clustered
    frames = rows(spark, vectors[:200, :4])
    frames.write.parquet(str(tmp_path / "frames.parquet"))
    args = ["--manifest", str(tmp_path / "frames.parquet"), "--query", "red car"]
    assert cli.main(["build-index", "--manifest", str(tmp_path / "frames.parquet"), "--output-index", str(tmp_path / "i"), "--cells", "9", "--metadata-output", str(tmp_path / "i.json")], spark) == 0
    assert json.loads((tmp_path / "i.json").read_text()) == {"rows": 200, "dimension": 4, "metric": "inner_product", "backend": "cells"}
    assert cli.main(["retrieve", *args, "--output", str(tmp_path / "a")], spark) == 0
    assert cli.main(["retrieve", *args, "--output", str(tmp_path / "b"), "--index", str(tmp_path / "i"), "--metadata", str(tmp_path / "i.json")], spark) == 0
    assert cli.main(["index-diagnostics", "--index", str(tmp_path / "i"), "--metadata", str(tmp_path / "i.json")], spark) == 0
    a, b = (sorted((r.video_id, round(r.rank_score, 6)) for r in spark.read.json(str(tmp_path / p)).collect()) for p in "ab")
    assert a == b and len(a) == 5
