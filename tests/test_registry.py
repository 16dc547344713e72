"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from framesieve import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple("NULL" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf, db, name):
    made = registry.queries()[name](spark, sf).toPandas()
    wanted = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert rows(made) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_queries_with_a_text_are_searched(spark, sf, tmp_path, monkeypatch):
    for name in ("embeddings", "part", "documents"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id < 2").write.parquet(str(tmp_path / "benchmark.parquet"))
    asked, search_batch = [], registry.search.search_batch
    monkeypatch.setattr(registry.search, "search_batch", lambda frames, queries, *a, **k: asked.append(queries.count()) or search_batch(frames, queries, *a, **k))
    made = registry.rrf_fusion(spark, str(tmp_path)).collect()
    assert asked == [2] and {r.query_id for r in made} == {0, 100}
    everything = {(r.query_id, r.video_id): r.evidence_score for r in registry.rrf_fusion(spark, sf).collect()}
    assert all(everything[r.query_id, r.video_id] == r.evidence_score for r in made)
