"""Evidence looked up by candidates: what leaves the database, by which index, and odd databases."""

import json
import sqlite3

import pytest

from framesieve import cli
from framesieve.sources import python_sources


def database(path, columns="vid TEXT, frame_idx, transcript", rows=(), index=True):
    with sqlite3.connect(path) as con:
        con.execute(f"CREATE TABLE t ({columns})")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
        if index:
            con.execute("CREATE INDEX by_vid ON t (vid)")
    return str(path)


def found(spark, path, ids):
    videos = spark.createDataFrame([(i,) for i in ids], "video_id string")
    return sorted((tuple(r) for r in python_sources.evidence_of(videos, path, "asr").collect()), key=str)


@pytest.mark.parametrize("index", [True, False])
def test_hundred_thousand_videos(spark, tmp_path, index):
    path = database(tmp_path / "e.db", rows=[(f"V{i // 2}", i, f"text {i}") for i in range(500_000)], index=index)
    asked = spark.range(100_000).selectExpr("concat('V', id * 3) AS video_id")
    made = python_sources.evidence_of(asked, path, "asr")
    assert made.count() == 2 * sum(3 * i < 250_000 for i in range(100_000))  # what the plan's only source gives
    with sqlite3.connect(path) as db:
        db.execute("CREATE TEMP TABLE wanted (v PRIMARY KEY) WITHOUT ROWID")
        sql, _ = python_sources._looks_up(db, python_sources.sqlite_roles(path)[0])
        plan = " ".join(r[3] for r in db.execute(f"EXPLAIN QUERY PLAN {sql}"))
    assert ("SEARCH t USING INDEX by_vid" in plan) == index and ("SCAN t" in plan) != index


@pytest.mark.parametrize("kind", ["TEXT", "INTEGER", "", "REAL"])
@pytest.mark.parametrize("index", [True, False])
def test_kinds_of_ids(spark, tmp_path, kind, index):
    rows = [(7, "3", "seven"), ("7", None, "again"), ("V1", "x", None), (None, 1, "nobody"), ("07", 2.0, "other")]
    path = database(tmp_path / "e.db", f"vid {kind}, frame_idx, transcript", rows, index)
    made = found(spark, path, ["7", "V1", "7", None, "missing"])
    wanted = [("asr", "7", 3, "seven"), ("asr", "7", None, "again"), ("asr", "V1", None, None)]
    if kind == "INTEGER":  # 07 is the number 7 there
        wanted.append(("asr", "7", 2, "other"))
    if kind == "REAL":  # and 7 is 7.0
        wanted = wanted[2:]
    assert made == sorted(wanted, key=str)


def test_odd_databases(spark, tmp_path):
    assert found(spark, database(tmp_path / "none.db", "a, b, c", index=False), ["V1"]) == []
    (tmp_path / "broken.db").write_bytes(b"not a database at all, but long enough to be looked at" * 50)
    assert found(spark, str(tmp_path / "broken.db"), ["V1"]) == []
    assert found(spark, database(tmp_path / "e.db", rows=[("V1", 1, "x")]), []) == []


def test_commands_find_stores(spark, tmp_path, capsys):
    frames = spark.createDataFrame([(0, "V1", 0, 0, 1.0, "a.jpg", [1.0, 0.0]), (1, "V2", 0, 60, 2.0, "b.jpg", [1.0, 0.0])], "row_id long, video_id string, keyframe_idx long, original_frame_id long, pts_time double, image_path string, embedding array<float>")
    frames.write.parquet(str(tmp_path / "frames.parquet"))
    path = database(tmp_path / "asr.sqlite", rows=[("V2", 60, "a red car"), ("V9", 1, "red car red car")])
    empty = database(tmp_path / "ocr.sqlite")
    args = ["retrieve", "--manifest", str(tmp_path / "frames.parquet"), "--query", "red car", "--output", str(tmp_path / "r")]
    assert cli.main([*args, "--asr-db", path, "--ocr-db", empty, "--caption-db", str(tmp_path / "missing.sqlite")], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["evidence_modalities"] == ["asr", "ocr"]
    rows = {r.video_id: r for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert rows["V2"]["rank"] == 1 and rows["V2"].evidence_score == 1 and rows["V1"].evidence_score == 0 and rows["V1"].evidence_modalities == "asr,ocr"
    assert cli.main(["evidence-index", "--name", "found_stores", "--asr-db", path, "--ocr-db", empty], spark) == 0
    try:
        said = json.loads(capsys.readouterr().out.splitlines()[-1])
        assert (said["postings"], said["videos"]) == (4, 2)
        assert cli.main([*args, "--evidence-index", "found_stores"], spark) == 0
        again = {r.video_id: r for r in spark.read.json(str(tmp_path / "r")).collect()}
        assert {v: (r["rank"], r.evidence_score) for v, r in again.items()} == {v: (r["rank"], r.evidence_score) for v, r in rows.items()}
        assert again["V1"].evidence_modalities == "asr"  # a store without a text isn't in the index
    finally:
        for part in ("postings", "present"):
            spark.sql(f"DROP TABLE IF EXISTS found_stores_{part}")
    with pytest.raises(SystemExit):
        cli.main(["evidence-index", "--name", "none", "--asr-db", str(tmp_path / "missing.sqlite")], spark)
