"""Token-id files against the plain tokenizer, an exact round trip, random access, and damage."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framesieve.llm import queries, token_store

DOCS = "doc_id long, text string, ids string, frame int, start long"
ROWS = [(5, "same words"), (5, "same words"), (5, "other words"), (None, "no id"), (-3, None), (2, ""), (1 << 60, "a " * 40_000), (7, "Ünïcödé 文字 🙂 <|endoftext|>")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(queries.tokenizer_path())


def ids_of(coder, text):
    return [*coder.encode(text or "", add_special_tokens=False).ids, token_store.END]


def test_op12_against_plain_tokenizer(spark, sf, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")
    made, at = {r.doc_id: r for r in queries.op12_token_store(spark, sf).collect()}, 0
    assert len(made) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = ids_of(coder, text)
        assert tuple(made[doc_id]) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_round_trip_and_lookup(spark, coder, tmp_path):
    folder = f"file:{tmp_path}/ids"
    token_store.write(table(spark, ROWS).repartition(5), queries.tokenizer_path(), folder)
    rows = sorted(token_store.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, -3, 2, 5, 5, 5, 7, 1 << 60]
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted((str(i), ids_of(coder, t)) for i, t in ROWS)
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids)
    wanted = spark.createDataFrame([(5,), (1 << 60,), (5,), (6,), (None,)], "doc_id long")
    found = token_store.lookup(spark, folder, wanted).collect()
    assert sorted(map(tuple, found)) == sorted(tuple(r) for r in rows if r.doc_id in (5, 1 << 60))


def test_lookup_reads_wanted_frames_only(spark, sf, tmp_path, coder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    token_store.write(docs, queries.tokenizer_path(), str(tmp_path / "ids"))
    with open(tmp_path / "ids" / "dictionary.zdict", "rb") as f:
        assert len(f.read()) > 1000  # learned something
    files = token_store.manifest(spark, str(tmp_path / "ids")).collect()
    source, root = token_store.store(str(tmp_path / "ids"))
    reader = token_store.Reader(source, root, max(files, key=lambda r: r.rows).file)
    read = []
    plain = reader.file

    class Counting:
        def read_at(self, n, at):
            read.append(n)
            return plain.read_at(n, at)

    reader.file = Counting()
    ((row, ids),) = reader.documents(np.array([reader.rows // 2]))
    text = docs.where(F.col("doc_id") == int(reader.keys[row])).first().text
    assert ids.tolist() == ids_of(coder, text) and sum(read) == reader.ends[row] - reader.starts[row]


def test_empty_and_damaged(spark, tmp_path):
    empty = str(tmp_path / "empty")
    token_store.write(table(spark, []), queries.tokenizer_path(), empty)
    assert token_store.read(spark, empty).count() == 0 and token_store.lookup(spark, empty, table(spark, ROWS)).count() == 0
    folder = str(tmp_path / "ids")
    token_store.write(table(spark, ROWS).coalesce(1), queries.tokenizer_path(), folder)
    source, root = token_store.store(folder)
    name = next(f for f in sorted(os.listdir(folder)) if f.endswith(".ids"))
    data = open(f"{folder}/{name}", "rb").read()
    for damaged, message in ((data[:-1], "cut short"), (data[:9], "not a file"), (data[:9] + b"\0" * 32 + data[41:], "another dictionary"), (b"X" + data[1:], "not a file")):
        with open(f"{folder}/damaged.ids", "wb") as f:
            f.write(damaged)
        with pytest.raises(ValueError, match=message):
            token_store.Reader(source, root, "damaged.ids")
    assert not [f for f in os.listdir(folder) if f.endswith(".ids") and f not in {r.file for r in token_store.manifest(spark, folder).collect()} | {"damaged.ids"}]
