"""Shared parts of the training-data operators: text hashing on Arrow buffers, materialisation, folds.

Texts are hashed without making Python strings: an Arrow string column already holds one UTF-8
buffer, so words are found with byte tables and their hashes come from prefix sums of a polynomial
modulo 2**64.  A null text is treated as the empty text everywhere.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_BASE, _GRAM_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at once; bounds the scratch arrays to about 60 times as much.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least); grows as needed and is kept per process."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = U(pow(int(base), -1, 1 << 64))
        have = tuple(np.concatenate(([U(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (base, inverse))
        _powers[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Tokens:
    """Tokens of consecutive texts in one byte buffer.

    starts, ends: byte positions; doc: index of the text; first: tokens[first[d]:first[d + 1]] are text d's.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, kind: str):
        self.buf, self.offsets, n = buf, offsets, len(buf)
        if kind == "words":
            label = np.where(_SPACE[buf], 0, 1).astype(np.int8)
        elif kind == "alnum":
            label = _ALNUM[buf].astype(np.int8)
        else:  # runs of letters and digits, and runs of other visible bytes
            label = np.where(_SPACE[buf], 0, np.where(_ALNUM[buf], 1, 2)).astype(np.int8)
        edge = np.ones(n + 1, bool)
        if n:
            edge[1:n] = label[1:] != label[:-1]
            edge[offsets] = True
        at = np.flatnonzero(edge)
        starts, ends = at[:-1], at[1:]
        if n:
            keep = label[starts] > 0
            starts, ends = starts[keep], ends[keep]
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_table(_BASE, len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the len(words) - k + 1 runs of k consecutive hashes (texts are not told apart)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_table(_GRAM_BASE, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def text_chunks(batch: pa.RecordBatch, name: str = "text", lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of its texts: about limit bytes each, always whole texts.  One text is
    never cut: where it is longer than limit, scratch arrays of about 60 times its own size are what a worker needs."""
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(name))
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: Bytes and rows of an Arrow batch: whatever texts are long, a Python worker holds a batch of them easily.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 512


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in bytes, and in rows; one setting for all operators, so that their order doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (local mode, tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framesieve-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Spark's setting for deleting an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later steps neither recompute it nor
    depend on the executors that made it, so that Spark may delete the step's shuffle files at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/framesieve-{uuid.uuid4().hex}"
    for paths in _open():
        paths.append(path)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_scratch = threading.local()


def _open() -> list[list[str]]:
    """The lists of the scratch() blocks that this thread is in: another thread's steps are none of theirs."""
    if not hasattr(_scratch, "lists"):
        _scratch.lists = []
    return _scratch.lists


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getName().startswith("framesieve-"):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*written: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing will read it again."""
    for df in written:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever materialize() wrote within it: around the writing of a result that operators made,
    it leaves none of their steps behind."""
    paths: list[str] = []
    _open().append(paths)
    try:
        yield
    finally:
        _scratch.lists = [x for x in _open() if x is not paths]
        for path in paths:
            _delete(spark, path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that begin with the given ones and aren't among those taken, whatever their case."""
    low, end = {t.lower() for t in taken}, ""
    while any((n + end).lower() in low for n in names):
        end += "_"
    return [n + end for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(rows: DataFrame, key: list[str], n: int, total: int) -> DataFrame:
    """The n of rows' total rows whose key hashes are smallest (all, if fewer); ties in order of all columns.

    A threshold on the hash first leaves a few more than n, so that what meets in one task doesn't grow
    with the number of partitions.
    """
    place = F.shiftrightunsigned(F.xxhash64(*key), 11) / float(1 << 53)
    if total > n:
        rows = rows.where(place < (n + 6 * n**0.5 + 20) / total)
    return rows.orderBy(place, *rows.columns).limit(n)


def bounded_texts(texts: DataFrame, n: int, total: int) -> DataFrame:
    """The rows of texts (doc_id, text) whose hashes of both are the n smallest of total: the hashes meet in one task, the
    texts stay in theirs.  Rows that repeat a chosen one come along."""
    (place,) = fresh(texts.columns, "__place")
    placed = texts.withColumn(place, F.xxhash64("doc_id", "text"))
    chosen = bounded_sample(placed.select(place), [place], n, total).distinct()
    return placed.join(F.broadcast(chosen), place, "left_semi").drop(place)  # at most n numbers


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: the contracts' held-out folds."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string")) % modulus
