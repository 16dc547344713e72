"""Token-id files: every document compressed by itself with one shared zstandard dictionary.

`write` tokenises documents, trains a dictionary on a bounded sample of serialised id arrays, compresses every document's
ids alone, and writes them in ascending order of their key to files of up to `FILE_BYTES`.  A file is

    magic | u8 bytes of an id | 32 bytes SHA-256 of the dictionary | frames | index | u64 place of the index | u64 rows | magic

where the index holds, for every document, its key (i64), whether it has one (u8), the end of its frame (u64) and its number
of ids (u64).  Beside the files lie `dictionary.zdict` and `manifest`, a table of the files in order: their key ranges, rows
and ids.  `read` streams all files; `lookup` reads the index and the frames of the wanted documents only.

A task writes one file under a name of its own and returns a manifest row; only rows of tasks that succeeded reach
the manifest, so a lost or repeated task leaves no trace in the result; files that the manifest doesn't name
are deleted at the end.  Files are reached through pyarrow's file systems by the folder's URI, so it may lie in any
store that the driver and all executors share.

Defined results: a null text is the empty one and holds the end id only; rows without a key come first; rows of one key are
in the order of their ids' number and checksum; identical rows all stay; an empty table gives a folder without files, which
reads as no rows; other columns aren't stored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import bound_batches, bounded_sample, discard, materialize
from .words import tokenizer

END = 2
MAGIC = b"IDSHELF1"
HEAD, TAIL = struct.Struct("<8sB32s"), struct.Struct("<QQ8s")
#: Compressed bytes of a file, at most (but for one document's own), where there are more than tasks would write.
FILE_BYTES = 128 << 20
#: The dictionary's sample: so many documents at most, of so many bytes of text at most, and the dictionary's size.
#: It serves short documents, so it learns from those; what it holds changes sizes, never ids.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
LEVEL = 3
#: Bytes of frames that a reader holds at once, unless one frame is larger.
BLOCK = 4 << 20

MANIFEST = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("ids", T.LongType()),
    T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("bytes", T.LongType()),
])
ROW = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])


def store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder's URI, in Hadoop's spelling or plain."""
    uri = re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", folder))
    return pa.fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pa.fs.LocalFileSystem(), uri)


def id_type(path: str) -> np.dtype:
    """The narrowest unsigned type for a vocabulary's ids."""
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    return np.dtype("<u2" if max(coder.get_vocab().values()) < 1 << 16 else "<u4")


def train(docs: DataFrame, path: str, total: int) -> bytes:
    """A dictionary from a sample of short documents, in one task; empty where they are too few to learn from."""
    kind = id_type(path)
    short = docs.where(F.octet_length("text").between(1, SAMPLE_BYTES)).select("doc_id", "text")
    sample = bounded_sample(short, ["doc_id", "text"], SAMPLE_ROWS, total).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, forget = tokenizer(path)
        samples = [ids.astype(kind).tobytes() for batch in batches for ids in encode(batch.column(0))]
        forget()
        try:
            made = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
        except zstandard.ZstdError:  # too little in common, or too little at all
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["dictionary"])

    return max((r[0] for r in sample.coalesce(1).mapInArrow(run, "dictionary binary").collect()), key=len, default=b"")


def compress(docs: DataFrame, path: str, dictionary: bytes, end: int = END) -> DataFrame:
    """doc_id, n_ids, crc and frame of every document."""
    kind = id_type(path)
    held = docs.sparkSession.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, forget = tokenizer(path)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held.value) if held.value else None)
        for batch in batches:
            n, sums, frames = [], [], []
            for ids in encode(batch.column(1)):
                raw = np.append(ids, np.uint32(end)).astype(kind).tobytes()
                n.append(len(raw) // kind.itemsize)
                sums.append(zlib.crc32(raw))
                frames.append(coder.compress(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n_ids", "crc", "frame"])
        forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, crc long, frame binary")


class _Writer:
    """One file of the format, frame by frame."""

    def __init__(self, out: pa.NativeFile, kind: np.dtype, digest: bytes):
        self.out, self.at, self.index = out, HEAD.size, []
        out.write(HEAD.pack(MAGIC, kind.itemsize, digest))

    def add(self, batch: pa.RecordBatch) -> None:
        keys, n, frames = batch.column("doc_id"), batch.column("n_ids").to_numpy(), batch.column("frame").to_pylist()
        for frame in frames:
            self.out.write(frame)
        ends = self.at + np.cumsum(np.fromiter(map(len, frames), np.int64, len(frames)))
        self.at = int(ends[-1])
        self.index.append((keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False), ends, n))

    def close(self) -> tuple:
        keys, valid, ends, n = (np.concatenate(x) for x in zip(*self.index, strict=True))
        index = keys.astype("<i8").tobytes() + valid.astype("u1").tobytes() + ends.astype("<u8").tobytes() + n.astype("<u8").tobytes()
        self.out.write(index + TAIL.pack(self.at, len(keys), MAGIC))
        held = keys[valid]
        return len(keys), int(n.sum()), int(held[0]) if len(held) else None, int(held[-1]) if len(held) else None, self.at + len(index) + TAIL.size


def write(docs: DataFrame, path: str, folder: str, end: int = END) -> None:
    """Writes the ids of documents (doc_id, text), each ended with `end`, to a new folder."""
    spark = docs.sparkSession
    bound_batches(spark)
    files, root = store(folder)
    files.create_dir(root, recursive=True)
    dictionary = train(docs, path, docs.count())
    with files.open_output_stream(f"{root}/dictionary.zdict") as out:
        out.write(dictionary)
    kind, digest = id_type(path), hashlib.sha256(dictionary).digest()
    rows = materialize(compress(docs, path, dictionary, end))
    total = rows.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batch = next(batches, None)
        if batch is None:
            return
        files, root = store(folder)
        part = TaskContext.get().partitionId()
        name = f"{part:07d}-{uuid.uuid4().hex}.ids"
        with files.open_output_stream(f"{root}/{name}") as out:
            writer = _Writer(out, kind, digest)
            while batch is not None:
                if batch.num_rows:
                    writer.add(batch)
                batch = next(batches, None)
            row = writer.close() if writer.index else None
        if row:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, name, *row), (pa.int32(), pa.string(), *[pa.int64()] * 5), strict=True)], MANIFEST.names)

    # rows of one key part by their contents, and identical ones by where they were written, so that no key is one task's
    order = ["doc_id", "n_ids", "crc", "__place"]
    placed = rows.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__place"))
    made = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "n_ids", "frame").mapInArrow(run, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    discard(rows)
    named = {r.file for r in spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file").toLocalIterator()}
    for info in files.get_file_info(pa.fs.FileSelector(root)):
        if info.base_name.endswith(".ids") and info.base_name not in named:
            files.delete_file(info.path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order, with `before`: the ids of all files before."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row a file, of a few dozen bytes: a window over all of them is small
    return files.withColumn("before", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


class Reader:
    """One file of the format, by byte ranges."""

    def __init__(self, files: pa.fs.FileSystem, root: str, name: str):
        self.file = files.open_input_file(f"{root}/{name}")
        size = self.file.size()
        if size < HEAD.size + TAIL.size:
            raise ValueError(f"{name}: not a file of token ids")
        magic, width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        place, self.rows, again = TAIL.unpack(self.file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or again != MAGIC or place + 25 * self.rows + TAIL.size != size:
            raise ValueError(f"{name}: not a file of token ids, or cut short")
        self.kind = np.dtype(f"<u{width}")
        with files.open_input_stream(f"{root}/dictionary.zdict") as stream:
            dictionary = stream.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{name}: written with another dictionary")
        self.coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        index, n = self.file.read_at(25 * self.rows, place), self.rows
        self.keys, self.valid = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.ends = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        self.n_ids = np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
        self.starts = np.concatenate(([HEAD.size], self.ends[:-1]))

    def documents(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of ascending rows; neighbouring frames are read together, up to BLOCK bytes."""
        at = 0
        while at < len(rows):
            to = at + 1
            while to < len(rows) and rows[to] == rows[to - 1] + 1 and self.ends[rows[to]] - self.starts[rows[at]] <= BLOCK:
                to += 1
            base = int(self.starts[rows[at]])
            data = self.file.read_at(int(self.ends[rows[to - 1]]) - base, base)
            for row in rows[at:to]:
                raw = self.coder.decompress(data[self.starts[row] - base : self.ends[row] - base], max_output_size=int(self.n_ids[row]) * self.kind.itemsize)
                ids = np.frombuffer(raw, self.kind)
                if len(ids) != self.n_ids[row]:
                    raise ValueError("a document has other ids than its index says")
                yield int(row), ids
            at = to


def _dealt(files: DataFrame) -> DataFrame:
    """Files over as many tasks as there are cores to read them, or one each."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file")


def scan(spark: SparkSession, folder: str, cells, schema: T.StructType) -> DataFrame:
    """All documents, in tasks of whole files: cells(keys, starts, ids) makes an Arrow batch of a block of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = store(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(files, root, name)
                start = before + np.cumsum(reader.n_ids) - reader.n_ids
                block, size = [], 0
                for row, ids in reader.documents(np.arange(reader.rows)):
                    block.append((int(reader.keys[row]) if reader.valid[row] else None, int(start[row]), ids))
                    size += len(ids)
                    if size >= BLOCK // 8 or len(block) == 4096:
                        yield cells(*zip(*block, strict=True))
                        block, size = [], 0
                if block:
                    yield cells(*zip(*block, strict=True))

    return _dealt(manifest(spark, folder).select("file", "before")).mapInArrow(run, schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it) and ids of every document."""

    def cells(keys, starts, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))], ROW.names)

    return scan(spark, folder, cells, ROW)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as unsigned 32-bit integers) of every document, as read back."""

    def cells(keys, starts, ids) -> pa.RecordBatch:
        sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (keys, starts, list(map(len, ids)), sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return scan(spark, folder, cells, T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start and ids of every document whose key is in wanted (doc_id); absent and null keys give nothing.

    Keys meet the files whose range holds them; of a file, its index and the wanted frames are read, no others."""
    files = manifest(spark, folder).select("file", "before", "first", "last")
    keys = wanted.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    met = keys.join(files, (F.col("doc_id") >= F.col("first")) & (F.col("doc_id") <= F.col("last"))).select("file", "before", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, root = store(folder)
        name, reader, start = None, None, None
        for batch in batches:
            table = batch.to_pandas()
            for (file, before), group in table.groupby(["file", "before"], sort=False):
                if file != name:
                    name, reader = file, Reader(source, root, file)
                    start = before + np.cumsum(reader.n_ids) - reader.n_ids
                keys, held = np.sort(group["doc_id"].to_numpy()), reader.valid.argmax() if reader.valid.any() else reader.rows
                low, high = (held + np.searchsorted(reader.keys[held:], keys, side) for side in ("left", "right"))
                rows = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(int((high - low).sum()))
                for row, ids in reader.documents(rows):
                    yield pa.RecordBatch.from_arrays([pa.array([int(reader.keys[row])]), pa.array([int(start[row])]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ROW.names)

    return _dealt(met).sortWithinPartitions("file").mapInArrow(run, ROW)
