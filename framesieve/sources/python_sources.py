"""Python data sources: NPY matrices and SQLite evidence; headers of feature files."""

from __future__ import annotations

import ast
import glob
import os
import posixpath
import sqlite3
import struct
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import closing
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .files import ROLES, pick_column


def npy_header(data: bytes) -> tuple[tuple[int, ...], str, bool, int]:
    """Shape, dtype, Fortran order and length of the header of an NPY file's first bytes."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    size, at = (struct.unpack_from("<H", data, 8)[0], 10) if data[6] == 1 else (struct.unpack_from("<I", data, 8)[0], 12)
    head = ast.literal_eval(data[at : at + size].decode("latin1"))
    return tuple(head["shape"]), head["descr"], head["fortran_order"], at + size


def placed(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, of any that pyarrow knows, and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        path = unquote("/" + rest.lstrip("/"))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """A file, by path or URI, for reading anywhere in it."""
    system, inner = placed(path)
    return system.open_input_file(inner)


def listed(path: str, ending: str) -> list[str]:
    """The files of a folder, by path or URI, that end so; a path that isn't a folder is a file or a glob."""
    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        found = system.get_file_info(fs.FileSelector(inner)) if system.get_file_info(inner).type == fs.FileType.Directory else [system.get_file_info(inner)]
        return sorted(path.split("://")[0] + "://" + f.path for f in found if f.path.lower().endswith(ending))
    if os.path.isfile(path):
        return [path]
    return sorted(glob.glob(os.path.join(path, f"*{ending}") if os.path.isdir(path) else path))


def feature_headers(files: DataFrame) -> DataFrame:
    """(path, suffix, member, shape, dtype, ndim, error) of NPY and NPZ files (path): one row per array; member: its
    name in an NPZ.  Only headers are read; a file that can't be read is a row with an error."""

    def heads(path: str, kind: str) -> Iterator[tuple[str | None, bytes]]:
        with opened(path) as f:
            if kind != ".npz":
                yield None, f.read(HEAD)
                return
            with zipfile.ZipFile(f) as z:
                for name in z.namelist():
                    with z.open(name) as member:
                        yield name.removesuffix(".npy"), member.read(HEAD)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                kind = posixpath.splitext(path)[1].lower()
                try:
                    for member, head in heads(path, kind):
                        shape, dtype, _, _ = npy_header(head)
                        rows.append((path, kind, member, list(shape), str(np.dtype(dtype)), len(shape), None))
                except Exception as e:  # whatever is wrong with a file belongs to its row
                    rows.append((path, kind, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "suffix", "member", "shape", "dtype", "ndim", "error"])

    return files.select("path").mapInPandas(run, "path string, suffix string, member string, shape array<long>, dtype string, ndim int, error string")


class _Rows(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


#: Rows that one partition of a matrix or a table has, rows of one batch, and bytes that hold a header.
PART_ROWS, BATCH_ROWS, HEAD = 65_536, 4096, 1 << 16


class NpySource(DataSource):
    """(video_id, pos, embedding) of NPY matrices; options path (a file, folder or URI of one, or a local glob), dim
    (default 512).  A large matrix is read in parts, in Arrow batches."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "video_id string, pos long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dim = options["path"], int(options.get("dim", "512"))

    def partitions(self):
        out = []
        for p in listed(self.path, ".npy"):
            with opened(p) as f:
                try:
                    shape = npy_header(f.read(HEAD))[0]
                except ValueError as e:
                    raise ValueError(f"{p}: {e}") from e
            if len(shape) != 2 or shape[1] != self.dim:
                raise ValueError(f"{p}: expected a matrix of width {self.dim}, found {shape}")
            out += [_Rows(p, low, min(low + PART_ROWS, shape[0])) for low in range(0, shape[0], PART_ROWS)]
        return out or [_Rows("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        video = posixpath.splitext(posixpath.basename(partition.path))[0]
        with opened(partition.path) as f:
            shape, kind, by_column, start = npy_header(f.read(HEAD))
            dtype = np.dtype(kind)
            if dtype.hasobject:
                raise ValueError(f"{partition.path}: objects aren't read")
            for low in range(partition.low, partition.high, BATCH_ROWS):
                high = min(low + BATCH_ROWS, partition.high)
                if by_column:  # the rows' part of each column
                    columns = [f.read_at((high - low) * dtype.itemsize, start + (j * shape[0] + low) * dtype.itemsize) for j in range(self.dim)]
                    part = np.frombuffer(b"".join(columns), dtype).reshape(self.dim, -1).T
                else:
                    part = np.frombuffer(f.read_at((high - low) * self.dim * dtype.itemsize, start + low * self.dim * dtype.itemsize), dtype)
                part = np.ascontiguousarray(part, np.float32).reshape(-1)
                ends = pa.array(np.arange(0, part.size + 1, self.dim, dtype=np.int32))
                vectors = pa.ListArray.from_arrays(ends, pa.array(part))
                yield pa.RecordBatch.from_arrays([pa.array([video] * (high - low)), pa.array(np.arange(low, high)), vectors], ["video_id", "pos", "embedding"])


class NpySink(DataSource):
    """Writes (row_id, embedding), in order of row_id, as one NPY matrix of 32-bit floats; options path, dim.  Each task
    leaves a part beside the file, in whatever file system the path names; the commit joins them, 16 MB at a time."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _NpyWriter(self.options)


class _Part(WriterCommitMessage):
    def __init__(self, path: str, rows: int, first: int):
        self.path, self.rows, self.first = path, rows, first


class _NpyWriter(DataSourceWriter):
    def __init__(self, options):
        self.path, self.dim = options["path"], int(options.get("dim", "512"))

    def write(self, iterator):
        part, rows, first = f"{self.path}.{uuid.uuid4().hex}.part", 0, -1
        system, inner = placed(part)
        with system.open_output_stream(inner) as f:
            for row in iterator:
                vector = np.asarray(row["embedding"], "<f4")
                if len(vector) != self.dim:
                    raise ValueError(f"row {row['row_id']}: expected {self.dim} numbers, found {len(vector)}")
                first = row["row_id"] if not rows else first
                f.write(vector.tobytes())
                rows += 1
        return _Part(part, rows, first)

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.first)
        system, inner = placed(self.path)
        with system.open_output_stream(inner) as out:
            np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (sum(m.rows for m in parts), self.dim)})
            for m in parts:
                with system.open_input_stream(placed(m.path)[1]) as f:
                    while data := f.read(1 << 24):
                        out.write(data)
        self.abort(messages)

    def abort(self, messages):
        for m in messages:
            if m is not None:
                system, inner = placed(m.path)
                if system.get_file_info(inner).type == fs.FileType.File:
                    system.delete_file(inner)


def _database(path: str):
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sqlite_roles(path: str) -> list[dict]:
    """Tables of a database, opened read-only, with their columns, counts and the columns' roles."""
    out = []
    with _database(path) as db:
        for (table,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid").fetchall():
            columns = [r[1] for r in db.execute(f"PRAGMA table_info({_quoted(table)})")]
            (n,) = db.execute(f"SELECT count(*) FROM {_quoted(table)}").fetchone()
            out.append({"table": table, "columns": columns, "rows": n, "roles": {role: pick_column(columns, names) for role, names in ROLES.items()}})
    return out


def inspect_sqlite(path: str) -> dict:
    """Whether a database exists, its tables with their roles, or the error that reading it gave."""
    report: dict = {"path": path, "exists": os.path.exists(path), "tables": []}
    if report["exists"]:
        try:
            report["tables"] = sqlite_roles(path)
        except (OSError, sqlite3.Error) as e:
            report["error"] = str(e)
    return report


class SqliteEvidenceSource(DataSource):
    """(modality, video_id, frame_id, text) of the first SQLite table with a video and a text column.
    Options: path, modality.  A database without such a table, or an unreadable one, has no rows; a large one is read
    in parts."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_evidence"

    def schema(self) -> str:
        return "modality string, video_id string, frame_id long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.modality = options["path"], options.get("modality", "asr")
        self.videos: list[str] | None = None

    def pushFilters(self, filters):
        """Equality and membership of video_id are answered by the database."""
        for f in filters:
            known = isinstance(f, EqualTo | In) and f.attribute == ("video_id",)
            if known and self.videos is None:
                self.videos = [str(f.value)] if isinstance(f, EqualTo) else [str(v) for v in f.value]
            else:
                yield f

    def _table(self) -> dict | None:
        try:
            return next((t for t in sqlite_roles(self.path) if t["roles"]["video_id"] and t["roles"]["text"]), None)
        except sqlite3.Error:
            return None

    def partitions(self):
        table, out = self._table(), []
        if table:
            with _database(self.path) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table['table'])}").fetchone()
                    out = [_Rows(self.path, a, min(a + PART_ROWS - 1, high)) for a in range(low, high + 1, PART_ROWS)] if low is not None else []
                except sqlite3.Error:  # a table without row ids is read at once
                    out = [_Rows(self.path, 0, -1)]
        return out or [_Rows("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        table = self._table()
        roles = table["roles"]
        frame = _quoted(roles["frame_id"]) if roles["frame_id"] else "NULL"
        video, where, values = _quoted(roles["video_id"]), [], []
        if partition.high >= partition.low:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        if self.videos is not None:
            where.append(f"CAST({video} AS TEXT) IN ({', '.join('?' * len(self.videos))})")
            values += self.videos
        sql = f"SELECT {video}, {frame}, {_quoted(roles['text'])} FROM {_quoted(table['table'])}" + (f" WHERE {' AND '.join(where)}" if where else "")
        with _database(self.path) as db:
            for v, f, text in db.execute(sql, values):
                yield self.modality, None if v is None else str(v), _whole(f), None if text is None else str(text)


#: Videos that one connection asks for at once.
ASKED = 10_000


def _looks_up(db: sqlite3.Connection, table: dict) -> tuple[str, bool]:
    """The statement that gives the rows of the videos in the temporary table wanted (v), and whether the column of
    videos keeps numbers as they are.  Where the column leads an index, the database searches that for each
    video; otherwise it reads the table once."""
    name, roles = _quoted(table["table"]), table["roles"]
    video, frame, text = (_quoted(roles[r]) if roles[r] else "NULL" for r in ("video_id", "frame_id", "text"))
    leads = any(db.execute(f"PRAGMA index_info({_quoted(i[1])})").fetchone()[2] == roles["video_id"] for i in db.execute(f"PRAGMA index_list({name})").fetchall())
    declared = next(r[2] for r in db.execute(f"PRAGMA table_info({name})") if r[1] == roles["video_id"]).upper()
    as_is = not declared or "BLOB" in declared
    t = lambda c: c if c == "NULL" else f"t.{c}"
    if leads:
        return f"SELECT {t(video)}, {t(frame)}, {t(text)} FROM temp.wanted AS w CROSS JOIN {name} AS t ON t.{video} = w.v", as_is
    return f"SELECT {t(video)}, {t(frame)}, {t(text)} FROM {name} AS t WHERE t.{video} IN (SELECT v FROM temp.wanted)", as_is


def evidence_of(videos: DataFrame, path: str, modality: str) -> DataFrame:
    """(modality, video_id, frame_id, text) of the given videos (video_id) in a SQLite database that all executors mount:
    their ids go to the database in chunks, and no other row leaves it.  As the source sqlite_evidence, a database
    without a fitting table, or an unreadable one, has no rows."""
    asked = videos.select(F.col("video_id").cast("string")).where("video_id IS NOT NULL").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = [v for pdf in batches for v in pdf["video_id"]]
        try:
            table = next((t for t in sqlite_roles(path) if t["roles"]["video_id"] and t["roles"]["text"]), None) if ids else None
        except sqlite3.Error:
            table = None
        if table is None:
            return
        with _database(path) as db:
            db.execute("PRAGMA temp_store = MEMORY")
            sql, as_is = _looks_up(db, table)
            db.execute("CREATE TEMP TABLE wanted (v PRIMARY KEY) WITHOUT ROWID")
            for low in range(0, len(ids), ASKED):
                chunk = ids[low : low + ASKED]
                db.execute("DELETE FROM temp.wanted")
                db.executemany("INSERT OR IGNORE INTO temp.wanted VALUES (?)", ((v,) for v in chunk))
                if as_is:  # a column without a type may hold the number itself
                    db.executemany("INSERT OR IGNORE INTO temp.wanted VALUES (?)", ((int(v),) for v in chunk if v.lstrip("-").isdigit() and v.isascii() and len(v) < 19))
                wanted, rows = set(chunk), []
                for v, f, text in db.execute(sql):
                    if str(v) in wanted:
                        rows.append((modality, str(v), _whole(f), None if text is None else str(text)))
                    if len(rows) == BATCH_ROWS:
                        yield _evidence_rows(rows)
                        rows = []
                yield _evidence_rows(rows)

    parts = max(1, -(-asked.count() // (4 * ASKED)))
    return asked.repartition(parts, "video_id").mapInPandas(run, "modality string, video_id string, frame_id long, text string")


def _whole(value) -> int | None:
    try:
        return int(value) if value is not None else None
    except ValueError:
        return None


def _evidence_rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["modality", "video_id", "frame_id", "text"], dtype=object)
    return out.assign(frame_id=out["frame_id"].astype("Int64"))


def register(spark: SparkSession) -> None:
    """Makes the sources known to the session, and lets it push filters into those that take them."""
    for source in (NpySource, NpySink, SqliteEvidenceSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
