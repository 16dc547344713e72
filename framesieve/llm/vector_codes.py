"""Vector codes: product quantisation by exact integer k-means with Hamerly's bounds.

Every component x becomes the integer floor(1024 * x); vectors are cut into equal consecutive parts, each with a codebook
of its own that starts as that part of the vectors of the smallest ids.  A round assigns every part to the nearest entry
(squared Euclidean distance, ties to the lower index) and replaces every entry by the componentwise floor of its parts'
mean; unused entries stay.  After the rounds parts are assigned again.

A table of the shared folder carries each vector with its entries and, per part, one upper bound of the distance to its
entry and one lower bound of the distance to the second-nearest.  Entries' moves widen the bounds; only where the upper
bound isn't strictly below the lower one, first as carried and then tightened by the exact distance, all entries are looked
at, so that ties still go to the lower index.  Bounds are 32-bit floats rounded outwards.  One pass a round writes the next
table together with each task's sums per entry, of which the driver gets one row per part and entry.

Arithmetic is exact at any magnitude: products in doubles where these hold all sums, else in 64 bits, else in Python's
integers (slow; for components beyond about two million).  Sums meet as 62-bit limbs in decimals.

Defined results: rows whose vector is null, or has a null or non-finite component, are dropped; ids may repeat, and seeds of
one id are in the order of their vectors, a null id last; fewer vectors than entries make a smaller codebook; widths that
the number of parts doesn't divide are filled with zeros at the end; a vector of another width than the first seed's has
no code (nulls); an error beyond 64 bits is null; an empty table gives no rows; kept columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bits of a limb of a sum.
LIMB = 62


def integers(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(parts, n, width / parts) integers of n vectors, of type object where 64 bits don't hold them."""
    n, width = vectors.shape
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if n and width and np.abs(scaled).max(initial=0) >= 2.0**62:
        # a double that large is a whole number
        out = np.array([[int(v) if abs(v) < 2.0**52 else int(x) * SCALE for v, x in zip(*row, strict=True)] for row in zip(scaled.tolist(), vectors.tolist(), strict=True)], object)
    else:
        out = scaled.astype(np.int64)
    each = -(-width // parts)
    if each * parts > width:
        out = np.concatenate((out, np.zeros((n, each * parts - width), out.dtype)), axis=1)
    return np.ascontiguousarray(out.reshape(n, parts, each).transpose(1, 0, 2))


def _top(x: np.ndarray) -> int:
    return int(abs(x).max()) if x.size else 0


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(n, entries) exact squared distances."""
    bound = x.shape[1] * (_top(x) + _top(entries)) ** 2
    if bound < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    kind = np.int64 if bound < 1 << 62 else object
    x, entries = x.astype(kind), entries.astype(kind)
    out = np.zeros((len(x), len(entries)), kind)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - entries[:, j]) ** 2
    return out


def own_squared(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distances to the entries given."""
    kind = np.int64 if x.shape[1] * (_top(x) + _top(entries)) ** 2 < 1 << 62 else object
    return ((x.astype(kind) - entries[code].astype(kind)) ** 2).sum(axis=1) if x.shape[1] else np.zeros(len(x), kind)


def _root(square: np.ndarray) -> np.ndarray:
    if square.dtype != object:
        return np.sqrt(square.astype(np.float64))
    return np.array([float(s) ** 0.5 if s < 1 << 1000 else np.inf for s in square.tolist()], np.float64)


def up(x: np.ndarray) -> np.ndarray:
    """A 32-bit float above x; twice its own rounding error away, which covers that of x."""
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry, and bounds of the distances to it and to the second-nearest, by looking at all."""
    d = squared(x, entries)
    code = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = up(_root(d[rows, code]))
    if len(entries) == 1:
        return code, upper, np.full(len(x), np.inf, np.float32)
    d[rows, code] = d.max(axis=1)
    second = _root(d.min(axis=1))
    return code, upper, np.where(np.isinf(second), np.float32(0), down(second))


def reassign(x: np.ndarray, entries: np.ndarray, moves: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As scan(), from an earlier round's result and the entries' moves since; and how many parts were looked up in full."""
    code, order = code.copy(), np.argsort(-moves, kind="stable")[:2]
    most, next_most = moves[order[0]], moves[order[1]] if len(moves) > 1 else np.float32(0)
    others = np.where(code == order[0], next_most, most)
    with np.errstate(invalid="ignore", over="ignore"):
        upper = up(upper.astype(np.float64) + moves[code])
        lower = down(lower.astype(np.float64) - others)
    doubtful = np.flatnonzero(~(upper < lower))
    upper[doubtful] = up(_root(own_squared(x[doubtful], entries, code[doubtful])))
    full = doubtful[~(upper[doubtful] < lower[doubtful])]
    if len(full):
        code[full], upper[full], lower[full] = scan(x[full], entries)
    return code, upper, lower, len(full)


def part_sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """(entries, width) exact sums of the parts of each entry."""
    width = x.shape[1]
    if x.dtype != object and len(x) * _top(x) < 1 << 53:
        at = (code[:, None] * width + np.arange(width)).ravel()
        return np.bincount(at, x.ravel(), entries * width).astype(np.int64).reshape(entries, width)
    out = np.zeros((entries, width), object)
    np.add.at(out, code, x.astype(object))
    return out


def limbs(value: int) -> list[int]:
    """value as a sum of limbs times powers of 2**LIMB; the last one carries the sign, small values are one."""
    out = []
    while abs(value) >= 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Upper bounds of the entries' moves."""
    return up(_root(own_squared(new, old, np.arange(len(old))))) * (np.abs(new != old).any(axis=1) if old.shape[1] else 0)


@dataclass
class Codes:
    """rows: row (the kept columns), code (two hex digits a part) and error; codebooks: (parts, entries, width)."""

    rows: DataFrame
    codebooks: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimals between commas."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.codebooks for v in book.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integers that a code stands for."""
        at = [int(code[2 * k : 2 * k + 2], 16) for k in range(len(self.codebooks))]
        return [int(v) for book, k in zip(self.codebooks, at, strict=True) for v in book[k].tolist()]


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def _pass(state: DataFrame, width: int, books: list[np.ndarray], moves: list[np.ndarray] | None, last: bool) -> DataFrame:
    """One assignment of all parts: the next table, and each task's sums as further rows; or, at last, codes and errors."""
    parts, held = len(books), state.sparkSession.sparkContext.broadcast((books, moves))
    kinds = {f.name: f.dataType for f in state.schema.fields}
    sums = [T.StructField(n, T.IntegerType()) for n in ("part", "entry", "limb")] + [T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]
    bounds = [T.StructField("codes", T.BinaryType()), T.StructField("upper", T.ArrayType(T.FloatType())), T.StructField("lower", T.ArrayType(T.FloatType()))]
    row = T.StructField("row", kinds["row"])
    schema = T.StructType([row, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())] if last else [row, T.StructField("vector", kinds["vector"]), *bounds, *sums])

    def floats(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(-1, parts).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moves = held.value
        totals = [np.zeros(b.shape, np.int64) for b in books]
        wide = [np.zeros(b.shape, object) for b in books]
        counts, like = [np.zeros(len(b), np.int64) for b in books], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, vectors, like = batch.column("row"), batch.column("vector"), (batch.column("row").type, batch.column("vector").type)
            x = integers(np.asarray(vectors.flatten()).reshape(len(rows), width), parts)
            code, upper, lower = (np.zeros((parts, len(rows)), k) for k in (np.uint8, np.float32, np.float32))
            if moves is not None:
                before = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts).T
                uppers, lowers = floats(batch.column("upper")), floats(batch.column("lower"))
            for p in range(parts):
                if moves is None:
                    c, upper[p], lower[p] = scan(x[p], books[p])
                else:
                    c, upper[p], lower[p], _ = reassign(x[p], books[p], moves[p], before[p].astype(np.int64), uppers[p], lowers[p])
                code[p] = c
                if not last:
                    made = part_sums(x[p], c, len(books[p]))
                    (wide if made.dtype == object else totals)[p] += made
                    counts[p] += np.bincount(c, minlength=len(books[p]))
            raw = code.T.tobytes()
            if last:
                error = sum(own_squared(x[p], books[p], code[p].astype(np.int64)).astype(object) for p in range(parts))
                text = raw.hex()
                yield pa.RecordBatch.from_arrays([
                    rows, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64()),
                ], ["row", "code", "error"])
                continue
            cut = pa.array(np.arange(0, parts * len(rows) + 1, parts, dtype=np.int32))
            none = [pa.nulls(len(rows), k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([
                rows, vectors, pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary()),
                *(pa.ListArray.from_arrays(cut, pa.array(b.T.ravel())) for b in (upper, lower)), *none,
            ], schema.names)
        if last or like is None:
            return
        cells = []
        for p in range(parts):
            for e in np.flatnonzero(counts[p]).tolist():
                each = [limbs(a + int(b)) for a, b in zip(wide[p][e].tolist(), totals[p][e].tolist(), strict=True)]
                for k in range(max(map(len, each), default=1)):
                    cells.append((p, e, k, int(counts[p][e]) if k == 0 else 0, [v[k] if k < len(v) else 0 for v in each]))
        columns = [pa.array(v, k) for v, k in zip(zip(*cells, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)]
        none = [pa.nulls(len(cells), k) for k in (*like, pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([*none, *columns], schema.names)

    return state.mapInArrow(run, schema)


def _updated(written: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: floors of the means, from one row per part, entry and limb."""
    width = books[0].shape[1]
    added = [F.sum(F.col("sums")[j].cast("decimal(20,0)")).alias(f"s{j}") for j in range(width)]
    found: dict[tuple[int, int], list[int]] = {}
    for r in written.where("part IS NOT NULL").groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *added).collect():
        total = found.setdefault((r.part, r.entry), [0] * (width + 1))
        total[0] += r.n
        for j in range(width):
            total[j + 1] += int(r[f"s{j}"]) << (LIMB * r.limb)
    out = [b.astype(object) for b in books]
    for (p, e), (n, *sums) in found.items():
        out[p][e] = [s // n for s in sums]
    return [b.astype(np.int64) if _top(b) < 1 << 62 else b for b in out]


def encode(vectors: DataFrame, keep: list[str], key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors that are whole and finite, with the codebooks that k-means ends with."""
    if parts < 1 or not 1 <= entries <= 256:
        raise ValueError("at least one part, and 1 to 256 entries of two hex digits each")
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = vectors.schema[vector].dataType
    column = F.col(vector) if isinstance(kind.elementType, T.FloatType) else F.col(vector).cast("array<double>")
    rows = vectors.select(F.struct(*keep).alias("row"), F.col(key).alias("key"), column.alias("vector")).where(finite(F.col("vector")))
    seeds = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = len(seeds[0].vector) if seeds else 0
    chosen = [r.vector for r in seeds if len(r.vector) == width] or [[]]
    books: list[np.ndarray] = list(integers(np.array(chosen, np.float64).reshape(len(chosen), width), parts))
    state, moves = rows.where(F.size("vector") == width).select("row", "vector"), None
    written = None
    for _ in range(rounds):
        made = materialize(_pass(state, width, books, moves, last=False))
        if written is not None:
            discard(written)
        written, new = made, _updated(made, books)
        moves, books = [moved(a, b) for a, b in zip(books, new, strict=True)], new
        state = written.where("part IS NULL").select("row", "vector", "codes", "upper", "lower")
    coded = materialize(_pass(state, width, books, moves, last=True))
    if written is not None:
        discard(written)
    others = rows.where(F.size("vector") != width).select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Codes(coded.unionByName(others), books)


def label_errors(coded: DataFrame, label: Column) -> DataFrame:
    """coded with label_error: the errors summed over equal labels, nulls together; beyond 64 bits it is null."""
    sums = coded.groupBy(label.alias("label_")).agg(F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long").alias("label_error"))
    return coded.join(sums, label.eqNullSafe(F.col("label_")), "left").drop("label_")
