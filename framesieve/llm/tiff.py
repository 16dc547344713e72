"""TIFF columns: encode sample rows, walk image directories, decode strips and tiles, one row per page.

Decodes both byte orders, 8- and 16-bit unsigned samples, chunky and planar layouts, compressions none,
LZW, deflate and PackBits, predictors none and horizontal differencing.  A damaged or unsupported file
gives one row (or, past readable pages, one more row) with an error and null samples, and so does a page of over
MAX_SAMPLES samples; it never fails the job.  A directory that was visited already ends the walk, so loops of directories end.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh

#: Compression numbers and tags of the format (fixed values).
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT = 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 3: "H", 4: "I"}
#: Largest page that is decoded, in samples; a header that claims more is an error, not an allocation.
MAX_SAMPLES = 1 << 28


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
            i = j
            continue
        while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first; the width grows one code early, as the format has it."""
    codes = {bytes((i,)): i for i in range(256)}
    acc, width, bits, out = 256, 9, 9, bytearray()
    prefix, nxt = b"", 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in codes:
            prefix = longer
            continue
        put(codes[prefix])
        codes[longer] = nxt
        nxt += 1
        if nxt == 4094:
            put(256)
            codes, nxt, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif nxt >= (1 << width):
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        put(codes[prefix])
        nxt += 1
        if nxt >= (1 << width) and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    table: list[bytes] = []
    out, width, acc, bits, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257 or len(out) >= size:
            break
        if not table:
            raise ValueError("LZW data starts without a clear code")
        if code < len(table):
            now = table[code]
        elif code == len(table) and last:
            now = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += now
        if last:
            table.append(last + now[:1])
        last = now
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def _compress(data: bytes, how: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode}[how](data)


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {how} is not supported")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 32, tile: int | None = None, order: str = "<") -> bytes:
    """A file with one directory for each (rows, width) or (rows, width, samples) array of uint8 or uint16."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        rows, width, samples = page.shape
        side = (tile, tile) if tile else (rows_per_strip, width)
        blocks = []
        for y in range(0, rows, side[0]):
            for x in range(0, width, side[1]):
                block = page[y : y + side[0], x : x + side[1]]
                if tile:
                    block = np.pad(block, ((0, tile - block.shape[0]), (0, tile - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                blocks.append(_compress(np.ascontiguousarray(block).astype(block.dtype.newbyteorder(order)).tobytes(), compression))
        offsets = []
        for block in blocks:
            offsets.append(len(out))
            out += block
        tags = {WIDTH: [width], LENGTH: [rows], BITS: [page.dtype.itemsize * 8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [1 if samples < 3 else 2], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        counts = [len(b) for b in blocks]
        tags |= {TILE_WIDTH: [tile], TILE_LENGTH: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip], STRIP_COUNTS: counts}
        out += b"\0" * (len(out) % 2)
        entries, extra = bytearray(), {}
        for tag, values in sorted(tags.items()):
            kind = 3 if tag == BITS else 4
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                extra[tag] = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", extra[tag])
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int | None = None
    height: int | None = None
    samples: int | None = None
    bits: int | None = None
    compression: int | None = None
    predictor: int | None = None
    data: np.ndarray | None = None
    error: str | None = None


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(n):
        tag, kind, count, _ = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        size = count * struct.calcsize(TYPES[kind])
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        if where + size > len(data):
            raise ValueError(f"tag {tag} points past the end")
        tags[tag] = struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, where)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _read(data: bytes, tags: dict[int, tuple[int, ...]], order: str, page: Page) -> None:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    bits, how, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    page.width, page.height, page.samples, page.bits, page.compression, page.predictor = width, height, samples, bits, how, predictor
    if not width or not height or bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1 or one(FORMAT, 1) != 1 or predictor not in (1, 2):
        raise ValueError("size, sample format or predictor is not supported")
    if width * height * samples > MAX_SAMPLES:
        raise ValueError("the page is too large")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height) or height, height))
    starts, sizes = (tags.get(TILE_OFFSETS), tags.get(TILE_COUNTS)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS))
    if not starts or not sizes or len(starts) != len(sizes) or not bw or not bh or bw * bh * samples > MAX_SAMPLES:
        raise ValueError("strips or tiles are missing")
    kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // bw), -(-height // bh)
    if len(starts) < planes * across * down:
        raise ValueError("strips or tiles are missing")
    image = np.zeros((height, width, samples), kind.newbyteorder("="))
    for p in range(planes):
        for i in range(across * down):
            k = p * across * down + i
            y, x = i // across * bh, i % across * bw
            rows = bh if tiled else min(bh, height - y)
            size = rows * bw * depth * kind.itemsize
            if starts[k] + sizes[k] > len(data):
                raise ValueError("a strip or tile points past the end")
            raw = _expand(data[starts[k] : starts[k] + sizes[k]], how, size)
            if len(raw) < size:
                raise ValueError("a strip or tile is too short")
            block = np.frombuffer(raw[:size], kind).astype(kind.newbyteorder("=")).reshape(rows, bw, depth)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            part = block[: height - y, : width - x]
            image[y : y + part.shape[0], x : x + part.shape[1], p if planar == 2 else slice(None)] = part[:, :, 0] if planar == 2 else part
    page.data = image


def decode(data: bytes | None) -> Iterator[Page]:
    """The pages of a file in the order of its directories."""
    if not data or len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        yield Page(0, error="not a TIFF file")
        return
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        page = Page(len(seen) - 1)
        following = 0
        try:
            tags, following = _directory(data, at, order)
            _read(data, tags, order, page)
        except (ValueError, struct.error, zlib.error, IndexError, TypeError) as e:
            page.error = str(e) or type(e).__name__
        yield page
        at = following


def pages(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """One row per page of every file: the kept columns, page, width, height, samples, bits, compression,
    predictor, data (samples, row by row, little-endian), error."""
    bound_batches(files.sparkSession)
    (body,) = fresh(keep, "__content")
    names = [("page", T.IntegerType()), ("width", T.LongType()), ("height", T.LongType()), ("samples", T.IntegerType()), ("bits", T.IntegerType()), ("compression", T.IntegerType()), ("predictor", T.IntegerType()), ("data", T.BinaryType()), ("error", T.StringType())]
    schema = T.StructType([*files.select(*keep).schema.fields, *(T.StructField(*x) for x in names)])
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(body)):
                for p in decode(data.as_py()):
                    raw = None if p.data is None else p.data.astype(p.data.dtype.newbyteorder("<")).tobytes()
                    row = (p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, raw, p.error)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(len(keep))), *(pa.array([v], k) for v, k in zip(row, kinds, strict=True))], [*keep, *(n for n, _ in names)])

    return files.select(*keep, F.col(content).alias(body)).mapInArrow(run, schema)


#: How payloads are stored: samples a row, rows a page, rows a strip.
ROW, PAGE_ROWS, STRIP_ROWS = 576, 256, 64


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of ROW bytes as 8-bit pages, deflated after horizontal differencing."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return encode([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], DEFLATE, 2, STRIP_ROWS)


def load(media: bytes) -> bytes:
    found = list(decode(media))
    if any(p.error for p in found):
        raise ValueError(next(p.error for p in found if p.error))
    return b"".join(p.data.tobytes() for p in found)


def text_media(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_bytes, media (the stored TIFF) of every text's UTF-8, padded with 255 to rows of ROW."""
    bound_batches(docs.sparkSession)
    (body,) = fresh(keep, "__content")
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(body)]
            media = [store(r.ljust(max(1, -(-len(r) // ROW)) * ROW, b"\xff")) for r in raw]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    return docs.select(*keep, F.col(text).alias(body)).mapInArrow(run, schema)


def media_features(media: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and, from the stored bytes read back: payload (bytes) size, SHA-256, CRC-32 of its
    last 32 bytes, size and SHA-256 of the stored form, and a feature string (pages, size, mean, deviation,
    shares of eight value bands)."""
    import hashlib

    bound_batches(media.sparkSession)
    (body,) = fresh(keep, "__content")
    kinds = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    schema = T.StructType([*media.select(*keep).schema.fields, *(T.StructField(*x) for x in kinds)])

    def describe(data: bytes) -> tuple:
        found = list(decode(data))
        broken = next((p.error for p in found if p.error), None)
        if broken:
            raise ValueError(broken)
        samples = np.concatenate([p.data.reshape(-1) for p in found])
        payload = samples.tobytes()
        bands = np.bincount(samples >> 5, minlength=8) / len(samples)
        feature = f"{len(found)}p {found[0].width}x{sum(p.height for p in found)} mean={samples.mean():.4f} std={samples.std():.4f} bands=" + "/".join(f"{b:.4f}" for b in bands)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(x.as_py()) for x in batch.column(body)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), *(pa.array(v, k) for v, k in zip(columns, types, strict=True))], [*keep, *(n for n, _ in kinds)])

    return media.select(*keep, F.col("media").alias(body)).mapInArrow(run, schema)
