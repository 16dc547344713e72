"""Headers of video files, without a decoder: boxes of ISO base media (MP4, MOV) and elements of EBML (Matroska, WebM).

Only headers are read, by byte ranges; media data is skipped.  What a file doesn't say, or says wrongly, is a ValueError
with its reason.  fps is frames by seconds of the first video track; a Matroska file that states its frames' duration and
its own has as many frames as fit, otherwise its blocks are counted.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from .python_sources import opened

#: Bytes of one header that is read as a whole.
WHOLE = 1 << 26


@dataclass
class Track:
    frames: int = 0
    seconds: float = 0.0
    width: int = 0
    height: int = 0

    def info(self) -> dict:
        if self.frames <= 0:
            raise ValueError("the video track has no frames")
        if not self.seconds > 0:
            raise ValueError("the video track has no duration")
        fps = self.frames / self.seconds
        return {"fps": fps, "frame_count": self.frames, "width": self.width, "height": self.height}


class _File:
    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def bytes(self, at: int, n: int) -> bytes:
        if n > WHOLE:
            raise ValueError("a header is too large")
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError("the file ends within a header")
        return data


# ISO base media ----------------------------------------------------------------------------------


def boxes(file: _File, low: int, high: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes between two places; their contents aren't read."""
    while low < high:
        if high - low < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack(">I4s", file.bytes(low, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", file.bytes(low + 8, 8))[0], 16
        elif size == 0:  # up to the end
            size = high - low
        if size < head or low + size > high:
            raise ValueError(f"box {kind.decode('latin1')} has a wrong size")
        yield kind, low + head, low + size
        low += size


def _inside(file: _File, low: int, high: int, *path: bytes) -> Iterator[tuple[int, int]]:
    """Places of all boxes that lie on a path of kinds."""
    for kind, a, b in boxes(file, low, high):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from _inside(file, a, b, *path[1:])


def _first(file: _File, low: int, high: int, *path: bytes) -> tuple[int, int]:
    found = next(_inside(file, low, high, *path), None)
    if found is None:
        raise ValueError(f"there is no {b'/'.join(path).decode('latin1')}")
    return found


def _full(file: _File, place: tuple[int, int], need: int) -> bytes:
    a, b = place
    if b - a < need:
        raise ValueError("a box is cut short")
    return file.bytes(a, b - a)


def _media_header(data: bytes) -> tuple[int, int]:
    """Units of a second and duration in them, of an mdhd or mvhd box of either version."""
    if data[0] == 1:
        if len(data) < 32:
            raise ValueError("a box is cut short")
        return struct.unpack_from(">IQ", data, 20)
    return struct.unpack_from(">II", data, 12)


def _fragments(file: _File, track: int, default: int) -> tuple[int, int]:
    """Frames and their duration in a track's movie fragments."""
    frames = units = 0
    for low, high in _inside(file, 0, file.size, b"moof"):
        for a, b in _inside(file, low, high, b"traf"):
            head = _full(file, _first(file, a, b, b"tfhd"), 8)
            flags, number = int.from_bytes(head[1:4], "big"), struct.unpack_from(">I", head, 4)[0]
            if number != track:
                continue
            each, at = default, 8 + 8 * bool(flags & 1) + 4 * bool(flags & 2)
            if flags & 8:
                each = struct.unpack_from(">I", head, at)[0]
            for place in _inside(file, a, b, b"trun"):
                run = _full(file, place, 8)
                flags, n = int.from_bytes(run[1:4], "big"), struct.unpack_from(">I", run, 4)[0]
                at, step = 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4), 4 * sum(bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800))
                if len(run) < at + n * step:
                    raise ValueError("a run of frames is cut short")
                frames += n
                units += sum(struct.unpack_from(">I", run, at + i * step)[0] for i in range(n)) if flags & 0x100 else n * each
    return frames, units


def iso_media(file: _File) -> Track:
    movie = _first(file, 0, file.size, b"moov")
    for a, b in _inside(file, *movie, b"trak"):
        handler = _full(file, _first(file, a, b, b"mdia", b"hdlr"), 12)
        if handler[8:12] != b"vide":
            continue
        head = _full(file, _first(file, a, b, b"tkhd"), 84)
        number = struct.unpack_from(">I", head, 20 if head[0] == 1 else 12)[0]
        width, height = (x >> 16 for x in struct.unpack_from(">II", head, len(head) - 8))
        scale, duration = _media_header(_full(file, _first(file, a, b, b"mdia", b"mdhd"), 20))
        if not scale:
            raise ValueError("the video track has no time scale")
        times = _full(file, _first(file, a, b, b"mdia", b"minf", b"stbl", b"stts"), 8)
        n = struct.unpack_from(">I", times, 4)[0]
        if len(times) < 8 + 8 * n:
            raise ValueError("the table of times is cut short")
        entries = struct.unpack_from(f">{2 * n}I", times, 8)
        frames, units = sum(entries[::2]), sum(c * d for c, d in zip(entries[::2], entries[1::2], strict=True))
        default = 0
        for place in _inside(file, *movie, b"mvex", b"trex"):
            extends = _full(file, place, 24)
            if struct.unpack_from(">I", extends, 4)[0] == number:
                default = struct.unpack_from(">I", extends, 12)[0]
        more, further = _fragments(file, number, default)
        return Track(frames + more, (units + further or duration) / scale, width, height)
    raise ValueError("there is no video track")


# EBML --------------------------------------------------------------------------------------------

# fixed values: ids of Matroska elements
EBML, SEGMENT, INFO, TRACKS, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675
TIME_SCALE, DURATION = 0x2AD7B1, 0x4489
ENTRY, NUMBER, KIND, FRAME_TIME, VIDEO, WIDTH, HEIGHT = 0xAE, 0xD7, 0x83, 0x23E383, 0xE0, 0xB0, 0xBA
CLUSTER_TIME, SIMPLE_BLOCK, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1


def vint(data: bytes, at: int, keep: bool) -> tuple[int | None, int]:
    """A number of variable length and the place after it; keep: with its marker, as ids are written.  None: unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError("a number is wrong")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError("a number is cut short")
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def element(file: _File, at: int, high: int) -> tuple[int, int, int | None]:
    """The id, begin and end of the element at a place; an end of None isn't stated."""
    head = file.bytes(at, min(12, high - at))
    kind, n = vint(head, 0, True)
    size, n = vint(head, n, False)
    if size is not None and at + n + size > high:
        raise ValueError(f"element {kind:X} has a wrong size")
    return kind, at + n, None if size is None else at + n + size


def elements(file: _File, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the elements between two places; one without an end goes as far as its parent, unless it is a
    part of a segment, which ends where the next one begins: ids of parts have four bytes, those inside them fewer."""
    while low < high:
        kind, begin, end = element(file, low, high)
        if end is None and kind in (CLUSTER, INFO, TRACKS):
            end = begin
            while end < high:
                inner, _, after = element(file, end, high)
                if inner >= 1 << 24:
                    break
                if after is None:
                    raise ValueError(f"element {inner:X} has no size")
                end = after
        low = high if end is None else end
        yield kind, begin, low


def _unsigned(file: _File, a: int, b: int) -> int:
    return int.from_bytes(file.bytes(a, b - a), "big") if 0 < b - a <= 8 else 0


def _real(file: _File, a: int, b: int) -> float:
    if b - a not in (4, 8):
        return 0.0
    return struct.unpack(">f" if b - a == 4 else ">d", file.bytes(a, b - a))[0]


def matroska(file: _File) -> Track:
    segment = next(((a, b) for kind, a, b in elements(file, 0, file.size) if kind == SEGMENT), None)
    if segment is None:
        raise ValueError("there is no segment")
    scale, duration, video, number, frame_time = 1_000_000, 0.0, None, None, 0
    clusters = []
    for kind, a, b in elements(file, *segment):
        if kind == INFO:
            for k, c, d in elements(file, a, b):
                scale = _unsigned(file, c, d) if k == TIME_SCALE else scale
                duration = _real(file, c, d) if k == DURATION else duration
        elif kind == TRACKS and video is None:
            for k, c, d in elements(file, a, b):
                fields = {x: (y, z) for x, y, z in elements(file, c, d)} if k == ENTRY else {}
                if KIND in fields and _unsigned(file, *fields[KIND]) == 1:
                    size = {x: _unsigned(file, y, z) for x, y, z in elements(file, *fields[VIDEO])} if VIDEO in fields else {}
                    video = Track(0, 0.0, size.get(WIDTH, 0), size.get(HEIGHT, 0))
                    number = _unsigned(file, *fields[NUMBER]) if NUMBER in fields else 0
                    frame_time = _unsigned(file, *fields[FRAME_TIME]) if FRAME_TIME in fields else 0
                    break
        elif kind == CLUSTER:
            clusters.append((a, b))
    if video is None:
        raise ValueError("there is no video track")
    seconds = duration * scale / 1e9
    if frame_time and seconds > 0:
        video.frames = int(seconds * 1e9 / frame_time + 0.5)
        video.seconds = video.frames * frame_time / 1e9
        return video
    last = 0
    for a, b in clusters:
        begin = 0
        for kind, c, d in elements(file, a, b):
            begin = _unsigned(file, c, d) if kind == CLUSTER_TIME else begin
            blocks = [(c, d)] if kind == SIMPLE_BLOCK else [(x, y) for k, x, y in elements(file, c, d) if k == BLOCK] if kind == GROUP else []
            for x, y in blocks:
                head = file.bytes(x, min(12, y - x))
                track, at = vint(head, 0, False)
                if track == number:
                    if at + 2 > len(head):
                        raise ValueError("a block is cut short")
                    video.frames += 1
                    last = max(last, begin + struct.unpack_from(">h", head, at)[0])
    if frame_time:
        video.seconds = video.frames * frame_time / 1e9
    else:  # the last frame lasts as long as the others do
        shown = last * scale / 1e9
        video.seconds = seconds or (shown * video.frames / (video.frames - 1) if video.frames > 1 else 0.0)
    return video


def header(file, size: int) -> dict:
    """fps, frame_count, width and height of an open file (read_at)."""
    held = _File(file, size)
    if size < 8:
        raise ValueError("not a video file")
    start = held.bytes(0, 8)
    try:
        if start[:4] == EBML.to_bytes(4, "big"):
            return matroska(held).info()
        if start[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip", b"styp", b"pnot"):
            return iso_media(held).info()
    except struct.error as e:
        raise ValueError("a header is cut short") from e
    raise ValueError("neither ISO base media nor Matroska")


def prober():
    """probe(path) of the files' own headers, for models.probe_videos."""

    def probe(path: str) -> dict:
        with opened(path) as file:
            return header(file, file.size())

    return probe
