"""Chosen frames of a video from any reader that can seek a little, whatever its seeks are worth."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

#: Frames per second where a reader doesn't know, seconds before the first frame that a seek by time aims at, and frames
#: (or one second of them, where that is more) that a seek by frame may miss by (fixed values).
UNKNOWN_FPS, MARGIN, MISS = 30.0, 1.0, 5


class Reader(Protocol):
    """An open video.  position() is the frame that read() would give next, negative where it isn't known; the seeks say
    whether they did anything, which readers don't always know; read() gives None at the end."""

    fps: float

    def seek_frame(self, frame: int) -> bool: ...
    def seek_seconds(self, seconds: float) -> bool: ...
    def position(self) -> float: ...
    def read(self) -> bytes | None: ...
    def close(self) -> None: ...


def _at(reader: Reader) -> int | None:
    """The frame that comes next, as far as the reader says."""
    place = reader.position()
    return round(place) if place >= 0 else None


def _by_frame(reader: Reader, frame: int, fps: float) -> int | None:
    done, at = reader.seek_frame(frame), _at(reader)
    return at if done and at is not None and abs(at - frame) <= max(MISS, int(fps)) else None


def _by_time(reader: Reader, frame: int, fps: float) -> int | None:
    done, at = reader.seek_seconds(max(0.0, frame / fps - MARGIN)), _at(reader)
    return at if done and at is not None and at <= frame else None


def selective(open_reader: Callable[[str], Reader]) -> Callable[[str, list[int]], Iterator[tuple[int, bytes]]]:
    """decode(path, ids) over open_reader: yields (frame id, content) of the wanted frames in ascending order, each once.

    It begins with a seek by frame, believed only where the reader ends up near it; else by time, a second early, believed
    only where that isn't past the frame; else it reads a freshly opened video from its first frame.  From there frames are
    counted as they are read.  Negative ids are left out, and the video's end ends the frames.
    """

    def decode(path: str, ids: list[int]) -> Iterator[tuple[int, bytes]]:
        wanted = sorted({int(i) for i in ids if i >= 0})
        if not wanted:
            return
        reader = open_reader(path)
        try:
            fps = reader.fps if reader.fps > 0 else UNKNOWN_FPS
            at = None
            for seek in (_by_frame, _by_time):
                at = seek(reader, wanted[0], fps)
                if at is not None:
                    break
            if at is None:
                reader.close()
                reader, at = open_reader(path), 0
            ahead = iter(wanted)
            target = next((i for i in ahead if i >= at), None)
            while target is not None:
                content = reader.read()
                if content is None:
                    return
                if at == target:
                    yield at, content
                    target = next(ahead, None)
                at += 1
        finally:
            reader.close()

    return decode
