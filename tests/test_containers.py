"""Headers of hand-written videos, and of damaged ones."""

import random
import struct
from io import BytesIO

import pytest

from framesieve.sources import containers as c


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return (struct.pack(">I4sQ", 1, kind, 16 + len(body)) if wide else struct.pack(">I4s", 8 + len(body), kind)) + body


def full(kind, version, flags, *parts):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def track(number, handler, times, scale, version, size=(320, 240), duration=0):
    long = "Q" if version else "I"
    head = struct.pack(f">{long}{long}I4x{long}", 0, 0, number, duration) + bytes(52) + struct.pack(">II", size[0] << 16, size[1] << 16)
    stts = full(b"stts", 0, 0, struct.pack(">I", len(times)), *(struct.pack(">II", *t) for t in times))
    media = full(b"mdhd", version, 0, struct.pack(f">{long}{long}I{long}HH", 0, 0, scale, duration, 0, 0))
    return box(b"trak", full(b"tkhd", version, 3, head), box(b"mdia", media, full(b"hdlr", 0, 0, bytes(4), handler, bytes(13)), box(b"minf", box(b"stbl", stts))))


def mp4(frames, version=0, wide=False, front=False):
    """A sound track, and one of pictures at 25 frames a second, of which the first lasts as long as two."""
    times = [(frames - 1, 40), (1, 40)] if frames > 1 else [(frames, 40)]
    movie = box(b"moov", full(b"mvhd", 0, 0, bytes(96)), track(1, b"soun", [(7, 1024)], 48000, version), track(2, b"vide", times, 1000, version), wide=wide)
    data = box(b"mdat", bytes(1000), wide=wide)
    return box(b"ftyp", b"isom", bytes(4)) + (movie + data if front else data + movie)


def fragmented():
    extends = box(b"mvex", full(b"trex", 0, 0, struct.pack(">IIIII", 2, 1, 40, 0, 0)))
    movie = box(b"moov", track(2, b"vide", [], 1000, 0, duration=0), extends)
    sized = full(b"trun", 0, 0x301, struct.pack(">Ii", 3, 0), *(struct.pack(">II", 80, 9) for _ in range(3)))
    plain = full(b"trun", 0, 0, struct.pack(">I", 5))
    one = box(b"moof", box(b"traf", full(b"tfhd", 0, 0, struct.pack(">I", 2)), sized, plain), box(b"traf", full(b"tfhd", 0, 0, struct.pack(">I", 1)), plain))
    other = box(b"moof", box(b"traf", full(b"tfhd", 0, 0xB, struct.pack(">IQII", 2, 0, 1, 20)), plain))
    return box(b"ftyp", b"isom", bytes(4)) + movie + one + box(b"mdat", bytes(50)) + other


def number(value, n=None):
    n = n or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind, *parts, unknown=False, n=None):
    body = b"".join(parts)
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + (b"\x01" + b"\xff" * 7 if unknown else number(len(body), n)) + body


def unsigned(kind, value):
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def mkv(duration=2000.0, frame_time=40_000_000, unknown=False, blocks=()):
    head = element(c.EBML, unsigned(0x4286, 1))
    info = element(c.INFO, unsigned(c.TIME_SCALE, 1_000_000), *([element(c.DURATION, struct.pack(">d", duration))] if duration else []))
    sound = element(c.ENTRY, unsigned(c.NUMBER, 1), unsigned(c.KIND, 2))
    pictures = element(c.ENTRY, unsigned(c.NUMBER, 2), unsigned(c.KIND, 1), *([unsigned(c.FRAME_TIME, frame_time)] if frame_time else []), element(c.VIDEO, unsigned(c.WIDTH, 640), unsigned(c.HEIGHT, 360)))
    clusters = []
    for begin, group in blocks:
        parts = [unsigned(c.CLUSTER_TIME, begin)]
        for of, at, grouped in group:
            raw = number(of) + struct.pack(">hB", at, 0) + bytes(20)
            parts.append(element(c.GROUP, element(c.BLOCK, raw)) if grouped else element(c.SIMPLE_BLOCK, raw, n=8))
        clusters.append(element(c.CLUSTER, *parts, unknown=unknown))
    return head + element(c.SEGMENT, info, element(c.TRACKS, sound, pictures), *clusters, unknown=unknown)


class Ranges(BytesIO):
    """A file that notes how much of it is read."""

    total = 0

    def read_at(self, n, at):
        self.total += n
        self.seek(at)
        return self.read(n)


def read(data):
    return c.header(Ranges(data), len(data))


@pytest.mark.parametrize("version", [0, 1])
@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("front", [False, True])
def test_iso_media(version, wide, front):
    assert read(mp4(50, version, wide, front)) == {"fps": 25.0, "frame_count": 50, "width": 320, "height": 240}


def test_fragments():
    made = read(fragmented())
    assert made["frame_count"] == 13 and made["fps"] == pytest.approx(13 / ((3 * 80 + 5 * 40 + 5 * 20) / 1000))


def test_media_data_is_not_read():
    file = Ranges(box(b"ftyp", bytes(8)) + box(b"mdat", bytes(5_000_000)) + mp4(10)[16:])
    assert c.header(file, len(file.getvalue()))["frame_count"] == 10 and file.total < 3000


BLOCKS = [(0, [(2, 0, False), (1, 0, False), (2, 40, True)]), (80, [(2, 0, False), (2, 40, True), (1, 7, True)])]


@pytest.mark.parametrize("unknown", [False, True])
def test_matroska(unknown):
    assert read(mkv(unknown=unknown)) == {"fps": 25.0, "frame_count": 50, "width": 640, "height": 360}
    counted = read(mkv(160.0, 0, unknown, BLOCKS))
    assert (counted["frame_count"], counted["fps"]) == (4, 25.0)
    shown = read(mkv(None, 0, unknown, BLOCKS))
    assert (shown["frame_count"], round(shown["fps"], 9)) == (4, 25.0)
    timed = read(mkv(None, 20_000_000, unknown, BLOCKS))
    assert (timed["frame_count"], timed["fps"]) == (4, 50.0)


@pytest.mark.parametrize("data,message", [
    (b"", "not a video"), (b"RIFF1234AVI ", "neither"), (mp4(50)[:-9], "wrong size|ends within"), (mp4(0), "no frames"), (box(b"ftyp", bytes(8)), "no moov"),
    (box(b"ftyp") + box(b"moov", track(1, b"soun", [(1, 1)], 1000, 0)), "no video track"), (box(b"ftyp") + box(b"moov", track(1, b"vide", [(1, 1)], 0, 0)), "no time scale"),
    (box(b"ftyp") + box(b"moov", track(1, b"vide", [(5, 0)], 1000, 0)), "no duration"), (element(c.EBML, unsigned(0x4286, 1)), "no segment"), (mkv()[:-3], "wrong size"), (mkv(None, 0), "no frames"),
    (element(c.EBML) + element(c.SEGMENT, element(c.TRACKS)), "no video track"), (box(b"ftyp") + b"\0\0\0\4moov", "wrong size"),
])
def test_damage(data, message):
    with pytest.raises(ValueError, match=message):
        read(data)


def test_any_damage_is_a_value_error():
    rng = random.Random(6)
    for data in (mp4(50), fragmented(), mkv(160.0, 0, False, BLOCKS), mkv(160.0, 0, True, BLOCKS)):
        for _ in range(400):
            broken = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                broken[rng.randrange(len(broken))] = rng.randrange(256)
            broken = bytes(broken[: rng.randint(0, len(broken))]) if rng.random() < 0.3 else bytes(broken)
            try:
                made = read(broken)
                assert made["frame_count"] > 0 and made["fps"] > 0
            except ValueError:
                pass
