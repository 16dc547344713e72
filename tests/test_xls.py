"""Workbooks of hand-written sectors and records, and damaged ones."""

import random
import struct

import pytest

from framesieve.sources import files, xls


def record(kind, *parts):
    body = b"".join(parts)
    return struct.pack("<HH", kind, len(body)) + body


def string(text, wide=None, runs=0, extra=b""):
    wide = any(ord(c) > 255 for c in text) if wide is None else wide
    flags = wide | 8 * bool(runs) | 4 * bool(extra)
    return struct.pack("<HB", len(text), flags) + (struct.pack("<H", runs) if runs else b"") + (struct.pack("<I", len(extra)) if extra else b"") + text.encode("utf-16-le" if wide else "latin-1") + bytes(4 * runs) + extra


def cell(row, column):
    return struct.pack("<HHH", row, column, 0)


def workbook(shared, cells, version=0x600, extra=b""):
    """The records of a workbook with a chart's sheet and then the worksheet; shared: bodies of the string table and those
    that continue it."""
    begin = record(xls.BOF, struct.pack("<HH", version, 5), bytes(12)) + extra
    table = record(xls.SST, shared[0]) + b"".join(record(xls.CONTINUE, s) for s in shared[1:]) if shared else b""
    names = (("Chart", 2), ("One", 0), ("Two", 0))
    size = len(begin) + len(table) + sum(len(record(xls.SHEET, bytes(6), bytes([len(n), 0]), n.encode())) for n, _ in names) + 4
    sheet = record(xls.BOF, struct.pack("<HH", version, 16), bytes(12)) + b"".join(cells) + record(xls.EOF)
    other = record(xls.BOF, struct.pack("<HH", version, 16), bytes(12)) + record(xls.EOF)
    heads = b"".join(record(xls.SHEET, struct.pack("<IBB", at, 0, kind), bytes([len(n), 0]), n.encode()) for (n, kind), at in zip(names, (size + len(sheet), size, size + len(sheet)), strict=True))
    return begin + heads + table + record(xls.EOF) + sheet + other


def compound(stream, name="Workbook", small=True):
    """A compound file of 512-byte sectors; small: in 64-byte sectors of the root's stream where the format wants that."""
    pad = lambda b, n=512: b + bytes(-len(b) % n)
    stream = stream if small else stream.ljust(5000, b"\0")
    mini = len(stream) < 4096
    body = pad(stream, 64) if mini else pad(stream)
    sectors, fat = [], []

    def add(data, end=0xFFFFFFFE):
        first = len(sectors)
        for at in range(0, len(data), 512):
            sectors.append(data[at : at + 512])
            fat.append(len(sectors) if at + 512 < len(data) else end)
        return first

    def entry(text, kind, start, size):
        raw = text.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + bytes(48) + struct.pack("<II", start, size) + bytes(4)

    held = add(pad(body))
    table = 0xFFFFFFFE
    if mini:
        n = len(body) // 64
        table = add(pad(struct.pack(f"<{n}I", *range(1, n), 0xFFFFFFFE)).ljust(512, b"\xff"))
    root = entry("Root Entry", 5, held if mini else 0xFFFFFFFE, len(body) if mini else 0)
    directory = add(pad(root + entry(name, 2, 0 if mini else held, len(stream))))
    need = -(-(len(fat) + 1) // 127) if len(fat) > 127 else 1
    first = len(sectors)
    fat += [0xFFFFFFFD] * need
    fat += [0xFFFFFFFF] * (-len(fat) % 128)
    blocks = struct.pack(f"<{len(fat)}I", *fat)
    sectors += [blocks[at : at + 512] for at in range(0, len(blocks), 512)]
    places = list(range(first, first + len(blocks) // 512))
    head = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIII", 0, len(places), directory, 0)
    head += struct.pack("<IIIII", 4096, table, int(mini), 0xFFFFFFFE, 0) + struct.pack(f"<{len(places)}I", *places)
    return head.ljust(512, b"\xff") + b"".join(sectors)


WORDS = ["Query Name", "Description", "Người đàn ông", "plain", "a rich one", "phonetic"]


def table(*cuts):
    """The string table, cut into records after so many bytes; where a cut is within characters the next begins with how
    wide they are."""
    raw = struct.pack("<II", 9, len(WORDS)) + string(WORDS[0]) + string(WORDS[1], True) + string(WORDS[2]) + string(WORDS[3]) + string(WORDS[4], runs=2) + string(WORDS[5], True, 1, b"xyz")
    return [raw[a:b] for a, b in zip((0, *cuts), (*cuts, len(raw)), strict=True)]


CELLS = [
    record(xls.LABEL_SST, cell(0, 0), struct.pack("<I", 0)), record(xls.LABEL_SST, cell(0, 2), struct.pack("<I", 1)), record(xls.LABEL, cell(1, 0), string("qa-1")),
    record(xls.LABEL_SST, cell(1, 2), struct.pack("<I", 2)), record(xls.NUMBER, cell(2, 0), struct.pack("<d", 12.0)), record(xls.RICH_LABEL, cell(2, 2), string("naïve")),
    record(xls.RK, cell(3, 0), struct.pack("<I", 7 << 2 | 2)), record(xls.MANY_RK, struct.pack("<HH", 4, 0), *(struct.pack("<HI", 0, x) for x in ((1 << 32) - 8 | 2, 1234 << 2 | 3, 0x3FF80000)), struct.pack("<H", 2)),
    record(xls.FORMULA, cell(5, 0), struct.pack("<d", 2.5), bytes(8)), record(xls.FORMULA, cell(5, 1), b"\0" * 6 + b"\xff\xff", bytes(8)), record(xls.STRING, string("result")),
    record(xls.FORMULA, cell(5, 2), b"\1\0\1\0\0\0\xff\xff", bytes(8)), record(xls.BOOL_OR_ERROR, cell(6, 0), b"\0\0"), record(xls.BOOL_OR_ERROR, cell(6, 1), b"\7\1"), record(0x201, cell(6, 2)),
]
ROWS = [["Query Name", "", "Description"], ["qa-1", "", "Người đàn ông"], ["12", "", "naïve"], ["7"], ["-2", "12.34", "1.5"], ["2.5", "result", "True"], ["False", ""]]


@pytest.mark.parametrize("small", [True, False])
def test_cells(small):
    assert xls.xls_rows(compound(workbook(table(), CELLS), small=small)) == ROWS
    assert xls.xls_rows(compound(workbook(table(), CELLS), "Book", small)) == ROWS


def test_strings_go_on_in_the_next_record():
    """A cut between strings, between their fields, and within narrow and wide characters."""
    whole = table()[0]
    for at in range(9, len(whole)):
        narrow, wide = at - (8 + 3), at - (8 + 3 + 10 + 3)
        parts = table(at)
        if 0 <= narrow < 10:
            parts[1] = b"\0" + parts[1]
        elif 0 <= wide < 22:
            if wide % 2:
                continue
            parts[1] = b"\1" + parts[1]
        elif at > 8 + 3 + 10 + 3 + 22:
            break
        assert xls.xls_rows(compound(workbook(parts, CELLS))) == ROWS, at
    # characters that become narrow again
    parts = [struct.pack("<II", 1, 1) + struct.pack("<HB", 4, 1) + "Ng".encode("utf-16-le"), b"\0on"]
    assert xls.xls_rows(compound(workbook(parts, [record(xls.LABEL_SST, cell(0, 0), struct.pack("<I", 0))]))) == [["Ngon"]]


def test_large_sheet():
    cells = [record(xls.NUMBER, cell(r, c), struct.pack("<d", r * c)) for r in range(900) for c in range(5)]
    made = xls.xls_rows(compound(workbook([], cells)))
    assert made == [[str(r * c) for c in range(5)] for r in range(900)]


def test_read_queries(spark, tmp_path):
    (tmp_path / "q.XLS").write_bytes(compound(workbook(table(), CELLS)))
    assert [(r.query_id, r.query_text) for r in files.read_queries(spark, str(tmp_path / "q.XLS")).collect()] == [("qa-1", "Người đàn ông"), ("12", "naïve"), ("-2", "1.5"), ("2.5", "True")]


@pytest.mark.parametrize("data,message", [
    (b"PK\3\4", "not a compound"), (xls.MAGIC + bytes(600), "unknown sectors"), (compound(b"x", "Other"), "no Workbook"), (compound(workbook([], [], 0x500)), "BIFF8"),
    (compound(workbook([], [], extra=record(xls.PASSWORD, bytes(4)))), "encrypted"), (compound(workbook([], [record(xls.LABEL_SST, cell(0, 0), struct.pack("<I", 3))])), "isn't there"),
    (compound(record(xls.BOF, struct.pack("<HH", 0x600, 5)) + record(xls.EOF)), "no worksheet"),
])
def test_damage(data, message):
    with pytest.raises(ValueError, match=message):
        xls.xls_rows(data)


def test_any_damage_is_a_value_error():
    rng = random.Random(3)
    for small in (True, False):
        data = compound(workbook(table(), CELLS), small=small)
        for _ in range(600):
            broken = bytearray(data)
            for _ in range(rng.randint(1, 4)):
                broken[rng.randrange(len(broken))] = rng.randrange(256)
            broken = bytes(broken[: rng.randint(0, len(broken))]) if rng.random() < 0.3 else bytes(broken)
            try:
                xls.xls_rows(broken)
            except ValueError:
                pass
