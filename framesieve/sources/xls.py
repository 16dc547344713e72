"""Legacy workbooks: sectors of a compound file, and the BIFF8 records of a first sheet's cells in it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

# fixed values: the magic of compound files, marks of sector chains, and numbers of BIFF8 records
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, LAST_SECTOR = 0xFFFFFFFF, 0xFFFFFFFA
BOF, EOF, SHEET, SST, CONTINUE, PASSWORD = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0x2F
LABEL_SST, LABEL, RICH_LABEL, NUMBER, RK, MANY_RK, FORMULA, STRING, BOOL_OR_ERROR = 0xFD, 0x204, 0xD6, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205


class CompoundFile:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, self.mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or self.mini_shift >= shift:
            raise ValueError("a compound file of unknown sectors")
        self.size = 1 << shift
        n_fat, directory = struct.unpack_from("<II", data, 44)
        self.cutoff, mini, _, more, n_more = struct.unpack_from("<IIIII", data, 56)
        places = list(struct.unpack_from("<109I", data, 76))
        for _ in range(n_more):
            block = self._sector(more)
            places += struct.unpack(f"<{self.size // 4 - 1}I", block[:-4])
            more = struct.unpack("<I", block[-4:])[0]
        self.fat = [x for p in [p for p in places if p != FREE][:n_fat] for x in struct.unpack(f"<{self.size // 4}I", self._sector(p))]
        entries = self._chain(directory)
        self.entries = {}
        for at in range(0, len(entries) - 127, 128):
            (length, kind), (start, size) = struct.unpack_from("<HB", entries, at + 64), struct.unpack_from("<II", entries, at + 116)
            if kind in (2, 5) and 2 <= length <= 64:
                self.entries[entries[at : at + length - 2].decode("utf-16-le", "replace")] = (kind, start, size)
        table = self._chain(mini) if mini < LAST_SECTOR else b""
        self.mini_fat = list(struct.unpack(f"<{len(table) // 4}I", table))
        root = next(((s, n) for kind, s, n in self.entries.values() if kind == 5), (FREE, 0))
        self.mini = self._chain(root[0]) if root[0] < LAST_SECTOR else b""

    def _sector(self, number: int) -> bytes:
        at = (number + 1) * self.size
        block = self.data[at : at + self.size]
        if len(block) < self.size:
            raise ValueError("a sector lies outside the file")
        return block

    def _numbers(self, start: int, table: list[int]) -> Iterator[int]:
        seen = 0
        while start < LAST_SECTOR:
            if start >= len(table) or seen > len(table):
                raise ValueError("a chain of sectors is broken")
            yield start
            start, seen = table[start], seen + 1

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._numbers(start, self.fat)))

    def stream(self, *names: str) -> bytes:
        """The first of the streams that is there."""
        found = next((self.entries[n] for n in names if n in self.entries), None)
        if found is None:
            raise ValueError(f"there is no {' or '.join(names)}")
        _, start, size = found
        if size >= self.cutoff:
            out = self._chain(start)
        else:
            small = 1 << self.mini_shift
            out = b"".join(self.mini[k * small : (k + 1) * small] for k in self._numbers(start, self.mini_fat))
        if len(out) < size:
            raise ValueError("a stream is cut short")
        return out[:size]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        if at + 4 + size > len(stream):
            raise ValueError("a record is cut short")
        yield kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


class _Texts:
    """Strings over a record and those that continue it: where characters go on in the next, it says anew how wide they are."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.k, self.at = parts, 0, 0

    def _on(self) -> None:
        while self.k < len(self.parts) and self.at >= len(self.parts[self.k]):
            self.k, self.at = self.k + 1, 0
        if self.k >= len(self.parts):
            raise ValueError("a string is cut short")

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            self._on()
            piece = self.parts[self.k][self.at : self.at + n - len(out)]
            out, self.at = out + piece, self.at + len(piece)
        return out

    def text(self) -> str:
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while count:
            if self.at >= len(self.parts[self.k]):
                self._on()
                wide = self.take(1)[0] & 1
                continue
            n = min(count, (len(self.parts[self.k]) - self.at) >> wide)
            if not n:
                raise ValueError("a character is cut in two")
            out.append(self.take(n << wide).decode("utf-16-le" if wide else "latin-1", "replace"))
            count -= n
        self.take(4 * runs + extra)
        return "".join(out)


def rk_number(raw: int) -> float:
    """A number of 30 bits: a whole one or the upper half of a double, and perhaps a hundredth of it."""
    value = raw - (1 << 32) >> 2 if raw >> 31 else raw >> 2
    out = float(value) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & ~3) << 32))[0]
    return out / 100 if raw & 1 else out


def _number(x: float) -> str:
    return str(int(x)) if x == x and abs(x) < 1e15 and x == int(x) else repr(x)


def xls_rows(data: bytes) -> list[list[str]]:
    """Cells of a workbook's first sheet, as text; formulas by their last results."""
    try:
        return _rows(CompoundFile(data).stream("Workbook", "Book"))
    except struct.error as e:
        raise ValueError("a record is cut short") from e


def _rows(stream: bytes) -> list[list[str]]:
    shared, first, strings = [], None, []
    for kind, body in records(stream):
        if kind == PASSWORD:
            raise ValueError("the workbook is encrypted")
        if kind == BOF and struct.unpack_from("<H", body)[0] != 0x600:
            raise ValueError("not a BIFF8 workbook")
        if kind == SHEET and first is None and body[5] == 0:
            first = struct.unpack_from("<I", body)[0]
        if kind == SST:
            strings = [body]
        elif kind == CONTINUE and strings:
            strings.append(body)
        elif strings and not shared:
            shared = _shared(strings)
        if kind == EOF:
            break
    if first is None:
        raise ValueError("there is no worksheet")
    cells: dict[tuple[int, int], str] = {}
    waiting, begun = None, 0
    for kind, body in records(stream, first):
        begun += kind == BOF
        if not begun:
            raise ValueError("the worksheet isn't where the workbook says")
        if kind == EOF:
            begun -= 1
            if not begun:
                break
        if begun > 1:  # a chart within the sheet
            continue
        if kind == STRING and waiting:
            cells[waiting] = _Texts([body]).text()
        if kind not in (LABEL_SST, LABEL, RICH_LABEL, NUMBER, RK, MANY_RK, FORMULA, BOOL_OR_ERROR):
            continue
        row, column = struct.unpack_from("<HH", body)
        waiting = None
        if kind == LABEL_SST:
            (k,) = struct.unpack_from("<I", body, 6)
            if k >= len(shared):
                raise ValueError("a cell names a string that isn't there")
            cells[row, column] = shared[k]
        elif kind in (LABEL, RICH_LABEL):
            cells[row, column] = _Texts([body[6:]]).text()
        elif kind == NUMBER:
            cells[row, column] = _number(struct.unpack_from("<d", body, 6)[0])
        elif kind == RK:
            cells[row, column] = _number(rk_number(struct.unpack_from("<I", body, 6)[0]))
        elif kind == MANY_RK:
            for k in range((len(body) - 6) // 6):
                cells[row, column + k] = _number(rk_number(struct.unpack_from("<I", body, 6 + 6 * k)[0]))
        elif kind == BOOL_OR_ERROR:
            cells[row, column] = "" if body[7] else ("True" if body[6] else "False")
        elif body[12:14] != b"\xff\xff":
            cells[row, column] = _number(struct.unpack_from("<d", body, 6)[0])
        elif body[6] == 0:
            waiting = (row, column)
        elif body[6] == 1:
            cells[row, column] = "True" if body[8] else "False"
    out: list[list[str]] = [[] for _ in range(max((r for r, _ in cells), default=-1) + 1)]
    for (row, column), text in sorted(cells.items()):
        out[row] += [""] * (column - len(out[row])) + [text]
    return out


def _shared(parts: list[bytes]) -> list[str]:
    (n,) = struct.unpack_from("<I", parts[0], 4)
    texts = _Texts([parts[0][8:], *parts[1:]])
    return [texts.text() for _ in range(n)]
