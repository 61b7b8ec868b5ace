"""Bytes of disk images: raw files (whole or split) and EWF segment sets, read-only and by position."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache
from typing import NamedTuple

import numpy as np

EWF_MAGIC = b"EVF\x09\x0d\x0a\xff\x00"
EWF2_MAGIC = b"EVF2\x0d\x0a\x81\x00"
#: Bytes of a section's descriptor, and of what stands before the first one.
DESCRIPTOR, FILE_HEADER = 76, 13
#: Sector ranges that are read from an error section.
MAX_ERRORS = 10_000

# Keys of the header section.
HEADER_KEYS = {
    "a": "description",
    "c": "case_number",
    "n": "evidence_number",
    "e": "examiner",
    "t": "notes",
    "md": "model",
    "sn": "serial",
    "av": "acquisition_software",
    "ov": "acquisition_os",
    "m": "acquired",
    "u": "system_date",
    "l": "device_label",
    "pid": "process_id",
}


class BadImage(Exception):
    """The file can't be read as an image."""


class Section(NamedTuple):
    kind: str
    at: int
    size: int
    next: int
    checked: bool


class Geometry(NamedTuple):
    chunk_size: int
    sector: int
    sectors: int


def extension(n: int) -> str:
    """Of segment n, from 1: E01 to E99, then EAA to ZZZ."""
    if 1 <= n < 100:
        return f"E{n:02d}"
    first, rest = divmod(n - 100, 26 * 26)
    if n < 1 or first > ord("Z") - ord("E"):
        raise ValueError(f"no segment {n}")
    return chr(ord("E") + first) + chr(65 + rest // 26) + chr(65 + rest % 26)


def segments(path: str) -> list[str]:
    """The files of the set that begins with path, up to the first gap; a file that begins no set is alone."""
    stem, ext = os.path.splitext(path)
    if re.fullmatch(r"\.[eE]01", ext):
        name = (lambda n: extension(n).lower()) if ext[1] == "e" else extension
    elif ext == ".001":
        name = "{:03d}".format
    else:
        return [path]
    found = [path]
    while os.path.exists(more := f"{stem}.{name(len(found) + 1)}"):
        found.append(more)
    return found


def is_ewf(path: str) -> bool:
    with open(path, "rb") as f:
        magic = f.read(8)
    if magic == EWF2_MAGIC:
        raise BadImage("EWF2 images are not supported")
    if magic != EWF_MAGIC and os.path.splitext(path)[1].lower() in (".e01", ".ex01", ".s01", ".l01"):
        raise BadImage("the file has no EWF signature")
    return magic == EWF_MAGIC


def walk(fd: int) -> Iterator[Section]:
    """The sections of a segment, by their links, until one ends the file or doesn't lead on."""
    size, at = os.fstat(fd).st_size, FILE_HEADER
    while at + DESCRIPTOR <= size:
        raw = os.pread(fd, DESCRIPTOR, at)
        kind, following, length = struct.unpack_from("<16sQQ", raw)
        known = struct.unpack_from("<I", raw, 72)[0] == zlib.adler32(raw[:72])
        yield (s := Section(kind.rstrip(b"\0").decode("latin-1"), at, length, following, known))
        if s.kind in ("done", "next") or following <= at:
            return
        at = following


def body(fd: int, s: Section, most: int = 1 << 20) -> bytes:
    return os.pread(fd, max(0, min(most, s.size - DESCRIPTOR)), s.at + DESCRIPTOR)


def geometry(fd: int, parts: list[Section]) -> Geometry | None:
    s = next((s for s in parts if s.kind in ("volume", "disk")), None)
    if s is None:
        return None
    # The short form, of 94 bytes, counts sectors in 32 bits.
    wide = s.size - DESCRIPTOR >= 1052
    _, per_chunk, sector, sectors = struct.unpack_from("<IIIQ" if wide else "<IIII", body(fd, s), 4)
    sector = sector or 512
    return Geometry((per_chunk or 64) * sector, sector, sectors)


def table_size(fd: int, table: Section) -> int:
    return struct.unpack("<I", os.pread(fd, 4, table.at + DESCRIPTOR))[0]


def table_chunks(fd: int, table: Section, parts: list[Section], chunk_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a table's chunks stand, their stored lengths, and whether they are packed.

    A chunk runs to the next one, and a table's last chunk to the next section. What can't be a length is taken
    as that of a chunk that isn't packed.
    """
    count, base = struct.unpack("<I4xQ", os.pread(fd, 16, table.at + DESCRIPTOR))
    raw = os.pread(fd, 4 * count, table.at + DESCRIPTOR + 24)
    entry = np.frombuffer(raw[: len(raw) // 4 * 4], "<u4")
    start = (entry & np.uint32(0x7FFFFFFF)).astype(np.int64) + base
    borders = np.array([s.at for s in parts] + [os.fstat(fd).st_size], np.int64)
    last = borders[np.minimum(np.searchsorted(borders, start[-1:], "right"), len(borders) - 1)]
    length = np.append(start[1:], last) - start
    odd = (length <= 0) | (length > chunk_size + 1024)
    return start, np.where(odd, chunk_size + 4, length), entry >> np.uint32(31) == 1


def unpack(raw: bytes, packed: bool, want: int) -> tuple[bytes, bool]:
    """A chunk's bytes, filled up with zeros, and whether any are missing."""
    try:
        data = zlib.decompressobj().decompress(raw, max(want, 1)) if packed else raw
    except zlib.error:
        data = b""
    return data[:want].ljust(want, b"\0"), len(data) < want


def header(text: str) -> dict[str, str]:
    """The fields of the category main: a line of keys, then one of values, parted by tabs."""
    m = re.search(r"^main\r?\n(.*)\n(.*)", text, re.MULTILINE)
    if not m:
        return {}
    pairs = zip(*(line.rstrip("\r").split("\t") for line in m.groups()), strict=False)
    out = {HEADER_KEYS[k]: v.strip() for k, v in pairs if k in HEADER_KEYS and v.strip()}
    return out | {k: _date(out[k]) for k in ("acquired", "system_date") if k in out}


def _date(v: str) -> str:
    """Seconds of the epoch as UTC, six numbers as local time, all else as it is."""
    if re.fullmatch("[0-9]{1,11}", v):
        return datetime.fromtimestamp(int(v), UTC).strftime("%Y-%m-%d %H:%M:%S UTC")
    if re.fullmatch(r"[0-9]{4}( [0-9]{1,2}){5}", v):
        return "{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d} (local)".format(*map(int, v.split()))
    return v


class Raw:
    """A raw image in one file or several."""

    kind, sector, chunk_size = "raw", 512, None

    def __init__(self, path: str) -> None:
        self.paths = segments(path)
        self.fds = [os.open(p, os.O_RDONLY) for p in self.paths]
        self.starts = np.concatenate([[0], np.cumsum([os.fstat(fd).st_size for fd in self.fds])])
        self.size = int(self.starts[-1])
        self.fields, self.md5, self.sha1, self.errors = {}, None, None, 0

    def read(self, at: int, n: int) -> bytes:
        out, end = [], min(at + n, self.size)
        while at < end:
            k = int(np.searchsorted(self.starts, at, "right")) - 1
            out.append(os.pread(self.fds[k], min(end, int(self.starts[k + 1])) - at, at - int(self.starts[k])))
            if not out[-1]:
                break
            at += len(out[-1])
        return b"".join(out)

    def close(self) -> None:
        for fd in self.fds:
            os.close(fd)


class Ewf:
    """An EWF segment set. Opening reads descriptors and table sizes; a table is read when a chunk in it is."""

    kind = "E01"

    def __init__(self, path: str) -> None:
        self.paths, self.fds, self.parts = segments(path), [], []
        self.fields, self.md5, self.sha1, self.errors, shape = {}, None, None, 0, None
        tables, sizes = [], []
        for k, p in enumerate(self.paths):
            self.fds.append(fd := os.open(p, os.O_RDONLY))
            if os.pread(fd, 8, 0) != EWF_MAGIC:
                self.close()
                raise BadImage(f"{os.path.basename(p)} is not an EWF segment")
            self.parts.append(list(walk(fd)))
            shape = shape or geometry(fd, self.parts[k])
            self._notes(fd, self.parts[k])
            for s in self.parts[k]:
                if s.kind == "table" and (n := table_size(fd, s)):
                    tables.append((k, s))
                    sizes.append(n)
            if self.parts[k] and self.parts[k][-1].kind == "done":
                break
        if shape is None or not tables:
            self.close()
            raise BadImage("no volume section" if shape is None else "no chunk table")
        self.chunk_size, self.sector = shape.chunk_size, shape.sector
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.size = shape.sectors * shape.sector or int(self.first[-1]) * shape.chunk_size
        self._table = lru_cache(64)(lambda i: table_chunks(self.fds[tables[i][0]], tables[i][1], self.parts[tables[i][0]], self.chunk_size))
        self._segment = lambda i: self.fds[tables[i][0]]
        self._chunk = lru_cache(256)(self._load)

    def _notes(self, fd: int, parts: list[Section]) -> None:
        texts = {}
        for s in parts:
            if s.kind in ("header", "header2"):
                texts.setdefault(s.kind, body(fd, s))
            elif s.kind == "hash":
                self.md5 = os.pread(fd, 16, s.at + DESCRIPTOR).hex()
            elif s.kind == "digest":
                both = os.pread(fd, 36, s.at + DESCRIPTOR)
                self.md5, self.sha1 = both[:16].hex() if any(both[:16]) else self.md5, both[16:].hex() if any(both[16:]) else None
            elif s.kind == "error2":
                self.errors += min(table_size(fd, s), MAX_ERRORS)
        for kind, code in (("header2", "utf-16"), ("header", "latin-1")):
            if kind in texts and not self.fields:
                self.fields = header(zlib.decompressobj().decompress(texts[kind]).decode(code, "replace"))

    def _load(self, n: int) -> bytes:
        want = min(self.chunk_size, self.size - n * self.chunk_size)
        i = int(np.searchsorted(self.first, n, "right")) - 1
        if i + 1 >= len(self.first):
            return bytes(want)
        start, length, packed = self._table(i)
        j = n - int(self.first[i])
        if j >= len(start):
            return bytes(want)
        return unpack(os.pread(self._segment(i), int(length[j]), int(start[j])), bool(packed[j]), want)[0]

    def read(self, at: int, n: int) -> bytes:
        end = min(at + n, self.size)
        if at >= end:
            return b""
        low, high = at // self.chunk_size, (end - 1) // self.chunk_size
        data = b"".join(self._chunk(k) for k in range(low, high + 1))
        return data[at - low * self.chunk_size : end - low * self.chunk_size]

    def close(self) -> None:
        while self.fds:
            os.close(self.fds.pop())


def open_image(path: str) -> Raw | Ewf:
    """By the file's first bytes, not its name."""
    return Ewf(path) if is_ewf(path) else Raw(path)
