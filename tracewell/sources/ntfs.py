"""Files and folders of NTFS volumes, by position: what triage reads beside the file table's scan."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from . import mft

#: Kinds of attributes.
LISTED, NAME, DATA, ROOT, BLOCKS, IN_USE = 0x20, 0x30, 0x80, 0x90, 0xA0, 0xB0
#: The record of a volume's root folder, the name of folder indexes, and the namespace of names kept for DOS alone.
TOP, FOLDER_INDEX, DOS = 5, "$I30", 2
#: Most bytes of a file, unless a caller says otherwise.
MOST = 64 << 20


class BadFile(ValueError):
    """A file is there but can't be read."""


class Piece(NamedTuple):
    """An attribute, or the part of it that one record holds: bytes, or runs of clusters from the cluster number first on."""

    kind: int
    name: str
    first: int
    size: int
    filled: int
    flags: int
    held: bytes | None
    runs: tuple[tuple[int, int | None], ...]


def pieces(record: bytes) -> list[Piece]:
    out = []
    (at,), (end,) = struct.unpack_from("<H", record, 20), struct.unpack_from("<I", record, 24)
    end = min(end, len(record))
    while at + 16 <= end:
        kind, length, apart, letters, name_at, flags = struct.unpack_from("<IIBBHH", record, at)
        if kind == 0xFFFFFFFF or length < 16 or at + length > end:
            break
        raw = record[at : at + length]
        name = raw[name_at : name_at + 2 * letters].decode("utf-16-le", "replace")
        if apart:
            first, _, listed = struct.unpack_from("<QQH", raw, 16)
            _, size, filled = struct.unpack_from("<QQQ", raw, 40)
            out.append(Piece(kind, name, first, size, filled, flags, None, tuple(mft.runs(raw[listed:]))))
        else:
            size, begin = struct.unpack_from("<IH", raw, 16)
            out.append(Piece(kind, name, 0, size, size, flags, raw[begin : begin + size], ()))
        at += length
    return out


def _names(raw: bytes, node: int) -> Iterator[tuple[str, int]]:
    """Name and record number of the entries of an index node whose header is at node."""
    start, end = struct.unpack_from("<II", raw, node)
    at, end = node + start, min(node + end, len(raw))
    while at + 16 <= end:
        ref, length, key, flags = struct.unpack_from("<QHHI", raw, at)
        if flags & 2 or length < 16:
            return
        entry = raw[at + 16 : at + 16 + key]
        if len(entry) >= 66 and entry[65] != DOS:
            yield entry[66 : 66 + 2 * entry[64]].decode("utf-16-le", "replace"), ref & int(mft.NUMBER)
        at += length


class Volume:
    def __init__(self, image, offset: int) -> None:
        self.image, self.table = image, mft.table(image, offset)
        own = self._parts(0, self.record(0), DATA, "")
        if own:
            # The file table's own runs may go on in further records.
            self.table = self.table._replace(runs=tuple(r for p in own for r in p.runs), count=own[0].size // self.table.record)

    def record(self, number: int) -> bytes | None:
        """The record, mended; null if it isn't one or is torn."""
        raw = mft._read(self.image, self.table, number * self.table.record, self.table.record)
        if len(raw) < self.table.record or raw[:4] != b"FILE":
            return None
        m = np.frombuffer(raw, np.uint8)[None].copy()
        return m[0].tobytes() if mft.mended(m)[0] else None

    def _parts(self, number: int, record: bytes | None, kind: int, name: str) -> list[Piece]:
        """All pieces of an attribute, in order, those in other records that its list names included."""
        if record is None:
            return []
        here = pieces(record)
        found = [p for p in here if (p.kind, p.name) == (kind, name)]
        listing = next((p for p in here if p.kind == LISTED), None)
        if listing is None or (found and found[0].held is not None):
            return found
        raw, at, others = self._bytes([listing]), 0, []
        while at + 26 <= len(raw):
            what, length, letters, name_at, _, ref = struct.unpack_from("<IHBBQQ", raw, at)
            if not length:
                break
            ref &= int(mft.NUMBER)
            if what == kind and ref != number and ref not in others and raw[at + name_at : at + name_at + 2 * letters].decode("utf-16-le", "replace") == name:
                others.append(ref)
            at += length
        for ref in others:
            found += [p for p in pieces(self.record(ref) or bytes(28)) if (p.kind, p.name) == (kind, name)]
        return sorted(found, key=lambda p: p.first)

    def _bytes(self, parts: list[Piece], at: int = 0, n: int | None = None) -> bytes:
        if parts[0].held is not None:
            return parts[0].held[at:] if n is None else parts[0].held[at : at + n]
        stored = self.table._replace(runs=tuple(r for p in parts for r in p.runs))
        return mft._read(self.image, stored, at, parts[0].size - at if n is None else n)

    def content(self, number: int, most: int = MOST) -> bytes:
        """A file's bytes; what lies behind its initialised part is zeros."""
        parts = self._parts(number, self.record(number), DATA, "")
        if not parts:
            raise BadFile("the file has no data")
        head = parts[0]
        if head.held is None:
            if head.flags & 0x0001:
                raise BadFile("the file is compressed by NTFS, which is not supported")
            if head.flags & 0x4000:
                raise BadFile("the file is encrypted by EFS")
            if head.size > most:
                raise BadFile(f"the file has {head.size:,} bytes, too many to read")
        data = self._bytes(parts)[:most]
        return data[: head.filled].ljust(len(data), b"\0")

    def entries(self, number: int) -> Iterator[tuple[str, int]]:
        """Name and record number of what is in a folder; names for DOS alone are left out."""
        record = self.record(number)
        root = self._parts(number, record, ROOT, FOLDER_INDEX)
        if not root or root[0].held is None:
            return
        yield from _names(root[0].held, 16)
        blocks = self._parts(number, record, BLOCKS, FOLDER_INDEX)
        if not blocks:
            return
        marks = self._parts(number, record, IN_USE, FOLDER_INDEX)
        used = np.unpackbits(np.frombuffer(self._bytes(marks), np.uint8), bitorder="little") if marks else None
        (width,) = struct.unpack_from("<I", root[0].held, 8)
        for k in range(blocks[0].size // width if width >= 512 else 0):
            if used is not None and (k >= len(used) or not used[k]):
                continue
            m = np.frombuffer(self._bytes(blocks, k * width, width), np.uint8)[None].copy()
            if m.shape[1] == width and m[0, :4].tobytes() == b"INDX" and mft.mended(m)[0]:
                yield from _names(m[0].tobytes(), 24)

    def is_folder(self, number: int) -> bool:
        record = self.record(number)
        return record is not None and bool(struct.unpack_from("<H", record, 22)[0] & 2)

    def find(self, path: str) -> int | None:
        """The record of a path below the root; case doesn't count, and both slashes part names."""
        at = TOP
        for part in filter(None, path.replace("/", "\\").split("\\")):
            if not self.is_folder(at):
                return None
            at = next((n for name, n in self.entries(at) if name.casefold() == part.casefold()), None)
            if at is None:
                return None
        return at if self.record(at) is not None else None

    def file(self, path: str, most: int = MOST) -> bytes | None:
        """Null if there is no such file."""
        at = self.find(path)
        return None if at is None or self.is_folder(at) else self.content(at, most)
