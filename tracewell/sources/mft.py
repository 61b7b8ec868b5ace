"""The master file table of NTFS volumes: ranges of records, decoded in lockstep over a matrix with a record in each row."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Records in a partition of a scan, and in a batch of it.
PER_PARTITION, PER_BATCH = 1 << 18, 4096
#: Bits of a reference that are a record's number.
NUMBER = np.uint64((1 << 48) - 1)
#: Order of preference of a name's namespaces: Win32, with or without DOS, then POSIX, then DOS alone.
PREFERENCE = np.full(256, 3)
PREFERENCE[[1, 3, 0, 2]] = 0, 0, 1, 2
COLUMNS = "image string, volume int, number long, flags int, parent long, name string, modified_ft long, size long, error string"


class BadVolume(ValueError):
    """The volume's boot record or its table's own record can't be read."""


class Table(NamedTuple):
    offset: int
    cluster: int
    record: int
    count: int
    runs: tuple[tuple[int, int | None], ...]


def runs(raw: bytes) -> Iterator[tuple[int, int | None]]:
    """(clusters, first cluster) of a run list; null for clusters that aren't stored."""
    at, cluster = 0, 0
    while at < len(raw) and raw[at]:
        n, m = raw[at] & 15, raw[at] >> 4
        length, moved = raw[at + 1 : at + 1 + n], raw[at + 1 + n : at + 1 + n + m]
        cluster += int.from_bytes(moved, "little", signed=True)
        yield int.from_bytes(length, "little"), cluster if m else None
        at += 1 + n + m


def table(image, offset: int) -> Table:
    boot = image.read(offset, 512)
    if len(boot) < 512 or boot[3:11] != b"NTFS    ":
        raise BadVolume("no NTFS boot record")
    sector, per = struct.unpack_from("<HB", boot, 11)
    cluster = sector * (per if per <= 128 else 1 << min(256 - per, 31))
    (per_record,) = struct.unpack_from("<b", boot, 64)
    record = 1 << min(-per_record, 31) if per_record < 0 else per_record * cluster
    if not cluster or not 512 <= record <= 65536 or record % 512:
        raise BadVolume("damaged NTFS boot record")
    first = np.frombuffer(image.read(offset + struct.unpack_from("<Q", boot, 48)[0] * cluster, record), np.uint8)
    if len(first) < record or bytes(first[:4]) != b"FILE":
        raise BadVolume("no record of the master file table")
    rows = first[None].copy()
    if not mended(rows)[0]:
        raise BadVolume("torn record of the master file table")
    raw = rows[0].tobytes()
    (at,) = struct.unpack_from("<H", raw, 20)
    while at + 16 <= len(raw):
        kind, length, stored_apart, name = struct.unpack_from("<IIBB", raw, at)
        if kind == 0xFFFFFFFF or length < 16:
            break
        if kind == 0x80 and stored_apart and not name and at + 56 <= len(raw):
            (where,), (size,) = struct.unpack_from("<H", raw, at + 32), struct.unpack_from("<Q", raw, at + 48)
            return Table(offset, cluster, record, size // record, tuple(runs(raw[at + where : at + length])))
        at += length
    raise BadVolume("the master file table has no data")


def _read(image, t: Table, at: int, n: int) -> bytes:
    """Bytes of the table; what isn't stored is zeros."""
    out, before = [], 0
    for clusters, first in t.runs:
        size = clusters * t.cluster
        low, high = max(at, before), min(at + n, before + size)
        if low < high:
            piece = image.read(t.offset + first * t.cluster + low - before, high - low) if first is not None else b""
            out.append(piece.ljust(high - low, b"\0"))
        before += size
    return b"".join(out)


def _number(m: np.ndarray, rows: np.ndarray, at: np.ndarray, width: int, broken: np.ndarray) -> np.ndarray:
    """Little-endian numbers at a place in each of the rows; rows are broken that end before."""
    if not len(rows):
        return np.zeros(0, np.uint64)
    n, at = m.shape[1], at.astype(np.int64)
    broken[rows[at + width > n]] = True
    flat = m.reshape(-1)
    # A number begins at every byte.
    every = np.ndarray((flat.size - width + 1,), f"<u{width}", flat, strides=(1,))
    return every[rows * n + np.minimum(at, n - width)].astype(np.uint64)


def _texts(m: np.ndarray, at: np.ndarray, letters: np.ndarray) -> list[str]:
    """UTF-16 at a place in each row of m."""
    n = m.shape[1]
    size = np.maximum(0, np.minimum(2 * letters, n - at)) // 2 * 2
    upto = np.cumsum(size + 2)
    inside = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(upto - size - 2, size + 2)
    # Each text is followed by a zero.
    place = np.repeat(np.arange(len(m)) * n + at, size + 2) + inside
    raw = m.reshape(-1)[np.minimum(place, m.size - 1)]
    ends = upto - 2
    raw[ends] = raw[ends + 1] = 0
    found = raw.tobytes().decode("utf-16-le", "replace").split("\0")[:-1]
    if len(found) == len(m):
        return found
    # A zero inside a text: damage, and rare.
    return [bytes(r[a : a + k]).decode("utf-16-le", "replace") for r, a, k in zip(m, at.tolist(), size.tolist(), strict=True)]


def mended(m: np.ndarray) -> np.ndarray:
    """Puts back the last two bytes of each 512; whether each row was whole."""
    n, width = m.shape
    rows, broken = np.arange(n), np.zeros(n, bool)
    at, count = (_number(m, rows, np.full(n, k), 2, broken).astype(np.int64) for k in (4, 6))
    whole = (count > 0) & (count - 1 <= width // 512) & (at + 2 * count <= width)
    for s in range(1, width // 512 + 1):
        r = rows[whole & (s < count)]
        for j in (0, 1):
            end = s * 512 - 2 + j
            whole[r] &= m[r, end] == m[r, at[r] + j]
            m[r, end] = m[r, at[r] + 2 * s + j]
    return whole


def decoded(m: np.ndarray, first: int) -> dict[str, pa.Array]:
    """Columns of live base records that have a name; rows of m are records from number first on."""
    n = len(m)
    rows, broken = np.arange(n), np.zeros(n, bool)
    flags = _number(m, rows, np.full(n, 22), 2, broken)
    base = _number(m, rows, np.full(n, 32), 8, broken) & NUMBER
    live = (m[:, :4] == np.frombuffer(b"FILE", np.uint8)).all(1) & (flags & np.uint64(1) > 0) & (base == 0)
    number, flags, m = first + rows[live], flags[live], m[live]
    whole = mended(m) if len(m) else np.zeros(0, bool)
    n = len(m)
    rows, broken = np.arange(n), ~whole
    modified, parent, size = (np.zeros(n, np.uint64) for _ in range(3))
    rank, name_at = np.full(n, 99), np.zeros(n, np.int64)
    at = _number(m, rows, np.full(n, 20), 2, broken).astype(np.int64)
    end = np.minimum(_number(m, rows, np.full(n, 24), 4, broken).astype(np.int64), m.shape[1])
    r = rows[~broken & (at + 16 <= end)]
    while len(r):
        kind, length, apart, name = (_number(m, r, at[r] + k, w, broken) for k, w in ((0, 4), (4, 4), (8, 1), (9, 1)))
        going = (kind != 0xFFFFFFFF) & (length >= 16)
        here = lambda mask: (r[mask], at[r[mask]])  # noqa: B023, E731
        q, p = here(going & (kind == 0x10) & (apart == 0))
        modified[q] = _number(m, q, p + _number(m, q, p + 20, 2, broken).astype(np.int64) + 8, 8, broken)
        q, p = here(going & (kind == 0x30) & (apart == 0))
        p = p + _number(m, q, p + 20, 2, broken).astype(np.int64)
        mine = PREFERENCE[_number(m, q, p + 65, 1, broken).astype(np.int64)]
        q, p, mine = (x[mine < rank[q]] for x in (q, p, mine))
        rank[q], name_at[q] = mine, p
        parent[q] = _number(m, q, p, 8, broken) & NUMBER
        modified[q] = np.where(modified[q] == 0, _number(m, q, p + 16, 8, broken), modified[q])
        q, p = here(going & (kind == 0x80) & (name == 0) & (apart == 0))
        size[q] = _number(m, q, p + 16, 4, broken)
        q, p = here(going & (kind == 0x80) & (name == 0) & (apart != 0))
        q, p = (x[_number(m, q, p + 16, 8, broken) == 0] for x in (q, p))
        size[q] = _number(m, q, p + 48, 8, broken)
        at[r] += length.astype(np.int64)
        r = r[going & ~broken[r] & (at[r] + 16 <= end[r])]
    keep = np.flatnonzero(~broken & (rank < 99))
    named = m[keep]
    letters = named[np.arange(len(keep)), np.minimum(name_at[keep] + 64, m.shape[1] - 1)].astype(np.int64) if len(keep) else np.zeros(0, np.int64)
    names = _texts(named, name_at[keep] + 66, letters)
    # What a long can't hold is damage.
    long = lambda x: pa.array(x[keep].astype(np.int64), pa.int64(), mask=x[keep] >= np.uint64(0x7FFFFFFFFFFFFFFF))
    return {"number": pa.array(number[keep], pa.int64()), "flags": pa.array(flags[keep].astype(np.int32)), "parent": long(parent), "name": pa.array(names, pa.string()), "modified_ft": long(modified), "size": long(size)}


def scan(image, name: str, volume: int, t: Table, first: int, last: int) -> Iterator[pa.RecordBatch]:
    for k in range(first, last, PER_BATCH):
        raw = _read(image, t, k * t.record, min(PER_BATCH, last - k) * t.record)
        whole = len(raw) // t.record
        c = decoded(np.frombuffer(raw, np.uint8)[: whole * t.record].reshape(whole, t.record).copy(), k)
        n = len(c["name"])
        yield pa.record_batch({"image": pa.array([name] * n, pa.string()), "volume": pa.array(np.full(n, volume, np.int32)), **c, "error": pa.nulls(n, pa.string())})
