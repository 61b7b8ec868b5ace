"""Blocks of media (files or devices), read by position and in parallel; sectors that can't be read are zeros and are named."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of the pieces that a failed block is read in, before it is read by sectors; pieces that may fail one after another.
PIECE, GIVE_UP = 64 << 10, 256
#: Bytes of media in a partition of a scan.
PER_PARTITION = 256 << 20


class Unresponsive(OSError):
    """Too many pieces in a row failed: the device has most likely gone."""


def size_of(path: str) -> int:
    """Bytes of a file or a block device."""
    fd = os.open(path, os.O_RDONLY)
    try:
        return os.lseek(fd, 0, os.SEEK_END)
    finally:
        os.close(fd)


def exactly(fd: int, at: int, n: int) -> bytes:
    out = b""
    while len(out) < n:
        more = os.pread(fd, n - len(out), at + len(out))
        if not more:
            raise OSError(f"end of the media at {at + len(out)}")
        out += more
    return out


def reader(fd: int, faults: frozenset[int] = frozenset(), sector: int = 512) -> Callable[[int, int], bytes]:
    """read(at, n) or OSError. faults: sectors that fail, for drills."""

    def read(at: int, n: int) -> bytes:
        if faults and any(s in faults for s in range(at // sector, -(-(at + n) // sector))):
            raise OSError(f"sector can't be read in {n} bytes at {at}")
        return exactly(fd, at, n)

    return read


class Patient:
    """Reads blocks whatever fails in them, and counts failures across blocks."""

    def __init__(self, read: Callable[[int, int], bytes], sector: int = 512) -> None:
        self.read, self.sector, self.failed = read, sector, 0

    def block(self, at: int, n: int) -> tuple[bytes, list[int]]:
        """The bytes, zeros where sectors can't be read, and the numbers of these sectors."""
        try:
            data = self.read(at, n)
            self.failed = 0
            return data, []
        except OSError:
            pass
        out, bad = [], []
        for a in range(at, at + n, PIECE):
            m = min(PIECE, at + n - a)
            try:
                out.append(self.read(a, m))
                self.failed = 0
                continue
            except OSError:
                pass
            some = False
            for s in range(a, a + m, self.sector):
                k = min(self.sector, a + m - s)
                try:
                    out.append(self.read(s, k))
                    some = True
                except OSError:
                    out.append(bytes(k))
                    bad.append(s // self.sector)
            self.failed = 0 if some else self.failed + 1
            if self.failed >= GIVE_UP:
                raise Unresponsive(f"nothing could be read in {self.failed * PIECE >> 20} MiB up to {a + m}")
        return b"".join(out), bad


class _Range(InputPartition):
    def __init__(self, path: str, ranges: list[tuple[int, int]]) -> None:
        self.path, self.ranges = path, ranges


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.block, self.sector = json.loads(options["paths"]), int(options.get("block", 1 << 20)), int(options.get("sector", 512))
        self.faults, self.data = frozenset(json.loads(options.get("faults", "[]"))), options.get("data", "true") == "true"
        self.offsets, self.length = json.loads(options.get("offsets", "null")), int(options.get("length", PIECE))

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            try:
                size = size_of(p)
            except OSError:
                # Reading tells why.
                out.append(_Range(p, [(0, 1)]))
                continue
            if self.offsets is not None:
                some = [(at, min(self.length, size - at)) for at in self.offsets if at < size]
                out += [_Range(p, some[k : k + 256]) for k in range(0, len(some), 256)]
            else:
                step = max(self.block, PER_PARTITION // self.block * self.block)
                out += [_Range(p, [(a, min(step, size - a))]) for a in range(0, size, step)]
        return out or [_Range("", [])]

    def read(self, part: _Range) -> Iterator[tuple]:
        if not part.path:
            return
        try:
            fd = os.open(part.path, os.O_RDONLY)
        except OSError as e:
            yield part.path, None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        patient, step = Patient(reader(fd, self.faults, self.sector), self.sector), self.length if self.offsets is not None else self.block
        try:
            for first, n in part.ranges:
                for at in range(first, first + n, step):
                    began = time.perf_counter()
                    m = min(step, first + n - at)
                    try:
                        data, bad = patient.block(at, m)
                    except Unresponsive as e:
                        yield part.path, at, m, None, None, None, f"{type(e).__name__}: {e}"
                        return
                    yield part.path, at, m, data if self.data else None, bad, time.perf_counter() - began, None
        finally:
            os.close(fd)


class BlockSource(DataSource):
    """format("media"): blocks of media. Options: paths, block (bytes), sector, offsets and length (samples instead of all), data (false: no bytes), faults."""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return "path string, at long, length long, data binary, bad array<long>, seconds double, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
