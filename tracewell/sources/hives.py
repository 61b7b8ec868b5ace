"""Registry hives as rows of keys and values. Transaction logs are not replayed."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

#: Offsets in a hive count from here; "none" among them.
BASE, NONE = 4096, 0xFFFFFFFF
#: Bytes of a segment of large data.
PIECE = 16344


class BadHive(Exception):
    """The bytes are no hive, or one of its cells can't be read."""


def _cell(hive: bytes, at: int, mark: bytes = b"") -> bytes:
    """What a cell holds, which begins with mark: the bytes behind its size. Sizes of cells in use are negative."""
    begin = BASE + at + 4
    size = int.from_bytes(hive[begin - 4 : begin], "little", signed=True) if 0 < at < NONE else 0
    held = hive[begin : begin + max(0, abs(size) - 4)]
    if not size or held[: len(mark)] != mark:
        raise BadHive(f"no {mark!r} at {at}" if mark else f"no cell at {at}")
    return held


def _name(raw: bytes, narrow: int) -> str:
    return raw.decode("latin-1") if narrow else raw.decode("utf-16-le", "replace")


def _children(hive: bytes, at: int, depth: int = 0) -> Iterator[int]:
    """Offsets of the keys in a list; lists of lists are followed through four levels."""
    c = _cell(hive, at)
    width = {b"lf": 2, b"lh": 2, b"li": 1, b"ri": 1}.get(c[:2])
    if width is None:
        return
    n = min(struct.unpack_from("<H", c, 2)[0], (len(c) - 4) // (4 * width))
    for child in struct.unpack_from(f"<{n * width}I", c, 4)[::width]:
        if c[:2] != b"ri":
            yield child
        elif depth < 4:
            yield from _children(hive, child, depth + 1)


def _joined(hive: bytes, head: bytes) -> bytes:
    """Large data: a cell that lists others, each with a piece."""
    count, listed = struct.unpack_from("<HI", head, 2)
    places = struct.unpack(f"<{count}I", _cell(hive, listed)[: 4 * count])
    return b"".join(_cell(hive, p)[:PIECE] for p in places)


def _data(hive: bytes, size: int, at: int) -> bytes:
    """A value's bytes; up to four stand in place of their offset, which the size's highest bit tells."""
    kept = size & 0x7FFFFFFF
    if size != kept:
        return at.to_bytes(4, "little")[:kept]
    held = _cell(hive, at)
    is_list = kept > PIECE and held[:2] == b"db" and int.from_bytes(hive[24:28], "little") >= 4
    return (_joined(hive, held) if is_list else held)[:kept]


def value_columns(kind: int, data: bytes) -> tuple[str | None, Decimal | None, list[str] | None, bytes | None]:
    """The columns s, n, l and b, of which the value's type fills one."""
    text = lambda: data[: len(data) // 2 * 2].decode("utf-16-le", "replace")
    if kind in (1, 2, 6):
        return text().split("\0")[0], None, None, None
    if kind == 7:
        return None, None, [s for s in text().split("\0") if s], None
    number = {4: "<I", 5: ">I", 11: "<Q"}.get(kind)
    if number and len(data) >= struct.calcsize(number):
        return None, Decimal(struct.unpack_from(number, data)[0]), None, None
    return None, None, None, bytes(data)


def rows(hive: bytes) -> Iterator[tuple]:
    """(key_path, written, name, type, s, n, l, b): one row for each key, without a name, and one for each value.

    written is the FILETIME of the key, null if out of range. Keys and values that can't be read are left out, and a
    key that was met before is not entered again.
    """
    if len(hive) < BASE + 32 or hive[:4] != b"regf":
        raise BadHive("no hive")
    (root,) = struct.unpack_from("<I", hive, 36)
    todo, met = [(root, None)], set()
    while todo:
        at, above = todo.pop()
        if at in met:
            continue
        met.add(at)
        try:
            c = _cell(hive, at, b"nk")
            flags, written = struct.unpack_from("<HQ", c, 2)
            n_keys, keys, n_values, values = struct.unpack_from("<I4xI4xII", c, 20)
            (length,) = struct.unpack_from("<H", c, 72)
        except (BadHive, struct.error):
            continue
        name = _name(c[76 : 76 + length], flags & 0x20)
        # The root's own name is no part of a path.
        path = "" if above is None else f"{above}\\{name}" if above else name
        written = written if written < 0x7FFFFFFFFFFFFFFF else None
        yield path, written, None, None, None, None, None, None
        yield from ((path, written, *v) for v in _values(hive, n_values, values))
        if n_keys and keys != NONE:
            try:
                todo += [(k, path) for k in _children(hive, keys)][::-1]
            except (BadHive, struct.error):
                pass


def _values(hive: bytes, count: int, at: int) -> Iterator[tuple]:
    if not count or at == NONE:
        return
    try:
        listed = _cell(hive, at)
    except BadHive:
        return
    for (value,) in struct.iter_unpack("<I", listed[: min(count, len(listed) // 4) * 4]):
        try:
            c = _cell(hive, value, b"vk")
            length, size, where, kind, flags = struct.unpack_from("<HIIIH", c, 2)
            data = _data(hive, size, where)
        except (BadHive, struct.error):
            continue
        yield _name(c[20 : 20 + length], flags & 1), kind, *value_columns(kind, data)
