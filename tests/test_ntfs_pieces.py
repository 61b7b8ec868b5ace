"""Attributes in several records, compressed and encrypted files, and data behind what is initialised; without Spark."""

import struct

import pytest

from tracewell import fixtures
from tracewell.sources import mft, ntfs


def record(*attributes, flags=1):
    body = b"".join(attributes)
    head = bytearray(56)
    struct.pack_into("<HHI", head, 20, 56, flags, 56 + len(body) + 8)
    return bytes(head) + body + b"\xff" * 8


class Held(ntfs.Volume):
    """A volume whose records are given."""

    def __init__(self, disk, records):
        self.image, self.records = type("Disk", (), {"read": staticmethod(lambda at, n: disk[at : at + n])}), records
        self.table = mft.Table(0, 512, 1024, 64, ())

    def record(self, number):
        return self.records.get(number)


DISK = bytes(range(256)) * 40


def listed(kind, ref, name=""):
    label = name.encode("utf-16-le")
    size = -(-(26 + len(label)) // 8) * 8
    return (struct.pack("<IHBBQQH", kind, size, len(name), 26, 0, ref | 5 << 48, 0) + label).ljust(size, b"\0")


def stored(size, runs, first=0, filled=None, flags=0, kind=0x80):
    return fixtures._stored(kind, size, runs, first=first, filled=filled, flags=flags)


def test_data_in_three_records():
    where = fixtures._held(0x20, listed(0x10, 30) + listed(0x80, 32) + listed(0x80, 31) + listed(0x80, 33, "other") + listed(0x80, 30))
    v = Held(DISK, {30: record(where), 31: record(stored(2200, [(1, 3), (1, 7)])), 32: record(stored(0, [(1, None), (2, 1)], first=2)), 33: record(stored(9, [(1, 0)]))})
    want = DISK[3 * 512 : 4 * 512] + DISK[7 * 512 : 8 * 512] + bytes(512) + DISK[512 : 3 * 512]
    assert v.content(30) == want[:2200]


def test_a_list_that_is_stored_apart():
    entries = listed(0x80, 31)
    disk = entries.ljust(512, b"\0") + DISK
    v = Held(disk, {30: record(stored(len(entries), [(1, 0)], kind=0x20)), 31: record(stored(600, [(2, 1)]))})
    assert v.content(30) == DISK[:600]


def test_what_lies_behind_the_initialised_part_is_zeros():
    v = Held(DISK, {30: record(stored(1500, [(3, 2)], filled=700))})
    assert v.content(30) == DISK[1024 : 1024 + 700] + bytes(800)


@pytest.mark.parametrize(("attribute", "why"), [(stored(600, [(2, 1)], flags=1), "compressed"), (stored(600, [(2, 1)], flags=0x4000), "EFS"), (stored(1 << 40, [(2, 1)]), "too many"), (b"", "no data")])
def test_files_that_are_refused(attribute, why):
    with pytest.raises(ntfs.BadFile, match=why):
        Held(DISK, {30: record(attribute)}).content(30)


def test_names_in_an_index():
    def entry(number, name, space, flags=0):
        raw = fixtures._file_name(5, name, 1, 0, False, space)
        size = -(-(16 + len(raw)) // 8) * 8
        return (struct.pack("<QHHI", number, size, len(raw), flags) + raw).ljust(size, b"\0")

    inside = entry(40, "Long Name.txt", 1) + entry(40, "LONGNA~1", 2) + entry(41, "b", 0) + struct.pack("<QHHI", 0, 16, 0, 2) + entry(42, "after the end", 1)
    root = struct.pack("<IIIBxxx", 0x30, 1, 4096, 1) + struct.pack("<IIII", 16, 16 + len(inside), 16 + len(inside), 0) + inside
    v = Held(DISK, {5: record(fixtures._held(0x90, root, "$I30"), flags=3), 40: record(fixtures._held(0x80, b"held")), 41: record(flags=1)})
    assert list(v.entries(5)) == [("Long Name.txt", 40), ("b", 41)]
    assert v.find("/LONG name.TXT") == 40 and v.file("\\long name.txt") == b"held" and v.find("nothing") is None and v.find("b\\c") is None
