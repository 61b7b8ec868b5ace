"""The file table's scan on a volume built here, in two runs."""

import os
import struct

import pytest
from pyspark.sql import SparkSession

from tracewell.plans import evidence
from tracewell.sources import mft


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def resident(kind, content, name=0):
    body = struct.pack("<IIBBHHHIHH", kind, 24 + len(content) + -len(content) % 8, 0, name, 24, 0, 0, len(content), 24, 0) + content
    return body + bytes(-len(content) % 8)


def apart(size, listed, start=0, name=0):
    listed += bytes(-len(listed) % 8)
    return struct.pack("<IIBBHHHQQHHIQQQ", 0x80, 64 + len(listed), 1, name, 64, 0, 0, start, 0, 64, 0, 0, size, size, size) + listed


def named(name, parent=5, space=1, modified=50):
    return resident(0x30, struct.pack("<QQQQQQQII", parent | 7 << 48, 0, modified, 0, 0, 0, 0, 0, 0) + bytes([len(name), space]) + name.encode("utf-16-le"))


def info(modified):
    return resident(0x10, struct.pack("<QQ", 0, modified) + bytes(32))


def record(*attributes, flags=1, base=0, magic=b"FILE", torn=False):
    body = b"".join(attributes) + b"\xff" * 8
    r = bytearray((magic + struct.pack("<HH12xHHIIQ", 48, 3, 56, flags, 56 + len(body), 1024, base)).ljust(56, b"\0") + body)
    r = r.ljust(1024, b"\0")
    r[48:54] = b"\x01\x02" + r[510:512] + r[1022:1024]
    r[510:512] = r[1022:1024] = b"\x01\x02"
    if torn:
        r[1022] ^= 1
    return bytes(r)


def volume():
    listed = bytes([0x11, 4, 10, 0x11, 3, 10, 0])
    return [
        record(info(9), named("$MFT"), apart(14 * 1024, listed)),
        record(info(100), named("LONGNA~1", space=2), named("long name", parent=7), resident(0x80, b"x" * 30)),
        record(named("no info", modified=77), apart(5000, b"\0"), apart(9, b"\0", start=3)),
        record(info(1), named("free"), flags=0),
        record(info(1), named("extension"), base=4),
        record(info(1), named("torn"), torn=True),
        record(info(1), named("bad"), magic=b"BAAD"),
        record(info(1)),
        record(info(1 << 63), named("late", space=0), resident(0x80, b"stream", name=1), flags=3),
        record(info(3), struct.pack("<IIBBHHHIHH", 0x30, 24, 0, 0, 24, 0, 0, 0, 2000, 0), named("cut")),
        record(info(2), named("n" * 200), named("é", space=0), named("8.3", space=2)),
    ]


def test_runs():
    assert list(mft.runs(bytes([0x11, 4, 10, 0x01, 2, 0x11, 3, 0xFE, 0, 0x11]))) == [(4, 10), (2, None), (3, 8)]


def test_scan(spark, tmp_path, monkeypatch):
    records = b"".join(volume())
    disk = bytearray(2048 * 40)
    disk[3:11] = b"NTFS    "
    disk[510:512] = b"\x55\xaa"
    struct.pack_into("<HB", disk, 11, 512, 4)
    struct.pack_into("<QQ", disk, 40, 160, 10)
    struct.pack_into("<b", disk, 64, -10)
    disk[20480 : 20480 + 8192] = records[:8192]
    disk[40960 : 40960 + len(records) - 8192] = records[8192:]
    good, bad = f"{tmp_path}/a.dd", f"{tmp_path}/b.dd"
    for p, b in ((good, disk), (bad, disk[:20480])):
        with open(p, "wb") as f:
            f.write(b)
    rows = evidence.relation(spark, "mft", [good, bad, f"{tmp_path}/none"]).collect()
    got = [(r.number, r.flags, r.parent, r.name, r.modified_ft, r.size) for r in rows if not r.error]
    assert got == [
        (0, 1, 5, "$MFT", 9, 14 * 1024),
        (1, 1, 7, "long name", 100, 30),
        (2, 1, 5, "no info", 77, 5000),
        (8, 3, 5, "late", None, 0),
        (10, 1, 5, "n" * 200, 2, 0),
    ]
    assert sorted((os.path.basename(r.image), r.error.split(":")[0]) for r in rows if r.error) == [("b.dd", "BadVolume"), ("none", "FileNotFoundError")]
    image = evidence.images.open_image(good)
    t = mft.table(image, 0)
    monkeypatch.setattr(mft, "PER_BATCH", 3)
    assert [n for b in mft.scan(image, good, 1, t, 0, t.count) for n in b.column("number").to_pylist()] == [0, 1, 2, 8, 10]


def test_file_paths(spark):
    rows = [(5, 3, 5, "."), (6, 3, 5, "Users"), (7, 3, 6, "alice"), (8, 1, 7, "a.txt"), (9, 1, 5, "b"), (10, 1, 99, "orphan"), (11, 3, 12, "x"), (12, 3, 11, "y"), (13, 1, 11, "in a cycle")]
    table = spark.createDataFrame([("i", 1, *r, 0, 0, None) for r in rows], mft.COLUMNS)
    got = {r.number: r.path for r in evidence.file_paths(table).collect()}
    assert got == {8: "\\Users\\alice\\a.txt", 9: "\\b"}
