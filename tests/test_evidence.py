"""The evidence source on images built here: EWF, raw, partition tables, hives, login records."""

import hashlib
import os
import random
import struct
import uuid
import zlib

import pytest
from pyspark.sql import SparkSession

from tracewell.plans import evidence
from tracewell.sources import hives, images


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def section(kind, at, data, last=False):
    head = struct.pack("<16sQQ40x", kind, at if last else at + 76 + len(data), 76 + len(data))
    return head + struct.pack("<I", zlib.adler32(head)) + data


def ewf(path, media, per_segment=5, chunk=4096):
    """Writes media as an EWF set: odd chunks packed, even ones not."""
    pieces = [media[k : k + chunk] for k in range(0, len(media), chunk)]
    groups = [pieces[k : k + per_segment] for k in range(0, len(pieces), per_segment)]
    stem, n = os.path.splitext(path)[0], 0
    for g, group in enumerate(groups):
        out = images.EWF_MAGIC + b"\x01" + struct.pack("<HH", g + 1, 0)
        if not g:
            text = "3\nmain\nc\tn\te\tm\nC-1\t7\tHS\t1700000000\n\n"
            out += section(b"header2", len(out), zlib.compress(text.encode("utf-16")))
            out += section(b"volume", len(out), struct.pack("<IIIIQ", 1, len(pieces), chunk // 512, 512, len(media) // 512).ljust(1052, b"\0"))
        at, stored, entries = len(out) + 76, b"", []
        for p in group:
            entries.append(len(stored) | (n % 2 << 31))
            stored += zlib.compress(p) if n % 2 else p + struct.pack("<I", zlib.adler32(p))
            n += 1
        out += section(b"sectors", len(out), stored)
        table = struct.pack("<I4xQ8x", len(entries), at) + struct.pack(f"<{len(entries)}I", *entries)
        out += section(b"table", len(out), table + struct.pack("<I", 0))
        if g + 1 == len(groups):
            out += section(b"digest", len(out), hashlib.md5(media).digest() + hashlib.sha1(media).digest() + bytes(44))
        out += section(b"done" if g + 1 == len(groups) else b"next", len(out), b"", True)
        with open(f"{stem}.{images.extension(g + 1)}", "wb") as f:
            f.write(out)
    return path


def media(n=23 * 4096 + 1024):
    return random.Random(5).randbytes(n)


def test_extensions():
    assert [images.extension(n) for n in (1, 99, 100, 125, 126, 775, 776)] == ["E01", "E99", "EAA", "EAZ", "EBA", "EZZ", "FAA"]
    assert images.extension(99 + 22 * 676) == "ZZZ"
    for n in (0, 100 + 22 * 676):
        with pytest.raises(ValueError):
            images.extension(n)


def test_ewf_round_trip(spark, tmp_path):
    data = media()
    path = ewf(f"{tmp_path}/a.E01", data)
    image = images.open_image(path)
    assert image.size == len(data) and image.read(0, len(data)) == data
    for at, n in ((0, 1), (4095, 2), (4096 * 5 - 1, 9000), (len(data) - 3, 100), (len(data), 5)):
        assert image.read(at, n) == data[at : at + n]
    info = evidence.relation(spark, "info", [path]).first()
    assert (info.format, len(info.segments), info.size, info.chunk_size) == ("E01", 5, len(data), 4096)
    assert info.header == {"case_number": "C-1", "evidence_number": "7", "examiner": "HS", "acquired": "2023-11-14 22:13:20 UTC"}
    assert (info.md5, info.sha1) == (hashlib.md5(data).hexdigest(), hashlib.sha1(data).hexdigest())
    rows = evidence.decoded(evidence.chunks(spark, [path])).orderBy("chunk").collect()
    assert b"".join(r.data for r in rows) == data and [r.media_offset for r in rows] == list(range(0, len(data), 4096))
    assert not [r for r in rows if r.damage]
    kinds = [r.kind for r in evidence.relation(spark, "sections", [path]).orderBy("segment", "seq").collect()]
    assert kinds[:5] == ["header2", "volume", "sectors", "table", "next"] and kinds[-2:] == ["digest", "done"]


def test_damaged_and_missing_images_are_rows(spark, tmp_path):
    data = media()
    path = ewf(f"{tmp_path}/a.E01", data)
    rows = evidence.chunks(spark, [path]).orderBy("chunk").collect()
    for r in rows[2:4]:
        with open(r.path, "r+b") as f:
            f.seek(r.file_offset)
            f.write(b"\xff" * 8)
    hit = {(r.damage, r.chunks, r.first_chunk) for r in evidence.damage(evidence.chunks(spark, [path])).collect()}
    assert hit == {("checksum", 1, 2), ("missing", 1, 3)}
    image = images.open_image(path)
    assert image.read(3 * 4096, 4096) == bytes(4096)
    bad = f"{tmp_path}/b.E01"
    with open(bad, "wb") as f:
        f.write(b"x" * 600)
    got = {os.path.basename(r.image): r.error for r in evidence.volumes(spark, [path, bad, f"{tmp_path}/none.dd"]).collect()}
    assert got["a.E01"] is None and "BadImage" in got["b.E01"] and "FileNotFoundError" in got["none.dd"]


def test_split_raw(tmp_path):
    data = media(10_000)
    for k in range(4):
        with open(f"{tmp_path}/r.{k + 1:03d}", "wb") as f:
            f.write(data[k * 3000 : (k + 1) * 3000])
    image = images.open_image(f"{tmp_path}/r.001")
    assert image.size == 10_000 and image.read(2990, 4000) == data[2990:6990] and image.read(9_999, 9) == data[-1:]
    assert images.open_image(f"{tmp_path}/r.002").size == 3000


def test_partition_tables(spark, tmp_path):
    gpt = bytearray(2048 * 512)
    gpt[512:520] = b"EFI PART"
    struct.pack_into("<QII", gpt, 512 + 72, 2, 128, 128)
    for slot, kind, first, last in ((0, "ebd0a0a2-b9e5-4433-87c0-68b6b72699c7", 100, 299), (2, "00000000-0000-0000-0000-000000000001", 300, 9999)):
        e = uuid.UUID(kind).bytes_le + bytes(16) + struct.pack("<QQQ", first, last, 0) + "Data".encode("utf-16-le").ljust(72, b"\0")
        gpt[1024 + 128 * slot : 1024 + 128 * (slot + 1)] = e
    gpt[100 * 512 + 3 : 100 * 512 + 11] = b"-FVE-FS-"
    gpt[300 * 512 + 1080 : 300 * 512 + 1082] = b"\x53\xef"
    gpt[300 * 512 + 1024 + 92] = 4
    mbr = bytearray(600 * 512)
    mbr[510:512] = b"\x55\xaa"
    struct.pack_into("<B3xB3xII", mbr, 446, 0x80, 0x07, 10, 20)
    struct.pack_into("<B3xB3xII", mbr, 462, 0, 0x05, 100, 400)
    for here, link in ((100, 50), (150, 0)):
        struct.pack_into("<B3xB3xII", mbr, here * 512 + 446, 0, 0x83, 2, 10)
        struct.pack_into("<B3xB3xII", mbr, here * 512 + 462, 0, 0x05, link, 40)
        mbr[here * 512 + 510 : here * 512 + 512] = b"\x55\xaa"
    mbr[10 * 512 + 3 : 10 * 512 + 11] = b"NTFS    "
    paths = [f"{tmp_path}/{n}.dd" for n in ("gpt", "mbr", "plain", "empty")]
    for p, b in zip(paths, (gpt, mbr, bytes(512) + b"LABELONE" + bytes(4096), b""), strict=True):
        with open(p, "wb") as f:
            f.write(b)
    got = [(os.path.basename(r.image), r.scheme, r["index"], r.kind, r.offset // 512, r.size // 512, r.type, r.fs, r.bootable) for r in evidence.volumes(spark, paths).orderBy("image", "index").collect()]
    assert got == [
        ("empty.dd", "none", 1, "none", 0, 0, "Whole image", "unknown", None),
        ("gpt.dd", "GPT", 1, "GPT", 100, 200, "Basic data", "BitLocker", None),
        ("gpt.dd", "GPT", 2, "GPT", 300, 1748, "00000000-0000-0000-0000-000000000001", "ext3", None),
        ("mbr.dd", "MBR", 1, "MBR", 10, 20, "NTFS / exFAT", "NTFS", True),
        ("mbr.dd", "MBR", 2, "MBR (logical)", 102, 10, "Linux", "unknown", None),
        ("mbr.dd", "MBR", 3, "MBR (logical)", 152, 10, "Linux", "unknown", None),
        ("plain.dd", "none", 1, "none", 0, 9, "Whole image", "LVM", None),
    ]


def hive():
    """Root with the key A, which has four values and links back to the root."""
    cells = bytearray(32)

    def cell(data):
        at = len(cells)
        cells.extend(struct.pack("<i", -(4 + len(data))) + data)
        cells.extend(bytes(-len(cells) % 8))
        return at

    def value(name, kind, data):
        size, at = (len(data) | 1 << 31, struct.unpack("<I", data.ljust(4, b"\0"))[0]) if len(data) <= 4 else (len(data), cell(data))
        return cell(b"vk" + struct.pack("<HIIIHH", len(name), size, at, kind, 1, 0) + name)

    def key(name, keys, values, root=False):
        listed = cell(struct.pack(f"<{len(values)}I", *values)) if values else hives.NONE
        below = cell(b"lf" + struct.pack("<H", len(keys)) + b"".join(struct.pack("<I4x", k) for k in keys)) if keys else hives.NONE
        body = struct.pack("<HQ4xIIIIIII", 0x2C if root else 0x20, 133_000_000_000_000_000, 0, len(keys), 0, below, hives.NONE, len(values), listed)
        return cell((b"nk" + body).ljust(72, b"\0") + struct.pack("<HH", len(name), 0) + name)

    pieces = [cell(b"z" * hives.PIECE), cell(b"y" * 10)]
    big = cell(b"db" + struct.pack("<HI", 2, cell(struct.pack("<2I", *pieces))))
    large = cell(b"vk" + struct.pack("<HIIIHH", 3, hives.PIECE + 10, big, 3, 1, 0) + b"big")
    vals = [value(b"s", 1, ("x" * 40 + "\0").encode("utf-16-le")), value(b"d", 4, struct.pack("<I", 7)), value(b"m", 7, "p\0q\0\0".encode("utf-16-le")), large, 4 << 20]
    root = key(b"ROOT", [key(b"A", [], vals), 1 << 24], [], True)
    head = bytearray(4096)
    head[:4] = b"regf"
    struct.pack_into("<I", head, 24, 5)
    struct.pack_into("<I", head, 36, root)
    return bytes(head + cells)


def test_registry(spark, tmp_path):
    path, other = f"{tmp_path}/HIVE", f"{tmp_path}/none"
    for p, b in ((path, hive()), (other, b"regf")):
        with open(p, "wb") as f:
            f.write(b)
    rows = evidence.relation(spark, "registry", [path, other])
    assert [r.error for r in rows.where("error IS NOT NULL").collect()] == ["BadHive: no hive"]
    got = {r.name: r for r in rows.where("name IS NOT NULL").collect()}
    assert set(got) == {"s", "d", "m", "big"} and got["s"].s == "x" * 40 and got["d"].n == 7 and got["m"].l == ["p", "q"]
    assert bytes(got["big"].b) == b"z" * hives.PIECE + b"y" * 10
    assert [r.key_path for r in rows.where("name IS NULL AND error IS NULL").collect()] == ["", "A"]
    assert evidence.registry_value(rows, "a", "D").first().n == 7


def test_logins(spark, tmp_path):
    record = lambda kind, user, sec: struct.pack("<h42x32s264xi40x", kind, user, sec)
    path = f"{tmp_path}/wtmp"
    with open(path, "wb") as f:
        f.write(b"cut off" + record(7, b"dave", 100) + record(2, b"reboot", 300) + record(7, b"dave", 200) + record(7, b"", 9))
    assert [(r.user, r.sec) for r in evidence.last_logins(spark, [path]).collect()] == [("dave", 200)]
