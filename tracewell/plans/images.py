"""Queries over an image built on the spot, with SQL that lists the rows known beforehand: the sources and triage as a whole."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..operators.paths import shared_folder
from . import capture, evidence, triage, windows

_Q: dict = {}
_SQL: dict[str, str] = {}
_BUILT: dict[str, str] = {}


def built(spark: SparkSession) -> str:
    """The fixture's disk, in the folder that driver and executors share; it is built once in a session."""
    at = shared_folder(spark)
    if at not in _BUILT:
        folder = at.removeprefix("file://").removeprefix("file:")
        if not folder.startswith("/"):
            raise ValueError("images must be files that executors can open")
        os.makedirs(f"{folder}/tracewell", exist_ok=True)
        path = f"{folder}/tracewell/fixture-{os.getpid()}.dd"
        with open(path, "wb") as f:
            f.write(fixtures.disk())
        _BUILT[at] = path
    return _BUILT[at]


_TRIAGE: dict[str, triage.Triage] = {}


def examined(spark: SparkSession) -> triage.Triage:
    path = built(spark)
    if path not in _TRIAGE:
        _TRIAGE[path] = triage.run(spark, [path])
    return _TRIAGE[path]


def _query(sql: str):
    def add(f):
        _Q[f.__name__] = lambda spark, sf_dir: f(spark)
        _SQL[f.__name__] = sql
        return f

    return add


def _values(names: str, *rows: tuple) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


_MIB = 1 << 20


@_query(_values('"index", scheme, "offset", size, type, name, fs', (1, "GPT", _MIB, 6 * _MIB, "Basic data", "Basic data partition", "NTFS"), (2, "GPT", 7 * _MIB, 2 * _MIB, "Linux filesystem", "linux", "ext4"), (3, "GPT", 9 * _MIB, _MIB, "Basic data", "Data", "BitLocker")))
def image_volumes(spark) -> DataFrame:
    return evidence.volumes(spark, [built(spark)]).select("index", "scheme", "offset", "size", "type", "name", "fs")


@_query(_values("format, size, bytes_per_sector, segments, acquisition_errors", ("raw", 11 * _MIB, 512, 1, 0)))
def image_info(spark) -> DataFrame:
    return evidence.relation(spark, "info", [built(spark)]).select("format", "size", "bytes_per_sector", F.size("segments").alias("segments"), "acquisition_errors")


@_query(_values("volume, name, edition, version, build, kernel_version, installed, registered_owner, architecture", (1, "Windows 11 Pro", "Professional", "23H2", "22631.3880", "6.3", "2023-11-14 22:13:20 UTC", "alice", "AMD64")))
def windows_os(spark) -> DataFrame:
    return windows.os(windows.current(evidence.relation(spark, "hives", [built(spark)]))).select("volume", "name", "edition", "version", "build", "kernel_version", "installed", "registered_owner", "architecture")


@_query(_values("volume, computer_name, domain, ips, time_zone, utc_offset, last_shutdown, manufacturer, model, bios", (1, "DESKTOP-TRIAGE", "corp.local", "192.168.1.50,10.0.0.5", "GMT Standard Time", "UTC+01:00", "2025-02-19 21:21:40 UTC", "Dell Inc.", "Latitude 7420", "1.31.0")))
def windows_device(spark) -> DataFrame:
    d = windows.device(windows.current(evidence.relation(spark, "hives", [built(spark)])))
    return d.select("volume", "computer_name", "domain", F.array_join("ip_addresses", ",").alias("ips"), "time_zone", "utc_offset", "last_shutdown", "manufacturer", "model", "bios")


@_query(_values(
    "username, sid, rid, account, profile, full_name, comment, last_logon, last_failed_logon, logon_count, disabled, recent_doc",
    ("carol", "S-1-12-1-444-555-666-777", None, "Microsoft Entra ID", "C:\\Users\\carol", None, None, None, None, None, None, None),
    ("alice", "S-1-5-21-111-222-333-1001", 1001, "local", "C:\\Users\\alice", "Alice Archer", None, "2024-12-24 00:27:40 UTC", "2024-12-24 00:26:40 UTC", 42, False, "notes.txt"),
    ("bob", "S-1-5-21-111-222-333-1002", 1002, "local", "C:\\Users\\bob", None, None, "2025-01-04 14:12:20 UTC", None, 7, False, None),
    ("Administrator", None, 500, "local", None, None, "Built-in account", None, None, 0, True, None),
))
def windows_users(spark) -> DataFrame:
    people = windows.users(evidence.relation(spark, "hives", [built(spark)]))
    return people.select("username", "sid", "rid", "account", "profile", "full_name", "comment", "last_logon", "last_failed_logon", "logon_count", "disabled", F.col("recent_doc.name").alias("recent_doc"))


@_query(_values(
    '"rank", path, "user", modified, size',
    (1, "\\Users\\bob\\Pictures\\photo.jpg", "bob", "2025-01-04 14:13:20 UTC", 4000), (2, "\\Users\\alice\\Desktop\\notes.txt", "alice", "2024-12-24 00:26:40 UTC", 5),
    (3, "\\Users\\bob\\Documents\\archive\\file0000.txt", "bob", "2024-10-27 03:33:20 UTC", 1), (4, "\\Users\\alice\\Documents\\report.docx", "alice", "2024-10-27 03:33:20 UTC", 1800),
    (5, "\\Users\\bob\\Documents\\archive\\file0001.txt", "bob", "2024-10-27 03:33:19 UTC", 1), (6, "\\Users\\bob\\Documents\\archive\\file0002.txt", "bob", "2024-10-27 03:33:18 UTC", 1),
))
def windows_recent(spark) -> DataFrame:
    return examined(spark).recent.where("volume = 1").select("rank", "path", "user", "modified", "size")


@_query(_values("name, version, id, codename, kernels", ("Ubuntu 24.04.1 LTS", "24.04", "ubuntu", "noble", "6.8.0-45-generic")))
def linux_os(spark) -> DataFrame:
    s = examined(spark).systems.where("kind = 'linux'")
    return s.select("os.name", "os.version", "os.id", "os.codename", F.array_join("os.kernel_versions", ",").alias("kernels"))


@_query(_values("computer_name, time_zone, last_mounted_at, last_mounted, last_written", ("ubuntu-box", "Europe/London", "/", "2025-01-16 04:00:10 UTC", "2025-01-16 04:00:20 UTC")))
def linux_device(spark) -> DataFrame:
    s = examined(spark).systems.where("kind = 'linux'")
    return s.select("device.computer_name", "device.time_zone", "device.last_mounted_at", "device.last_mounted", "device.last_written")


@_query(_values("username, uid, full_name, profile, shell, last_logon, disabled, last_saved", ("root", 0, "root", "/root", "/bin/bash", None, False, None), ("dave", 1000, "Dave Diaz", "/home/dave", "/bin/bash", "2025-01-16 03:00:00 UTC", False, "/home/dave/projects/plan.md")))
def linux_users(spark) -> DataFrame:
    return examined(spark).users.where("uid IS NOT NULL").select("username", "uid", "full_name", "profile", "shell", "last_logon", "disabled", F.col("last_saved.path").alias("last_saved"))


@_query(_values('"rank", path, "user", modified, size', (1, "/home/dave/projects/plan.md", "dave", "2025-01-16 04:00:00 UTC", 4500), (2, "/home/dave/old.txt", "dave", "2024-10-27 03:33:20 UTC", 3)))
def linux_recent(spark) -> DataFrame:
    return examined(spark).recent.where("volume = 2").select("rank", "path", "user", "modified", "size")


@_query(_values("seq, level, title, detail", (0, "bad", "Encrypted volume (BitLocker)", "Partition 3 (1.0 MB) can't be read without its key")))
def triage_findings(spark) -> DataFrame:
    return examined(spark).findings.select("seq", "level", "title", "detail")


@_query(_values(
    "os, version, device, users, names, last_saved",
    ("Windows 11 Pro", "23H2 (build 22631.3880)", "DESKTOP-TRIAGE", 4, "carol, alice, bob, Administrator", "\\Users\\bob\\Pictures\\photo.jpg"), ("Ubuntu 24.04.1 LTS", "24.04", "ubuntu-box", 2, "root, dave", "/home/dave/projects/plan.md"),
))
def triage_fixture(spark) -> DataFrame:
    return triage.summary(examined(spark)).select("os", "version", "device", "users", "names", "last_saved")


def _folders(held: dict) -> int:
    """Folders above the files, the root among them."""
    return len({"/".join(p.split("/")[:k]) for p in held for k in range(len(p.split("/")))})


_NTFS, _EXT = fixtures.windows_files(), fixtures.linux_files()


@_query(_values("flags, files, bytes", (1, len(_NTFS), sum(len(d) for _, d in _NTFS.values())), (3, _folders(_NTFS), 0)))
def mft_fixture(spark) -> DataFrame:
    rows = evidence.large(spark, "mft", [built(spark)]).where("number >= 24 AND error IS NULL OR number = 5")
    return rows.groupBy("flags").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


@_query(_values("folder, name, ftype", ("/boot", "initrd.img", 1), ("/boot", "vmlinuz-6.8.0-45-generic", 1), ("/etc", "hostname", 1), ("/etc", "localtime", 7), ("/etc", "os-release", 7), ("/etc", "passwd", 1)))
def ext_entries(spark) -> DataFrame:
    from . import linux

    entries = evidence.large(spark, "entries", [built(spark)])
    at = linux.folders(entries).withColumnsRenamed({"number": "parent", "path": "folder"})
    return entries.join(at, ["image", "volume", "parent"]).where("folder IN ('/boot', '/etc')").select("folder", "name", "ftype")


_LINKS = [d for _, d in _EXT.values() if isinstance(d, str)]
_FILES = [d for _, d in _EXT.values() if isinstance(d, bytes)]


@_query(_values("mode, inodes, bytes", (0x41ED, _folders(_EXT), 1024 * _folders(_EXT)), (0x81A4, len(_FILES), sum(map(len, _FILES))), (0xA1FF, len(_LINKS), sum(map(len, _LINKS)))))
def ext_inodes(spark) -> DataFrame:
    rows = evidence.large(spark, "inodes", [built(spark)]).where("error IS NULL")
    return rows.groupBy("mode").agg(F.count("*").alias("inodes"), F.sum("size").cast("long").alias("bytes"))


_ACQUIRED: dict[str, dict] = {}
_DISK = fixtures.disk()


def acquired(spark: SparkSession) -> dict:
    """An EWF image of the fixture's disk, in segments, of which two ranges of sectors couldn't be read."""
    path = built(spark)
    if path not in _ACQUIRED:
        folder = os.path.join(os.path.dirname(path), f"acquired-{uuid.uuid4().hex[:8]}")
        os.makedirs(folder)
        job = {"source": path, "folder": folder, "name": "image", "segment_size": 600_000, "case": {"case_number": "C-1"}}
        (_ACQUIRED[path],) = capture.acquire(spark, [job], capture.HASHES, verify=True, faults=[20000, 20001, 20500])
    return _ACQUIRED[path]


def _with_zeros() -> bytes:
    out = bytearray(_DISK)
    for first, n in ((20000, 2), (20500, 1)):
        out[first * 512 : (first + n) * 512] = bytes(n * 512)
    return bytes(out)


@_query(_values("algorithm, recorded, match", *((a, hashlib.new(a, _with_zeros()).hexdigest(), True) for a in capture.HASHES)))
def capture_hashes(spark) -> DataFrame:
    r = acquired(spark)
    return capture.verified(spark, [(r["paths"][0], r["total_bytes"], r["hashes"])]).select("algorithm", "recorded", "match")


@_query(_values("\"first\", sectors", (20000, 2), (20500, 1)))
def capture_bad_ranges(spark) -> DataFrame:
    return spark.createDataFrame(acquired(spark)["bad_ranges"], "first long, sectors long")


@_query(_values("size, acquisition_errors, case_number, md5, chunk_size", (len(_DISK), 2, "C-1", hashlib.md5(_with_zeros()).hexdigest(), 32768)))
def capture_image(spark) -> DataFrame:
    info = evidence.relation(spark, "info", [acquired(spark)["paths"][0]])
    return info.select("size", "acquisition_errors", F.col("header.case_number").alias("case_number"), "md5", "chunk_size")


@_query(_values("chunks, bytes, damaged, checked", (len(_DISK) // 32768, len(_DISK), 0, True)))
def ewf_sections_fixture(spark) -> DataFrame:
    first = acquired(spark)["paths"][0]
    rows = evidence.chunks(spark, [first])
    checked = evidence.relation(spark, "sections", [first]).agg(F.bool_and("checked").alias("checked"))
    damaged = evidence.damage(rows).agg(F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("damaged"))
    return rows.agg(F.count("*").alias("chunks"), F.sum("media_length").cast("long").alias("bytes")).join(damaged).join(checked)


@_query(_values("seq, level, title, detail", (0, "ok", "SMART healthy", "No reallocated, pending or uncorrectable sectors reported"), (1, "bad", "Unreadable sectors found", "3 bad sector(s), first at LBA 20000")))
def capture_scan(spark) -> DataFrame:
    r = capture.scan(spark, built(spark), "full", fixtures.smart_document(), faults=[20000, 20001, 20500])
    return spark.createDataFrame([(k, f["level"], f["title"], f["detail"]) for k, f in enumerate(r["findings"])], "seq long, level string, title string, detail string")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["built", "examined", "oracle_sql", "queries"]
