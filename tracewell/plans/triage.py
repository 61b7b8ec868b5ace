"""Triage of many images in one plan: volumes, systems, users, newest files, findings, and a document for each image.

An image or volume that can't be read is a finding and never ends the job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators.paths import cut
from . import evidence, linux, windows

#: File systems that triage reads, that need a key, and that it doesn't read.
READ, LOCKED, UNREAD = ["NTFS", "ext2", "ext3", "ext4"], ["BitLocker", "LUKS"], ["APFS", "HFS+", "XFS", "Btrfs", "ReFS", "LVM"]
_USER = ["sid", "rid", "uid", "username", "account", "profile", "full_name", "comment", "shell", "last_logon", "password_set", "last_failed_logon", "logon_count", "failed_logons", "disabled", "profile_loaded", "recent_doc", "last_saved"]


@dataclass
class Triage:
    """Relations of a triage, written once: each has image, and all but info and findings have volume."""

    info: DataFrame
    volumes: DataFrame
    systems: DataFrame
    users: DataFrame
    recent: DataFrame
    findings: DataFrame


def _finding(level: str, title: Column | str, detail: Column | str) -> list[Column]:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.lit(level).alias("level"), as_column(title).alias("title"), as_column(detail).alias("detail")]


def findings(info: DataFrame, volumes: DataFrame, failed: DataFrame, systems: DataFrame, notes: DataFrame, damaged: DataFrame) -> DataFrame:
    """All findings in their fixed order: image, seq, level, title, detail."""
    size = scalars.size_text(F.col("size"), 1000, 1)
    part = F.concat(F.lit("Partition "), F.col("index").cast("string"))
    lost = info.where("error IS NOT NULL").select("image", F.lit(0).alias("index"), *_finding("bad", "Image couldn't be read", F.col("error")))
    errors = info.where("acquisition_errors > 0").select("image", F.lit(0).alias("index"), *_finding("bad", "Acquisition errors recorded", F.concat(F.col("acquisition_errors").cast("string"), F.lit(" unreadable range(s) were zero-filled when this image was made"))))
    broken = failed.select("image", F.col("volume").alias("index"), *_finding("bad", F.concat(F.lit("Partition "), F.col("volume").cast("string"), F.lit(" couldn't be read")), F.col("error")))
    locked = volumes.where(F.col("fs").isin(*LOCKED)).select("image", "index", *_finding("bad", F.concat(F.lit("Encrypted volume ("), "fs", F.lit(")")), F.concat(part, F.lit(" ("), size, F.lit(") can't be read without its key"))))
    unread = volumes.where(F.col("fs").isin(*UNREAD)).select("image", "index", *_finding("info", F.concat("fs", F.lit(" not examined")), F.concat(part, F.lit(" uses "), "fs", F.lit(", which triage can't read yet"))))
    empty = info.where("error IS NULL").join(systems.select("image").distinct(), "image", "left_anti").select("image", F.lit(0).alias("index"), *_finding("info", "No operating system found", "No Windows (NTFS) or Linux (ext) system volume was found in this image"))
    noted = notes.select("image", F.col("volume").alias("index"), "level", "title", "detail")
    bad = damaged.groupBy("image").agg(F.sum("chunks").alias("n")).select("image", F.lit(0).alias("index"), *_finding("bad", "Damaged chunks", F.concat(F.col("n").cast("string"), F.lit(" chunk(s) couldn't be decompressed and were read as zeros"))))
    # Encrypted and unread volumes are told in the order of volumes.
    parts, out = [lost, errors, broken, locked.unionByName(unread), empty, noted, bad], None
    for k, p in enumerate(parts):
        p = p.withColumn("kind", F.lit(k))
        out = p if out is None else out.unionByName(p)
    from pyspark.sql import Window

    order = Window.partitionBy("image").orderBy("kind", "index", "title", "detail")
    return out.withColumn("seq", F.row_number().over(order) - 1).select("image", "seq", "level", "title", "detail")


def run(spark: SparkSession, paths: Sequence[str], budget: int | None = None, chunks: bool = False) -> Triage:
    """Opens every image once a relation. chunks: decode all stored chunks as well, to count the damaged ones."""
    known = evidence.ranges(spark, paths)
    keep = lambda df, name: cut(df, f"triage-{name}")
    info = keep(evidence.relation(spark, "info", paths), "info")
    volumes = keep(evidence.volumes(spark, paths).where("error IS NULL"), "volumes")
    hives, ext_info = (keep(evidence.relation(spark, r, paths), r) for r in ("hives", "ext_info"))
    texts, logins = (evidence.relation(spark, r, paths) for r in ("linux_texts", "linux_logins"))
    texts = keep(texts, "texts")
    mft = keep(evidence.large(spark, "mft", paths, known), "mft")
    entries, inodes = (keep(evidence.large(spark, r, paths, known), r) for r in ("entries", "inodes"))
    windows_at, linux_at = windows.systems(hives), ext_info.where("linux AND error IS NULL").select("image", "volume")
    current = windows.current(hives)
    people_w, people_l = keep(windows.users(hives), "users-w"), keep(linux.users(texts, logins), "users-l")
    files_w = keep(windows.recent_files(mft.join(windows_at, ["image", "volume"], "left_semi"), people_w), "files-w")
    files_l = keep(linux.home_files(entries.join(linux_at, ["image", "volume"], "left_semi"), inodes, people_l, budget), "files-l")
    saved = windows.last_saved(files_w).unionByName(linux.last_saved(files_l))
    people = people_w.unionByName(people_l, allowMissingColumns=True).join(saved, ["image", "volume", "username"], "left")
    recent = windows.ranked(files_w).drop("ft").unionByName(linux.ranked(files_l), allowMissingColumns=True)
    os_w, os_l = windows.os(current), linux.os(texts, ext_info)
    both = lambda w, x: w.unionByName(x, allowMissingColumns=True)
    pack = lambda df, name: df.select("image", "volume", F.struct(*(c for c in df.columns if c not in ("image", "volume"))).alias(name))
    scanned = mft.groupBy("image", "volume").agg(F.count("number").alias("records_live"))
    at = windows_at.withColumn("kind", F.lit("windows")).unionByName(linux_at.withColumn("kind", F.lit("linux")))
    systems = at.join(pack(both(os_w, os_l), "os"), ["image", "volume"], "left").join(pack(both(windows.device(current), linux.device(texts, ext_info)), "device"), ["image", "volume"], "left")
    systems = keep(systems.join(scanned, ["image", "volume"], "left"), "systems")
    failed = hives.where("hive IS NULL AND error IS NOT NULL AND volume IS NOT NULL").select("image", "volume", "error")
    failed = failed.unionByName(ext_info.where("error IS NOT NULL AND volume IS NOT NULL").select("image", "volume", "error"))
    failed = failed.unionByName(mft.where("error IS NOT NULL AND volume > 0").select("image", "volume", "error")).unionByName(entries.where("error IS NOT NULL AND volume > 0").select("image", "volume", "error"))
    damaged = evidence.damage(evidence.chunks(spark, paths)) if chunks else spark.createDataFrame([], "image string, damage string, chunks long, first_chunk long")
    found = findings(info, volumes, failed.groupBy("image", "volume").agg(F.min("error").alias("error")), systems, windows.notes(hives), damaged)
    names = systems.select("image", F.col("volume").alias("index"), F.coalesce("os.name", F.initcap("kind")).alias("os"))
    return Triage(info, keep(volumes.join(names, ["image", "index"], "left"), "volumes"), systems, keep(people, "users"), keep(recent, "recent"), keep(found, "findings"))


def documents(t: Triage) -> DataFrame:
    """image, document: one JSON text for each image; what is not known is left out."""
    row = lambda *cols: F.struct(*cols)
    listed = lambda df, by, order, cols, out: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*cols).alias("x")))), lambda v: v["x"]).alias(out))
    by = ["image", "volume"]
    people = listed(t.users, by, F.col("ord"), [c for c in _USER if c in t.users.columns], "users")
    files = ["path", "name", "user", "record", "modified", "size"]
    recent = listed(t.recent, by, F.col("rank"), files, "recent_files")
    place = t.volumes.select("image", F.col("index").alias("volume"), row("index", "offset", "size", "fs", "type", "name").alias("place"))
    systems = t.systems.join(people, by, "left").join(recent, by, "left").join(place, by, "left")
    systems = systems.withColumn("last_saved", F.get("recent_files", 0))
    per_image = [
        listed(systems, ["image"], F.col("volume"), ["kind", "os", "device", "users", "last_saved", "recent_files", "records_live", F.col("place").alias("volume")], "systems"),
        listed(t.volumes, ["image"], F.col("index"), ["index", "scheme", "offset", "size", "type", "name", "bootable", "fs", "os"], "volumes"),
        listed(t.findings, ["image"], F.col("seq"), ["level", "title", "detail"], "findings"),
        t.volumes.groupBy("image").agg(F.min("scheme").alias("partition_scheme")),
    ]
    out = t.info.withColumn("about", F.struct("format", "segments", "size", "bytes_per_sector", "chunk_size", "header", "md5", "sha1", "acquisition_errors"))
    for more in per_image:
        out = out.join(more, "image", "left")
    document = F.struct(F.col("about").alias("image"), "partition_scheme", "volumes", "systems", "findings", "error")
    return out.select("image", F.to_json(document).alias("document"))


def summary(t: Triage) -> DataFrame:
    """A card for each system: image, volume, os, device, users (how many), names (four at most), last_saved."""
    names = t.users.groupBy("image", "volume").agg(F.count("*").alias("users"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "username"))), lambda x: x["username"]).alias("all"))
    four = F.concat(F.array_join(F.slice("all", 1, 4), ", "), F.when(F.size("all") > 4, ", …").otherwise(""))
    newest = t.recent.where("rank = 1").select("image", "volume", F.col("path").alias("last_saved"), "modified")
    out = t.systems.join(names, ["image", "volume"], "left").join(newest, ["image", "volume"], "left")
    version = F.concat_ws(" ", "os.version", F.concat(F.lit("(build "), "os.build", F.lit(")")))
    return out.select("image", "volume", F.col("os.name").alias("os"), version.alias("version"), F.col("device.computer_name").alias("device"), "users", four.alias("names"), "last_saved", "modified")
