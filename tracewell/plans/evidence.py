"""Relations of disk images as DataFrames: what the source decodes, completed by Spark's own operators."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import paths
from ..operators.scans import join_groups
from ..sources import images
from ..sources.evidence import EvidenceSource

# Names of partition types.
PARTITION_TYPES = {
    "c12a7328-f81f-11d2-ba4b-00a0c93ec93b": "EFI system",
    "e3c9e316-0b5c-4db8-817d-f92df00215ae": "Microsoft reserved",
    "ebd0a0a2-b9e5-4433-87c0-68b6b72699c7": "Basic data",
    "de94bba4-06d1-4d40-a16a-bfd50179d6ac": "Windows recovery",
    "5808c8aa-7e8f-42e0-85d2-e1e90434cfb3": "LDM metadata",
    "af9b60a0-1431-4f62-bc68-3311714a69ad": "LDM data",
    "e75caf8f-f680-4cee-afa3-b001e56efc2d": "Storage Spaces",
    "0fc63daf-8483-4772-8e79-3d69d8477de4": "Linux filesystem",
    "4f68bce3-e8cd-4db1-96e7-fbcaf984b709": "Linux root (x86-64)",
    "933ac7e1-2eb4-4f13-b844-0e14e2aef915": "Linux /home",
    "0657fd6d-a4ab-43c4-84e5-0933c84b4f4f": "Linux swap",
    "e6d6d379-f507-44c2-a23c-238f2a3df928": "Linux LVM",
    "a19d880f-05fc-4d3b-a006-743f0f84911e": "Linux RAID",
    "ca7d7ccb-63ed-4c53-861c-1742536059cc": "Linux LUKS",
    "bc13c2ff-59e6-4262-a352-b275fd6f7172": "Linux extended boot",
    "21686148-6449-6e6f-744e-656564454649": "BIOS boot",
    "7c3457ef-0000-11aa-aa11-00306543ecac": "Apple APFS",
    "48465300-0000-11aa-aa11-00306543ecac": "Apple HFS+",
    "426f6f74-0000-11aa-aa11-00306543ecac": "Apple boot",
    "52637672-7900-11aa-aa11-00306543ecac": "Apple recovery",
    "0x01": "FAT12",
    "0x04": "FAT16",
    "0x06": "FAT16",
    "0x07": "NTFS / exFAT",
    "0x0B": "FAT32",
    "0x0C": "FAT32 (LBA)",
    "0x0E": "FAT16 (LBA)",
    "0x11": "Hidden FAT12",
    "0x14": "Hidden FAT16",
    "0x17": "Hidden NTFS",
    "0x1B": "Hidden FAT32",
    "0x1C": "Hidden FAT32",
    "0x27": "Windows recovery",
    "0x42": "Windows dynamic",
    "0x82": "Linux swap",
    "0x83": "Linux",
    "0x8E": "Linux LVM",
    "0xA5": "FreeBSD",
    "0xA8": "Apple UFS",
    "0xAF": "Apple HFS+",
    "0xEE": "GPT protective",
    "0xEF": "EFI system",
    "0xFD": "Linux RAID",
    "": "Whole image",
}


def relation(spark: SparkSession, name: str, paths: Sequence[str], ranges: Sequence[Sequence] | None = None) -> DataFrame:
    spark.dataSource.register(EvidenceSource)
    read = spark.read.format("evidence").option("relation", name).option("paths", json.dumps(list(paths)))
    return (read if ranges is None else read.option("ranges", json.dumps([list(r) for r in ranges]))).load()


def ranges(spark: SparkSession, paths: Sequence[str]) -> list[tuple]:
    """What the large relations scan, found by a task for each image: a row for 262,144 records of a file table, or 64 groups of an ext volume.

    An image that can't be read has a row of every kind with its error.
    """
    found = relation(spark, "ranges", paths)
    kinds = F.explode(F.when(F.col("kind").isNull(), F.array(F.lit("mft"), F.lit("ext"))).otherwise(F.array("kind")))
    rows = found.select("image", kinds.alias("kind"), F.coalesce("volume", F.lit(0)).alias("volume"), "first", "last", "place", "error")
    return [tuple(r) for r in rows.orderBy("image", "kind", "volume", "first").collect()]


def large(spark: SparkSession, name: str, paths: Sequence[str], known: list[tuple] | None = None) -> DataFrame:
    """A large relation (mft, inodes, entries), scanned in ranges that tasks have found before."""
    return relation(spark, name, paths, ranges(spark, paths) if known is None else known)


def file_system(head: Column, far: Column) -> Column:
    """Name of the file system in a volume: the first signature that its first 4 KiB (head) or the 8 bytes at 0x10040 (far) have."""

    def has(at: int, *marks: bytes) -> Column:
        return F.substring(head, at + 1, len(marks[0])).isin(*map(bytearray, marks))

    def bit(at: int, mask: int) -> Column:
        return F.conv(F.hex(F.substring(head, at + 1, 1)), 16, 10).cast("int").bitwiseAND(mask) != 0

    ext = F.when(bit(1024 + 96, 0x40) | bit(1024 + 97, 0x02), "ext4").when(bit(1024 + 92, 0x04), "ext3").otherwise("ext2")
    return (
        F.when(F.coalesce(F.length(head), F.lit(0)) < 512, "unknown")
        .when(has(3, b"NTFS    "), "NTFS").when(has(3, b"-FVE-FS-"), "BitLocker").when(has(3, b"EXFAT   "), "exFAT").when(has(3, b"ReFS\0\0\0\0"), "ReFS")
        .when(has(82, b"FAT32   "), "FAT32").when(has(54, b"FAT12", b"FAT16", b"FAT  "), "FAT").when(has(0, b"LUKS\xba\xbe"), "LUKS").when(has(0, b"XFSB"), "XFS")
        .when(has(32, b"NXSB"), "APFS").when(has(512, b"LABELONE") | has(0, b"LABELONE"), "LVM").when(has(1080, b"\x53\xef"), ext)
        .when(has(1024, b"H+", b"HX"), "HFS+").when(has(4086, b"SWAPSPACE2"), "swap").when(far == F.lit(bytearray(b"_BHRfS_M")), "Btrfs").otherwise("unknown")
    )


def volumes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per partition, sizes cut to the image; an image without a table is one volume. Unreadable images have a row with their error."""
    p = relation(spark, "partitions", paths)
    # A table of fixed values, 45 rows.
    types = F.broadcast(spark.createDataFrame(list(PARTITION_TYPES.items()), "code string, type string"))
    zero = F.lit(0).cast("long")
    size = F.greatest(zero, F.least("size", F.col("image_size") - F.col("offset")))
    p = p.join(types, "code", "left").withColumn("size", F.when(F.col("size").isNotNull(), size))
    fs = F.when(F.col("error").isNull(), F.when(F.col("size") > 0, file_system(F.col("head"), F.col("far"))).otherwise("unknown"))
    return p.select("image", "scheme", "index", "kind", "offset", "size", F.coalesce("type", "code").alias("type"), "name", "bootable", fs.alias("fs"), "error")


def chunks(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every stored chunk of EWF images: its number, its place in the media and its place in a segment file.

    Segments are scanned apart; the chunks before each are summed over segments, never over chunks. What can't be read is a
    row with its error; chunks behind it keep the numbers that the chunks found before them give.
    """
    stored = relation(spark, "chunks", paths)
    info = relation(spark, "info", paths).where("chunk_size IS NOT NULL").select("image", "size", "chunk_size")
    upto = Window.partitionBy("image").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored.groupBy("image", "segment").agg(F.count("in_segment").alias("n"))
    base = counts.select("image", "segment", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    out = stored.join(base, ["image", "segment"]).join(info, "image", "left")
    out = out.withColumn("chunk", F.col("before") + F.col("in_segment")).withColumn("media_offset", F.col("chunk") * F.col("chunk_size"))
    length = F.greatest(F.lit(0), F.least(F.col("chunk_size").cast("long"), F.col("size") - F.col("media_offset")))
    return out.select("image", "chunk", "media_offset", F.when(F.col("error").isNull(), length).alias("media_length"), "segment", "path", "file_offset", "stored", "packed", "error")


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_fd: dict[str, int] = {}
    try:
        for batch in batches:
            # Few chunks at a time, so that memory is bounded by them and not by Spark's batch.
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                data, bad = [], []
                for path, at, stored, packed, want in zip(*(part.column(c).to_pylist() for c in ("path", "file_offset", "stored", "packed", "media_length")), strict=True):
                    if path not in open_fd:
                        open_fd[path] = os.open(path, os.O_RDONLY)
                    raw = os.pread(open_fd[path], stored, at)
                    got, missing = images.unpack(raw, packed, want)
                    # What isn't packed has its checksum behind it.
                    wrong = not packed and not missing and raw[want : want + 4] != images.zlib.adler32(got).to_bytes(4, "little")
                    data.append(got)
                    bad.append("missing" if missing else "checksum" if wrong else None)
                yield pa.record_batch({"image": part.column("image"), "chunk": part.column("chunk"), "media_offset": part.column("media_offset"), "data": pa.array(data, pa.binary()), "damage": pa.array(bad, pa.string())})
    finally:
        for fd in open_fd.values():
            os.close(fd)


def decoded(chunk_rows: DataFrame) -> DataFrame:
    """chunks() with their bytes; those that can't be read are zeros and have a damage."""
    return chunk_rows.where("error IS NULL AND media_length IS NOT NULL").mapInArrow(_decode, "image string, chunk long, media_offset long, data binary, damage string")


def damage(chunk_rows: DataFrame) -> DataFrame:
    """Images with damaged chunks: how many, and the first one. Bytes leave no task."""
    hit = decoded(chunk_rows).where("damage IS NOT NULL")
    return hit.groupBy("image", "damage").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first_chunk"))


def last_logins(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """For each user the latest login, in seconds."""
    rows = relation(spark, "logins", paths).where("type = 7 AND user <> '' AND sec > 0")
    return rows.groupBy("image", "user").agg(F.max("sec").alias("sec"))


def registry_value(values: DataFrame, key_path: str, name: str) -> DataFrame:
    """The value of that name in that key of each hive; letters' case doesn't count."""
    return values.where((F.lower("key_path") == key_path.lower()) & (F.lower("name") == name.lower()))


def file_paths(mft: DataFrame, sep: str = "\\") -> DataFrame:
    """Records of files with path, from the volume's root (record 5); files in folders that don't lead there are left out."""
    key, folder = ["image", "volume", "number"], ["image", "volume", "parent"]
    mft = paths.cut(mft.where("error IS NULL").drop("error"), "file-table")
    top = F.col("number") == 5
    here = [F.when(~top, F.col(c)).alias(a) for c, a in (("image", "_i"), ("volume", "_v"), ("parent", "_p"))]
    tree = mft.where("flags & 2 > 0").select(*key, *here, F.when(top, "").otherwise(F.col("name")).alias("name"))
    found = paths.resolve(tree, key, ["_i", "_v", "_p"], "name", sep).withColumnsRenamed({"number": "parent", "path": "_folder"})
    files = mft.where("flags & 2 = 0")
    # A folder may hold a third of all files.
    sizes = paths.cut(files.groupBy(*folder).agg(F.count("*").alias("_files")), "folder-sizes")
    total = sizes.agg(F.sum("_files")).first()[0] or 0
    placed = join_groups(files, found.join(sizes, folder), folder, total, "_files", ["number"])
    return placed.withColumn("path", F.concat("_folder", F.lit(sep), "name")).drop("_folder", "_files")
