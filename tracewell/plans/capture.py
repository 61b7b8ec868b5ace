"""Acquisition of media into images, verification, and read scans.

Blocks are read and packed in parallel, by partitions of the media, and written to the shared folder; one task for each image then puts
its chunks in order into files, as what a segment holds depends on all before, and hashes them on the way. The order comes from
Spark's external sort, so no task holds an image.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import relational as rel
from ..operators.paths import cut
from ..sinks import ewf
from ..sources import images
from ..sources.blocks import BlockSource, size_of

#: The algorithms, in the order in which they are told; scan modes and their samples (none: everything; 0: nothing).
HASHES = ("md5", "sha1", "sha256")
SCAN_MODES = {"quick": 512, "thorough": 8192, "full": None, "skip": 0}
#: Bytes of a sample, and of the speed probe; ranges of bad sectors that a result lists.
SAMPLE, PROBE, MOST_RANGES = 64 << 10, 64 << 20, 1000
BAD = "path string, first long, sectors long"


def media(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """path, at, length, data, bad, seconds, error: see BlockSource."""
    spark.dataSource.register(BlockSource)
    read = spark.read.format("media").option("paths", json.dumps(list(paths)))
    for k, v in options.items():
        read = read.option(k, v if isinstance(v, str) else json.dumps(v))
    return read.load()


def _stored(chunk: int, sector: int, compression: str | None):
    """Blocks -> their chunks as they are stored; without compression they are raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, data in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "data")), strict=True):
                rows: list[tuple] = []
                for k in range(0, len(data or b""), chunk):
                    piece = data[k : k + chunk]
                    if compression is None:
                        rows.append((path, (at + k) // chunk, len(piece), piece, False))
                        continue
                    # An image holds whole sectors.
                    whole = piece.ljust(-(-len(piece) // sector) * sector, b"\0")
                    rows.append((path, (at + k) // chunk, len(piece), *ewf.pack(whole, compression)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], names=["path", "chunk", "length", "stored", "packed"])

    return run


def _commit(jobs: dict[str, dict]):
    """Chunks in order -> files and a row for each image; what fails leaves no file and is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        path, writer, job, hashes, error, due, written = None, None, None, {}, None, 0, 0

        def end() -> None:
            nonlocal error
            files: list[str] = []
            if error is None and written != job["size"]:
                error = f"{written} of {job['size']} bytes"
            try:
                if error is None:
                    raw = {a: h.digest() for a, h in hashes.items()}
                    files = writer.close(raw.get("md5"), raw.get("sha1"), [tuple(e) for e in job["errors"]])
            except OSError as e:
                error = f"{type(e).__name__}: {e}"
            finally:
                if error is not None and writer is not None:
                    writer.abort()
            total = sum(os.path.getsize(f) for f in files)
            done.append((path, files, total, json.dumps({a: h.hexdigest() for a, h in hashes.items()}), error))

        try:
            for batch in batches:
                for p, chunk, length, stored, packed in zip(*(batch.column(c).to_pylist() for c in ("path", "chunk", "length", "stored", "packed")), strict=True):
                    if p != path:
                        if path is not None:
                            end()
                        path, job, error, due, written = p, jobs[p], None, 0, 0
                        hashes, writer = ewf.digests(job["hashes"]), None
                        try:
                            m = ewf.Media(**job["media"])
                            writer = (ewf.EwfWriter if job["format"] == "e01" else ewf.RawWriter)(job["base"], m)
                        except (OSError, ValueError) as e:
                            error = f"{type(e).__name__}: {e}"
                    if error is None and chunk != due:
                        error = f"chunk {due} is missing"
                    if error is None:
                        data = images.unpack(stored, packed, length)[0]
                        for h in hashes.values():
                            h.update(data)
                        try:
                            writer.write(stored, packed) if job["format"] == "e01" else writer.write(data)
                        except OSError as e:
                            error = f"{type(e).__name__}: {e}"
                    due, written = due + 1, written + length
            if path is not None:
                end()
        except BaseException:
            if writer is not None:
                writer.abort()
            raise
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string()), strict=True)], names=["path", "files", "image_bytes", "hashes", "error"])

    return run


def bad_ranges(blocks: DataFrame) -> DataFrame:
    """path, first, sectors: runs of sectors that couldn't be read."""
    bad = blocks.select("path", F.explode("bad").alias("lba"))
    return rel.islands(bad, "lba", by=["path"]).select("path", F.col("start").alias("first"), F.col("count").alias("sectors"))


def acquire(spark: SparkSession, jobs: Sequence[dict], hashes: Sequence[str] = ("md5", "sha1"), verify: bool = False, block: int = 1 << 20, faults: Sequence[int] = ()) -> list[dict]:
    """Makes an image of each source: jobs have source, folder, name, format (e01 or dd), compression, segment_size, case.

    A result for each job: files, hashes, bad_sectors, bad_ranges, image_bytes, speeds, verify, error. Nothing is overwritten, and an
    image that fails leaves no file. hashes are told in their fixed order; others than those known are refused.
    """
    unknown = sorted(set(hashes) - set(HASHES))
    if unknown or not hashes:
        raise ValueError(f"unknown hash algorithms: {', '.join(unknown)}" if unknown else "choose a hash algorithm")
    if len({j["source"] for j in jobs}) < len(jobs):
        raise ValueError("a source can be acquired once at a time")
    chosen, began, plan = [a for a in HASHES if a in hashes], time.time(), {}
    for j in jobs:
        kind, base = j.get("format", "e01"), os.path.join(j["folder"], j["name"])
        m = {"size": size_of(j["source"]), "sector": j.get("sector", 512), "compression": j.get("compression", "fast"), "segment": j.get("segment_size"), "case": j.get("case") or {}, "made": began}
        if kind not in ("e01", "dd") or m["compression"] not in ewf.LEVELS:
            raise ValueError(f"unknown format {kind} or compression {m['compression']}")
        first = base + (".E01" if kind == "e01" else ".001" if m["segment"] else ".dd")
        if os.path.exists(first):
            raise FileExistsError(f"refusing to overwrite {first}")
        plan[j["source"]] = {"base": base, "format": kind, "hashes": chosen, "media": m, "size": m["size"], "errors": []}
    read = cut(media(spark, list(plan), block=block, faults=json.dumps(list(faults))).drop("seconds"), "capture-blocks")
    failed = {r.path: r.error for r in read.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error")).collect()}
    bad: dict[str, list[tuple[int, int]]] = {}
    for r in bad_ranges(read).orderBy("path", "first").collect():  # runs, not sectors
        bad.setdefault(r.path, []).append((r["first"], r["sectors"]))
    for p, job in plan.items():
        job["errors"] = bad.get(p, [])
    stored = None
    for chunk, sector, compression in {(64 * j["media"]["sector"], j["media"]["sector"], j["media"]["compression"] if j["format"] == "e01" else None) for j in plan.values()}:
        own = [p for p, j in plan.items() if p not in failed and (64 * j["media"]["sector"], j["media"]["compression"] if j["format"] == "e01" else None) == (chunk, compression)]
        some = read.where(F.col("path").isin(own)).select("path", "at", "data").mapInArrow(_stored(chunk, sector, compression), "path string, chunk long, length int, stored binary, packed boolean")
        stored = some if stored is None else stored.unionByName(some)
    stored = cut(stored, "capture-chunks")
    ordered = stored.repartition(max(1, len(plan)), "path").sortWithinPartitions("path", "chunk")
    rows = {r.path: r for r in ordered.mapInArrow(_commit(plan), "path string, files array<string>, image_bytes long, hashes string, error string").collect()}
    out = []
    for j in jobs:
        r, p, took = rows.get(j["source"]), plan[j["source"]], time.time() - began
        error = failed.get(j["source"]) or (r.error if r else None if p["size"] == 0 else "nothing was read")
        sectors = sum(n for _, n in p["errors"])
        out.append({
            "source": j["source"], "format": p["format"], "compression": p["media"]["compression"] if p["format"] == "e01" else None, "paths": list(r.files) if r and not error else [], "hashes": json.loads(r.hashes) if r and not error else {},
            "total_bytes": p["size"], "sector_size": p["media"]["sector"], "image_bytes": r.image_bytes if r and not error else 0, "bad_sectors": sectors, "bad_ranges": p["errors"][:MOST_RANGES], "segment_size": p["media"]["segment"],
            "started_at": began, "finished_at": time.time(), "duration": took, "avg_speed": p["size"] / took if took else 0.0, "error": error, "verify": None,
        })
    if verify:
        whole = [o for o in out if not o["error"]]
        at = time.time()
        found = {(r.path, r.algorithm): r for r in verified(spark, [(o["paths"][0], o["total_bytes"], o["hashes"]) for o in whole]).collect()}
        for o in whole:
            mine = {a: found[o["paths"][0], a] for a in chosen}
            o["verify"] = {"hashes": {a: r.found for a, r in mine.items()}, "match": all(r.match for r in mine.values()), "duration": time.time() - at}
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size, algorithm in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "algorithm")), strict=True):
            image, h = images.open_image(path), ewf.digests([algorithm])[algorithm]
            try:
                # An image may be longer than its source by part of a sector.
                for at in range(0, min(size, image.size), 1 << 20):
                    h.update(image.read(at, min(1 << 20, size - at)))
            finally:
                image.close()
            yield pa.record_batch({"path": pa.array([path]), "algorithm": pa.array([algorithm]), "found": pa.array([h.hexdigest()])})


def verified(spark: SparkSession, recorded: Sequence[tuple[str, int, dict[str, str]]]) -> DataFrame:
    """(first file, bytes, digests by algorithm) -> path, algorithm, recorded, found, match. A task for each image and algorithm: a digest needs all bytes in order."""
    rows = [(p, n, a, d) for p, n, ds in recorded for a, d in ds.items()]
    known = spark.createDataFrame(rows, "path string, size long, algorithm string, recorded string").repartition(max(1, len(rows)), "path", "algorithm")
    found = known.mapInArrow(_hashed, "path string, algorithm string, found string")
    return matches(known.drop("size"), found, ["path", "algorithm"])


def matches(recorded: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, recorded, found, match; a digest that wasn't found again doesn't match."""
    return recorded.join(found, list(by), "left").withColumn("match", F.coalesce(F.lower("recorded") == F.lower("found"), F.lit(False)))


def all_match(digests: DataFrame, by: Sequence[str]) -> DataFrame:
    return digests.groupBy(*by).agg(F.bool_and("match").alias("matched"), F.count("*").alias("digests"))


def sample_offsets(last: DataFrame, column: str, samples: int, align: int) -> DataFrame:
    """pos: evenly spread offsets from 0 to the column's value, on multiples of align, each once."""
    n = F.col("_last")
    rows = last.select(F.col(column).cast("long").alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, samples - 1)).cast("long"))).alias("_i"))
    pos = scalars.aligned(scalars.whole(n * F.col("_i"), max(1, samples - 1)), align)
    both = rows.select(F.explode(F.array(pos, F.lit(0).cast("long"), scalars.aligned(n, align))).alias("pos"))
    return both.distinct()


def bottleneck(busy: DataFrame, by: Sequence[str], stage: str, amount: str) -> DataFrame:
    """by, stage: the stage with the largest amount; of equal ones the last by name."""
    return busy.groupBy(*by).agg(F.max(F.struct(F.col(amount).alias("a"), F.col(stage).alias("s"))).alias("_m")).select(*by, F.col("_m.s").alias("stage"))


def scan(spark: SparkSession, path: str, mode: str = "quick", smart: dict | None = None, sector: int = 512, faults: Sequence[int] = ()) -> dict:
    """SMART, speed, and sectors that can't be read: size, read_speed, estimated_seconds, bad_sectors, findings, verdict.

    smart: smartctl's document of the disk, or nothing. Samples are read by tasks of 256 each; a full scan by ranges of the media.
    """
    from . import health

    if mode not in SCAN_MODES:
        raise ValueError(f"unknown scan mode {mode}")
    began, size = time.time(), size_of(path)
    own = json.dumps(list(faults))
    probe = cut(media(spark, [path], offsets=[k for k in range(0, min(PROBE, size), 8 << 20)], length=str(8 << 20), data="false", faults=own, sector=str(sector)), "scan-probe") if size else None
    parts = [] if probe is None else [probe]
    samples = SCAN_MODES[mode]
    if size and samples is None:
        parts.append(cut(media(spark, [path], block=str(8 << 20), data="false", faults=own, sector=str(sector)), "scan-all"))
    elif size and samples:
        last = max(0, size - SAMPLE)
        offsets = [0] if size <= SAMPLE else sorted(r.pos for r in sample_offsets(spark.createDataFrame([(last,)], "last long"), "last", samples, max(sector, 4096)).collect())
        parts.append(cut(media(spark, [path], offsets=offsets, length=str(SAMPLE), data="false", faults=own, sector=str(sector)), "scan-samples"))
    reads = None
    for p in parts:
        reads = p if reads is None else reads.unionByName(p)
    runs = bad_ranges(reads).orderBy("first").collect() if reads is not None else []
    speed = probe.agg(F.try_divide(F.sum("length"), F.sum("seconds"))).first()[0] if probe is not None else None
    n_bad = sum(r["sectors"] for r in runs)
    found = health.findings_of(health.smart(spark, [(path, json.dumps(smart) if smart else None)]))
    rows = [(r.level, r.title, r.detail) for r in found.orderBy("seq").collect()]
    if n_bad:
        rows.append(("bad", "Unreadable sectors found", f"{n_bad} bad sector(s), first at LBA {runs[0]['first']}" + (" (sampled scan: there are likely more)" if samples else "")))
    elif mode != "skip":
        rows.append(("ok", "Read scan clean", "Every sector read in the scan was readable"))
    scanned = reads.agg(F.sum("length")).first()[0] if reads is not None else 0
    verdict = "attention" if any(level == "bad" for level, *_ in rows) else "clear"
    return {"mode": mode, "size": size, "sector_size": sector, "read_speed": speed, "estimated_seconds": size / speed if speed else None, "bad_sectors": n_bad, "bad_ranges": [(r["first"], r["sectors"]) for r in runs], "scanned_bytes": scanned, "findings": [dict(zip(("level", "title", "detail"), r, strict=True)) for r in rows], "verdict": verdict, "duration": time.time() - began}
