"""Legacy archives: ARC files of versions 1 and 2, and their conversion to WARC.

Archives are written by Spark's text writer, one record a row and the format's own record end as line separator,
compressed with gzip: any file system that Spark writes takes them, and no task needs more than its records. They are
read as binary files and parsed by the lengths that their headers declare.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.scans import join_groups

from .common import new_folder, written

#: Field names of a record line, in a file description record and by version.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of a revisit record.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes inflated at once.
STEP = 1 << 20
#: An Arrow batch to Spark holds about so many bytes.
BATCH = 8 << 20

#: head: the status line and headers of an HTTP message, with the blank line; null for other records. error: why a file can't be read on.
ARC_SCHEMA = "file string, seq long, version int, url string, ip string, date string, mime string, status string, key string, head binary, payload binary, digest string, error string"
WARC_SCHEMA = "file string, seq long, record_id string, warc_type string, date string, uri string, key string, refers_to string, length long, declared string, computed string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str | None) -> bytes:
    """A header value without what would end it: spaces and control characters are percent-encoded."""
    return "".join(c if "!" <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value or "-").encode("utf-8", "replace") or b"-"


def arc_block(version: int) -> bytes:
    """The block of a file description record."""
    return f"{version} 0 tracewell\n{FIELDS[version]}\n".encode()


def arc_record(version: int, url: str | None, date: str, mime: str, block: bytes, status: str = "200", checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    """A record without the newline that ends it."""
    head = [_line(url), b"0.0.0.0", date.encode(), mime.encode()]
    if version == 2:
        head += [status.encode(), checksum.encode(), b"-", str(offset).encode(), _line(name)]
    return b" ".join([*head, str(len(block)).encode()]) + b"\n" + block


def http_block(key: str | None, payload: bytes) -> bytes:
    """An HTTP response; the key stands in a header of its own."""
    own = b"" if key is None else b"X-Page-Key: " + _line(key) + b"\r\n"
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def _to_batches(rows: Iterator[tuple], schema: pa.Schema, weigh: int) -> Iterator[pa.RecordBatch]:
    """weigh: the column whose bytes count."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 256 + len(row[weigh] or b"")
        if size >= BATCH:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_VALUE = pa.schema([("value", pa.binary())])


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int | None = None, date: str = "20200101000000") -> None:
    """An ARC file for each partition of pages, of the given version (default: 1 and 2 in turn)."""
    rows = pages.select(F.col(id_col).cast("string").alias("k"), F.col(url_col).cast("string").alias("u"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("p"), F.spark_partition_id().alias("part"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        kind, offset = 0, 0
        for batch in batches:
            for key, url, payload, part in zip(*(batch.column(c).to_pylist() for c in ("k", "u", "p", "part")), strict=True):
                name = f"part-{part}.arc"
                if not kind:
                    kind = version or 1 + part % 2
                    first = arc_record(kind, f"filedesc://{name}", date, "text/plain", arc_block(kind), name=name)
                    offset = len(first) + 1
                    yield (first,)
                record = arc_record(kind, url, date, "text/html", http_block(key, payload), checksum=digest_of(payload), offset=offset, name=name)
                offset += len(record) + 1
                yield (record,)

    out = rows.mapInArrow(lambda batches: _to_batches(records(batches), _VALUE, 0), "value binary")
    # A cast from binary keeps the bytes as they are, and the text writer writes them as they are.
    out.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Bytes:
    """Reads a file's bytes, inflating gzip members in steps."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.buffer, self.pos = memoryview(raw), 0, b"", 0
        self.zip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while self.at < len(self.raw):
            piece = self.raw[self.at : self.at + STEP // 4]
            self.at += len(piece)
            if self.zip is None:
                new = bytes(piece)
            else:
                new = self.zip.decompress(piece)
                while self.zip.eof and self.zip.unused_data:
                    rest = self.zip.unused_data
                    self.zip = zlib.decompressobj(31)
                    new += self.zip.decompress(rest)
                if self.zip.eof:
                    self.zip = zlib.decompressobj(31)
            if new:
                self.buffer, self.pos = self.buffer[self.pos :] + new, 0
                return True
        return False

    def read(self, n: int) -> bytes:
        if len(self.buffer) - self.pos < n:
            parts, have = [self.buffer[self.pos :]], len(self.buffer) - self.pos
            self.buffer, self.pos = b"", 0
            while have < n and self._more():
                parts.append(self.buffer)
                have += len(self.buffer)
                self.buffer = b""
            self.buffer, self.pos = b"".join(parts), 0
        out = self.buffer[self.pos : self.pos + n]
        self.pos += len(out)
        return out

    def line(self) -> bytes | None:
        """Up to a newline, without it; None at the end."""
        while (k := self.buffer.find(b"\n", self.pos)) < 0:
            if not self._more():
                rest, self.pos = self.buffer[self.pos :], len(self.buffer)
                return rest or None
        out, self.pos = self.buffer[self.pos : k], k + 1
        return out


def parse_arc(raw: bytes) -> Iterator[dict]:
    """The records after the file description, whose version and list of fields tell what a record line holds.

    A line or length that can't be read, or a block that ends early, gives a last record with an error: where the next one
    would begin is not known.
    """
    data, version, names = _Bytes(raw), 1, FIELDS[1].split()
    try:
        while (line := data.line()) is not None:
            if not line.strip():
                continue
            parts = line.rstrip(b"\r").split(b" ")
            if not parts[-1].isdigit():
                raise ValueError(f"no length in {line[:80]!r}")
            block = data.read(int(parts[-1]))
            if len(block) < int(parts[-1]):
                raise ValueError(f"{len(block)} of {int(parts[-1])} bytes")
            if parts[0].startswith(b"filedesc:"):
                first, _, rest = block.partition(b"\n")
                version = int(first.split(b" ", 1)[0])
                listed = rest.partition(b"\n")[0].decode("latin-1").split()
                names = listed or FIELDS.get(version, FIELDS[1]).split()
                continue
            # A type may hold spaces; fields before it are counted from the left, those after it from the right.
            text = [p.decode("utf-8", "replace") for p in parts]
            if len(text) < len(names):
                raise ValueError(f"{len(text)} fields, not {len(names)}")
            after = len(names) - 4
            text = [*text[:3], " ".join(text[3 : len(text) - after]), *text[len(text) - after :]]
            field = dict(zip([n.lower() for n in names], text, strict=True))
            yield {"version": version, "url": text[0], "ip": text[1], "date": text[2], "mime": text[3], "status": field.get("result-code"), "block": block, "error": None}
    except (ValueError, zlib.error) as e:
        yield {"version": version, "url": None, "ip": None, "date": None, "mime": None, "status": None, "block": b"", "error": str(e)}


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes | None]:
    """Header names in lower case, payload, and the head without the key that http_block() puts in. A block that is no HTTP message is payload as a whole."""
    if not block.startswith(b"HTTP/"):
        return {}, block, None
    head, between, payload = block.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    pairs = (x.split(b":", 1) for x in lines[1:] if b":" in x)
    own = b"\r\n".join(x for x in lines if not x.lower().startswith(b"x-page-key:"))
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, v in pairs}, payload, own + between


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """ARC_SCHEMA: a row for each record of the ARC files in a folder, and one with an error for each file that is damaged, at its end."""
    schema = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("status", pa.string()), ("key", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("digest", pa.string()), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("path")[k].as_py().rpartition("/")[2]
                for seq, r in enumerate(parse_arc(batch.column("content")[k].as_py())):
                    headers, payload, head = split_http(r["block"])
                    yield name, seq, r["version"], r["url"], r["ip"], r["date"], r["mime"], r["status"], headers.get("x-page-key"), head, payload, digest_of(payload), r["error"]

    return _files(spark, path).mapInArrow(lambda b: _to_batches(rows(b), schema, 10), ARC_SCHEMA)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files


def record_id(*parts: str | None) -> str:
    """The same for the same record: conversions that run again give the same archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(p or '' for p in parts))}>"


def warc_date(arc_date: str) -> str:
    """YYYYMMDDhhmmss, or a part of it from the left -> 2020-01-01T00:00:00Z."""
    digits = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() else "19700101000000"
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def warc_record(kind: str, rid: str, date: str, uri: str, ip: str | None, digest: str, key: str | None, block: bytes, payload_length: int, first: tuple[str, str] | None = None, mime: str = "application/http; msgtype=response") -> bytes:
    """A record without the two line ends that end it. first: id and key of the record that a revisit refers to."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {ip or '0.0.0.0'}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"X-Payload-Length: {payload_length}"]
    if key is not None:
        head.append(f"X-Page-Key: {key}")
    if first:
        head += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {first[0]}", *([f"X-Refers-To-Key: {first[1]}"] if first[1] is not None else [])]
    head += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, "", ""]).encode("utf-8", "replace") + block


def convert(arc: DataFrame, path: str, least: int = 0) -> None:
    """read_arc() rows -> WARC files in a folder.

    Of records with equal payloads of least bytes or more, that with the smallest key (as a number; null last, then
    by file and place) is a response and the others revisit it. Which it is is found from digests alone; payloads are
    joined with it once. HTTP messages keep their status and headers; other records become resources with their own type. A
    revisit's block is its message's head. Rows with an error are left out.
    """
    arc = arc.where("error IS NULL")
    small = written(arc.select("file", "seq", "key", "url", "date", "digest", F.octet_length("payload").alias("n")), "arc-index")
    order = F.struct(F.col("key").isNull(), F.col("key").try_cast("long"), "key", "file", "seq", "url", "date")
    firsts = small.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min(order).alias("f"), F.count("*").alias("c")).where("c > 1")
    others = join_groups(small, firsts, ["digest", "n"], small.count(), "c", ["file", "seq"]).where(~((F.col("file") == F.col("f.file")) & (F.col("seq") == F.col("f.seq"))))
    revisits = others.select(F.col("file"), F.col("seq"), F.struct("f.key", "f.url", "f.date", "digest", "f.file", "f.seq").alias("f"))
    schema = _VALUE

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                date, n = warc_date(r["date"]), len(r["payload"])
                rid = record_id(r["url"], r["date"], r["digest"], r["key"], r["file"], str(r["seq"]))
                http = r["head"] is not None
                if f := r["f"]:
                    yield (warc_record("revisit", rid, date, r["url"], r["ip"], r["digest"], r["key"], r["head"] or b"", n, (record_id(f["url"], f["date"], f["digest"], f["key"], f["file"], str(f["seq"])), f["key"])),)
                elif http:
                    yield (warc_record("response", rid, date, r["url"], r["ip"], r["digest"], r["key"], r["head"] + r["payload"], n),)
                else:
                    yield (warc_record("resource", rid, date, r["url"], r["ip"], r["digest"], r["key"], r["payload"], n, mime=_line(r["mime"]).decode()),)

    joined = arc.join(revisits, ["file", "seq"], "left")
    out = joined.select("url", "ip", "date", "mime", "key", "head", "payload", "digest", "file", "seq", "f").mapInArrow(lambda b: _to_batches(records(b), schema, 0), "value binary")
    out.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    data = _Bytes(raw)
    while (line := data.line()) is not None:
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError("a WARC record must begin with its version")
            continue
        headers = {}
        while (line := data.line()) is not None and line.strip():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        yield headers, data.read(int(headers.get("content-length", 0)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC_SCHEMA: a row for each record of the WARC files in a folder; computed: the digest of what the record holds, null for revisits."""
    schema = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("key", pa.string()), ("refers_to", pa.string()), ("length", pa.int64()), ("declared", pa.string()), ("computed", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("path")[k].as_py().rpartition("/")[2]
                for seq, (h, block) in enumerate(parse_warc(batch.column("content")[k].as_py())):
                    payload = None if h["warc-type"] == "revisit" else split_http(block)[1]
                    length = int(h["x-payload-length"]) if payload is None else len(payload)
                    yield name, seq, h["warc-record-id"], h["warc-type"], h["warc-date"], h.get("warc-target-uri"), h.get("x-page-key"), h.get("x-refers-to-key"), length, h["warc-payload-digest"].removeprefix("sha1:"), None if payload is None else digest_of(payload)

    return _files(spark, path).mapInArrow(lambda b: _to_batches(rows(b), schema, 2), WARC_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """pages -> ARC files -> WARC files -> the rows of read_warc().

    Null payloads are empty ones; null keys stay null; repeated rows make a record each, of which one is the
    response. An empty table gives archives without records. Columns beside the three named ones are ignored.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archives")
    write_arc(pages, f"{folder}/arc", id_col, url_col, payload_col)
    convert(read_arc(spark, f"{folder}/arc"), f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")
