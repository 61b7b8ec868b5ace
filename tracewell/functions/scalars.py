"""Scalar functions of triage: times, sizes, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100 ns from 1601 to 1970.
FILETIME_EPOCH = 116444736000000000


def whole(a: Column, b: Column | int) -> Column:
    """a / b rounded down, in integers, for b above 0: exact beyond 2^53."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def filetime(ft: Column) -> Column:
    """A timestamp; null for 0 and for the largest value."""
    return F.when((ft > 0) & (ft < 9223372036854775807), F.timestamp_micros(whole(ft - FILETIME_EPOCH, 10)))


def micros_text(ts: Column) -> Column:
    """To the microsecond; years beyond 9999 without the sign that date_format() gives them."""
    return F.ltrim(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+"))


def iso(ts: Column) -> Column:
    return F.when(F.year(ts) <= 9999, F.date_format(ts, "yyyy-MM-dd HH:mm:ss 'UTC'"))


#: Names of units, by base.
UNITS = {1000: ("B", "KB", "MB", "GB", "TB"), 1024: ("B", "KiB", "MiB", "GiB", "TiB")}


def size_text(n: Column, base: int, places: int) -> Column:
    """A number of bytes in the largest unit that leaves one or more, rounded to places; whole bytes below the first unit."""
    units = UNITS[base]
    out = F.format_string(f"%.{places}f {units[-1]}", n / float(base ** (len(units) - 1)))
    for k in range(len(units) - 2, 0, -1):
        out = F.when(n < base ** (k + 1), F.format_string(f"%.{places}f {units[k]}", n / float(base**k))).otherwise(out)
    return F.when(n < base, F.format_string("%d B", n)).otherwise(out)


def utc_offset(bias: Column) -> Column:
    """Minutes west of UTC, as an unsigned 32-bit number -> UTC+hh:mm."""
    b = F.when(bias >= 1 << 31, bias - (1 << 32)).otherwise(bias)
    m = F.abs(b).cast("long")
    return F.concat(F.lit("UTC"), F.when(b > 0, "-").otherwise("+"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def segment_extension(n: Column) -> Column:
    """1 to 99 -> E01 to E99, then EAA, EAB, ... ZZZ; null beyond."""
    k = n - 100
    letter = lambda x: F.char((F.lit(65) + x).cast("long"))
    first = F.char((F.lit(69) + F.floor(k / 676)).cast("long"))
    later = F.concat(first, letter(F.floor(k / 26) % 26), letter(k % 26))
    return F.when((n >= 1) & (n <= 99), F.concat(F.lit("E"), F.lpad(n.cast("string"), 2, "0"))).when((n >= 100) & (k < 22 * 676), later)


def filled(text: Column) -> Column:
    """Null for empty texts, so that coalesce() goes on to the next source."""
    return F.when(text != "", text)


def little_endian(raw: Column, at: int, width: int) -> Column:
    """The unsigned number in a binary's bytes, as decimal(20,0); null if they end before."""
    digits = F.concat(*(F.hex(F.substring(raw, at + k + 1, 1)) for k in reversed(range(width))))
    return F.when(F.octet_length(raw) >= at + width, F.conv(digits, 16, 10).cast("decimal(20,0)"))


def signed_long(n: Column) -> Column:
    """An unsigned number as long; null beyond what a long holds."""
    return n.try_cast("long")


def product_name(name: Column, build: Column) -> Column:
    """Windows 11 calls itself Windows 10 in the registry; from build 22000 on it is told by that."""
    late = build.rlike("^[0-9]+$") & (build.try_cast("long") >= 22000)
    return F.when(late, F.replace(name, F.lit("Windows 10"), F.lit("Windows 11"))).otherwise(name)


def build_text(build: Column, revision: Column) -> Column:
    """build.revision, or what is known of it."""
    return F.when((build != "") & revision.isNotNull(), F.concat(build, F.lit("."), revision.cast("string"))).otherwise(build)


def volume_path(path: Column) -> Column:
    """A path inside its volume: without a drive, or a %variable% in front, or backslashes at its end."""
    colon, second = F.instr(path, ":"), F.locate("%", path, 2)
    inner = F.when(colon > 0, F.substring(path, colon + 1, F.length(path))).when(path.startswith("%") & (second > 0), F.substring(path, second + 1, F.length(path))).otherwise(path)
    return F.rtrim(inner, F.lit("\\"))


def last_part(path: Column, sep: str) -> Column:
    return F.substring_index(path, sep, -1)


def rid(sid: Column) -> Column:
    """The number at the end of a security identifier; null if it has none."""
    last = last_part(sid, "-")
    return F.when(last.rlike("^[0-9]+$"), last.try_cast("long"))


def account_type(sid: Column) -> Column:
    return F.when(sid.startswith("S-1-12-1-"), "Microsoft Entra ID").when(sid.startswith("S-1-5-21-"), "domain").otherwise("other")


def full_name(gecos: Column) -> Column:
    return filled(F.split_part(gecos, F.lit(","), F.lit(1)))


def is_disabled_shell(shell: Column) -> Column:
    return shell.endswith("nologin") | shell.endswith("false")


def kernel_version(name: Column) -> Column:
    """What follows vmlinuz-; null for other names."""
    return F.when(name.startswith("vmlinuz-"), F.substring(name, len("vmlinuz-") + 1, 1 << 16))


def zone_of_link(target: Column) -> Column:
    """What follows zoneinfo/ in a link's target; null without it."""
    at = F.instr(target, "zoneinfo/")
    return F.when(at > 0, filled(F.substring(target, at + len("zoneinfo/"), F.length(target))))


def one_line(text: Column) -> Column:
    """Tabs and line ends as spaces, and none of them at the ends."""
    return F.trim(F.translate(text, "\t\r\n", "   "))


def escaped(text: Column) -> Column:
    """For HTML, attributes included."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def joined_number(high: Column, low: Column) -> Column:
    """high << 32 | low."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def blocks(n: Column, size: int) -> Column:
    """n / size rounded up."""
    return whole(n + (size - 1), size)


def aligned(n: Column, size: int) -> Column:
    """n rounded down to a multiple of size."""
    return n - F.pmod(n, F.lit(size))


def inode_place(number: Column, per_group: Column) -> Column:
    """Group and place in it of an inode."""
    return F.struct(whole(number - 1, per_group).alias("group"), F.pmod(number - 1, per_group).alias("place"))


def progress(k: Column, n: Column) -> Column:
    """Per cent at the beginning of candidate k, from 0, of n: they share what lies between 2 and 98."""
    return F.lit(2.0) + F.lit(96.0) * k / F.greatest(F.lit(1), n)


def time_text(seconds: Column) -> Column:
    """UTC; a dash for none."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "-").otherwise(F.coalesce(iso(F.timestamp_seconds(seconds)), F.lit("-")))


def one_place(x: Column) -> Column:
    """A double's exact value rounded to one place, halves to even, as C writes it; format_string() rounds its shortest digits, halves up."""
    return F.udf(lambda v: None if v is None else f"{v:.1f}", "string", useArrow=True)(x)


def speed_text(rate: Column) -> Column:
    """Bytes a second as MB/s with one place; 0 for none."""
    return F.concat(one_place(F.coalesce(rate.cast("double"), F.lit(0.0)) / F.lit(1e6)), F.lit(" MB/s"))


def duration_text(seconds: Column) -> Column:
    """1h 02m 03s, or 2m 03s below an hour, rounded to seconds; a dash for none."""
    n = F.bround(seconds.cast("double")).cast("long")
    h, m, s = whole(n, 3600), F.pmod(whole(n, 60), F.lit(60)), F.pmod(n, F.lit(60))
    short = F.format_string("%dm %02ds", m, s)
    return F.when(seconds.isNull(), "-").when(n < 3600, short).otherwise(F.format_string("%dh %02dm %02ds", h, m, s))


def device_argument(path: Column) -> Column:
    """What smartctl calls the disk that a path names or is a part of."""
    number, letter = F.regexp_extract(path, r"(?i)^\\\\\.\\physicaldrive(\d+)$", 1), F.regexp_extract(path, r"^\\\\\.\\([A-Za-z]):$", 1)
    mac = F.regexp_extract(path, r"^/dev/r?(disk\d+)", 1)
    linux = F.regexp_replace(F.regexp_replace(path, r"^(/dev/(?:nvme\d+n|mmcblk)\d+)p\d+$", "$1"), r"^(/dev/[shv]d[a-z]+)\d+$", "$1")
    return F.when(number != "", F.concat(F.lit("/dev/pd"), number)).when(letter != "", F.concat(letter, F.lit(":"))).when(mac != "", F.concat(F.lit("/dev/"), mac)).otherwise(linux)
