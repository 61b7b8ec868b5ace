"""Triage of Windows volumes: system, device, users and newest files, from registry values and the file table.

Every function takes relations of the evidence source and gives a row, or rows, for each volume (image, volume).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import files as f
from .evidence import file_paths

VOLUME = ["image", "volume"]
_VERSION = "microsoft\\windows nt\\currentversion"
_PROFILES = f"{_VERSION}\\profilelist\\"
_ACCOUNTS = "sam\\domains\\account\\users\\"
_RECENT = "software\\microsoft\\windows\\currentversion\\explorer\\recentdocs"


def systems(hives: DataFrame) -> DataFrame:
    """Volumes that have a SYSTEM hive, readable or not."""
    return hives.where("hive = 'SYSTEM'").select(*VOLUME).distinct()


def notes(hives: DataFrame) -> DataFrame:
    """image, volume, level, title, detail of hives that can't be read."""
    why = F.split_part("error", F.lit(": "), F.lit(1))
    title = F.when(why == "unreadable", F.concat(F.lit("Couldn't read "), "hive")).otherwise(F.concat("hive", F.lit(" is damaged")))
    return hives.where("hive IS NOT NULL AND error IS NOT NULL").select(*VOLUME, F.lit("info").alias("level"), title.alias("title"), F.substring_index("error", ": ", -1).alias("detail"))


def current(hives: DataFrame) -> DataFrame:
    """Rows of the control set in use, with key_path from below it; SOFTWARE's and HardwareConfig's as they are. All key paths in lower case.

    The set is the one that Select names, else the first.
    """
    rows = hives.where("error IS NULL AND hive IN ('SYSTEM', 'SOFTWARE') AND key_path IS NOT NULL").withColumn("key_path", F.lower("key_path"))
    chosen = rows.where("key_path = 'select' AND lower(name) = 'current'").groupBy(*VOLUME).agg(F.max(scalars.signed_long(F.col("n"))).alias("n"))
    has = rows.where("key_path RLIKE '^controlset[0-9]{3}$'").select(*VOLUME, F.col("key_path").alias("set")).distinct()
    wanted = F.concat(F.lit("controlset"), F.lpad(F.coalesce("n", F.lit(1)).cast("string"), 3, "0"))
    used = has.join(chosen, VOLUME, "left").groupBy(*VOLUME).agg(F.coalesce(F.max(F.when(F.col("set") == wanted, F.col("set"))), F.max(F.when(F.col("set") == "controlset001", F.col("set")))).alias("set"))
    own = rows.join(used, VOLUME, "left").withColumn("inside", F.coalesce(F.col("key_path").startswith(F.concat("set", F.lit("\\"))), F.lit(False)))
    below = F.when(F.col("inside"), F.substring("key_path", F.length("set") + 2, F.length("key_path"))).otherwise(F.col("key_path"))
    return own.where(F.col("inside") | (F.col("hive") == "SOFTWARE") | F.col("key_path").startswith("hardwareconfig")).withColumn("key_path", below).drop("set", "inside")


def _value(path: str, name: str, column: str = "s") -> Column:
    """Of a volume's rows, the value of a key; by max(), as a key has one value of a name."""
    return F.max(F.when((F.col("key_path") == path) & (F.lower("name") == name.lower()), F.col(column)))


def os(rows: DataFrame) -> DataFrame:
    """current() -> image, volume, name, edition, version, build, kernel_version, installed, registered_owner, ..., architecture."""
    v = lambda name, column="s": _value(_VERSION, name, column)
    raw = rows.groupBy(*VOLUME).agg(
        F.max(F.col("key_path") == _VERSION).alias("known"), v("ProductName").alias("product"), v("CurrentBuildNumber").alias("build1"), v("CurrentBuild").alias("build2"), v("UBR", "n").alias("ubr"),
        v("EditionID").alias("edition"), v("DisplayVersion").alias("v1"), v("ReleaseId").alias("v2"), v("CSDVersion").alias("v3"), v("CurrentVersion").alias("kernel_version"),
        v("InstallTime", "n").alias("install_time"), v("InstallDate", "n").alias("install_date"), v("RegisteredOwner").alias("registered_owner"), v("RegisteredOrganization").alias("registered_org"),
        v("ProductId").alias("product_id"), v("SystemRoot").alias("system_root"), _value("control\\session manager\\environment", "PROCESSOR_ARCHITECTURE").alias("architecture"),
    )
    build = F.coalesce(f.first_of_chain(F.col("build1"), F.col("build2")), F.lit(""))
    name = F.when(F.col("known"), scalars.product_name(F.coalesce(scalars.filled(F.col("product")), F.lit("Windows")), build))
    time, date = (scalars.signed_long(F.col(c)) for c in ("install_time", "install_date"))
    installed = F.when(time != 0, scalars.iso(scalars.filetime(time))).when(date != 0, scalars.iso(F.timestamp_seconds(date)))
    return raw.select(
        *VOLUME, name.alias("name"), scalars.filled(F.col("edition")).alias("edition"), f.first_of_chain(F.col("v1"), F.col("v2"), F.col("v3")).alias("version"), scalars.filled(scalars.build_text(build, F.col("ubr"))).alias("build"),
        scalars.filled(F.col("kernel_version")).alias("kernel_version"), installed.alias("installed"), *(scalars.filled(F.col(c)).alias(c) for c in ("registered_owner", "registered_org", "product_id", "system_root", "architecture")),
    )


def addresses(rows: DataFrame) -> DataFrame:
    """image, volume, ip_addresses: of all interfaces in order, the fixed ones before the given ones, each once."""
    own = rows.where("key_path LIKE 'services\\\\\\\\tcpip\\\\\\\\parameters\\\\\\\\interfaces\\\\\\\\%' AND lower(name) IN ('ipaddress', 'dhcpipaddress')")
    each = own.select(*VOLUME, "key_path", "seq", "name", F.posexplode(F.coalesce("l", F.array("s"))).alias("k", "ip")).where("ip <> '' AND ip <> '0.0.0.0'")
    order = F.struct("key_path", F.lower("name") == "dhcpipaddress", "k")
    return f.ordered_distinct(each.withColumn("_order", order), VOLUME, "ip", "_order", "ip_addresses")


def device(rows: DataFrame) -> DataFrame:
    """current() -> image, volume, computer_name, domain, ip_addresses, time_zone, utc_offset, last_shutdown, manufacturer, model, bios."""
    info, tcp, zone = "control\\systeminformation", "services\\tcpip\\parameters", "control\\timezoneinformation"
    named = rows.where("key_path = 'hardwareconfig' AND lower(name) = 'lastconfig'").groupBy(*VOLUME).agg(F.max(F.lower("s")).alias("_last"))
    hardware = rows.join(named, VOLUME, "left").withColumn("key_path", F.when(F.col("key_path") == F.concat(F.lit("hardwareconfig\\"), "_last"), "hardware").otherwise(F.col("key_path")))
    either = lambda name: f.first_of_chain(_value(info, name), _value("hardware", name))
    raw = hardware.groupBy(*VOLUME).agg(
        scalars.filled(_value("control\\computername\\computername", "ComputerName")).alias("computer_name"), f.first_of_chain(_value(tcp, "Domain"), _value(tcp, "DhcpDomain")).alias("domain"),
        f.first_of_chain(_value(zone, "TimeZoneKeyName"), _value(zone, "StandardName")).alias("time_zone"), _value(zone, "ActiveTimeBias", "n").alias("bias"), _value("control\\windows", "ShutdownTime", "b").alias("down"),
        either("SystemManufacturer").alias("manufacturer"), either("SystemProductName").alias("model"), either("BIOSVersion").alias("bios"),
    )
    down = scalars.iso(scalars.filetime(scalars.signed_long(scalars.little_endian(F.col("down"), 0, 8))))
    out = raw.join(addresses(rows), VOLUME, "left")
    return out.select(*VOLUME, "computer_name", "domain", "ip_addresses", "time_zone", scalars.utc_offset(scalars.signed_long(F.col("bias"))).alias("utc_offset"), down.alias("last_shutdown"), "manufacturer", "model", "bios")


def _utf16(raw: bytes | None) -> str | None:
    return None if raw is None else raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace")


def _text(raw: Column) -> Column:
    """UTF-16 with what isn't text replaced, which Spark's decode() refuses; of a few hundred short values."""
    return F.udf(_utf16, "string", useArrow=True)(raw)


def accounts(hives: DataFrame) -> DataFrame:
    """The SAM's users: image, volume, rid, username, full_name, comment, last_logon, ..., by names and by numbers, whichever there are."""
    rows = hives.where("hive = 'SAM' AND error IS NULL AND key_path IS NOT NULL").withColumn("low", F.lower("key_path")).where(F.col("low").startswith(_ACCOUNTS))
    leaf = F.substring_index("key_path", "\\", -1)
    # The value without a name has the user's number as its type.
    names = rows.where(F.col("low").startswith(_ACCOUNTS + "names\\") & (F.col("name") == "")).groupBy(*VOLUME, F.col("type").alias("rid")).agg(F.max(leaf).alias("by_name"))
    number = F.when(leaf.rlike("(?i)^[0-9a-f]{1,8}$"), F.conv(leaf, 16, 10).cast("long"))
    keys = rows.where(~F.col("low").startswith(_ACCOUNTS + "names")).withColumn("rid", number).where("rid IS NOT NULL")
    held = keys.groupBy(*VOLUME, "rid").agg(F.max(F.when(F.col("name") == "F", F.col("b"))).alias("f"), F.max(F.when(F.col("name") == "V", F.col("b"))).alias("v"))
    fixed, varied = F.when(F.octet_length("f") >= 68, F.col("f")), F.when(F.octet_length("v") >= 0xCC, F.col("v"))
    n = lambda at, width: scalars.signed_long(scalars.little_endian(fixed, at, width))
    time = lambda at: scalars.iso(scalars.filetime(n(at, 8)))

    def field(k: int) -> Column:
        at, size = (scalars.signed_long(scalars.little_endian(varied, 12 * k + d, 4)).cast("int") for d in (0, 4))
        return scalars.filled(_text(F.substring(varied, at + 0xCC + 1, size)))

    known = held.select(
        *VOLUME, "rid", field(1).alias("own_name"), field(2).alias("full_name"), field(3).alias("comment"), time(8).alias("last_logon"), time(16).alias("password_set"), time(32).alias("last_failed_logon"),
        n(66, 2).cast("int").alias("logon_count"), n(64, 2).cast("int").alias("failed_logons"), (n(56, 2).bitwiseAND(1) != 0).alias("disabled"),
    )
    return names.join(known, [*VOLUME, "rid"], "full").withColumn("username", F.coalesce("by_name", "own_name")).drop("by_name", "own_name")


def recent_documents(hives: DataFrame) -> DataFrame:
    """image, volume, profile, recent_doc (name, when) of each user's list of documents: the entry that the list's order begins with."""
    rows = hives.where("hive = 'NTUSER.DAT' AND error IS NULL").where(F.lower("key_path") == _RECENT)
    order = rows.where("name = 'MRUListEx' AND octet_length(b) >= 4").select(*VOLUME, "owner", scalars.signed_long(scalars.little_endian(F.col("b"), 0, 4)).alias("first"))
    entry = rows.select(*VOLUME, "owner", F.col("name").alias("entry"), "b", "written").join(order.where("first <> 4294967295"), [*VOLUME, "owner"]).where("entry = cast(first AS string) AND b IS NOT NULL")
    name = scalars.filled(F.split_part(_text(F.col("b")), F.lit("\0"), F.lit(1)))
    doc = F.when(name.isNotNull(), F.struct(name.alias("name"), scalars.iso(scalars.filetime(F.col("written"))).alias("when")))
    return entry.select(*VOLUME, F.col("owner").alias("profile"), doc.alias("recent_doc"))


def users(hives: DataFrame) -> DataFrame:
    """Profiles with their accounts, and accounts without a profile.

    An account belongs to a profile by the number at its identifier's end; only local identifiers, and those of domains, take its
    columns. ord is the order: profiles by identifier, then accounts by number.
    """
    rows = hives.where("hive = 'SOFTWARE' AND error IS NULL AND key_path IS NOT NULL").withColumn("low", F.lower("key_path")).where(F.col("low").startswith(_PROFILES))
    sid = F.substring_index("key_path", "\\", -1)
    load = lambda name: scalars.signed_long(F.max(F.when(F.lower("name") == name, F.col("n"))))
    listed = rows.where(f.is_profile_sid(sid)).groupBy(*VOLUME, sid.alias("sid")).agg(F.min("seq").alias("seq"), F.max(F.when(F.lower("name") == "profileimagepath", F.col("s"))).alias("path"), load("localprofileloadtimehigh").alias("high"), load("localprofileloadtimelow").alias("low"))
    loaded = F.when((F.col("high") != 0) | (F.col("low") != 0), scalars.iso(scalars.filetime(scalars.joined_number(F.col("high"), F.col("low")))))
    folder = scalars.last_part(F.rtrim(F.col("profile"), F.lit("\\")), "\\")
    profiles = listed.select(*VOLUME, "sid", "seq", F.coalesce("path", F.lit("")).alias("profile"), scalars.rid(F.col("sid")).alias("key_rid"), loaded.alias("profile_loaded"))
    sam = accounts(hives)
    own = sam.withColumnRenamed("rid", "key_rid").withColumn("found", F.lit(True))
    joined = profiles.join(own, [*VOLUME, "key_rid"], "left").join(recent_documents(hives), [*VOLUME, "profile"], "left")
    takes = F.col("found") & F.col("sid").startswith("S-1-5-21-")
    kept = ["full_name", "comment", "last_logon", "password_set", "last_failed_logon", "logon_count", "failed_logons", "disabled"]
    out = joined.select(
        *VOLUME, F.struct(F.lit(0).alias("part"), F.col("seq").cast("long").alias("at")).alias("ord"), "sid", F.when(takes, F.col("key_rid")).alias("rid"), F.coalesce(F.when(takes, F.col("username")), folder).alias("username"),
        F.when(F.col("found"), "local").otherwise(scalars.account_type(F.col("sid"))).alias("account"), "profile", *(F.when(takes, F.col(c)).alias(c) for c in kept), "profile_loaded", "recent_doc",
    )
    seen = out.where("rid IS NOT NULL").select(*VOLUME, "rid").distinct()
    left = sam.join(seen, [*VOLUME, "rid"], "left_anti").select(*VOLUME, F.struct(F.lit(1).alias("part"), F.col("rid").alias("at")).alias("ord"), "rid", "username", F.lit("local").alias("account"), *kept)
    return out.unionByName(left, allowMissingColumns=True)


def recent_files(mft: DataFrame, people: DataFrame) -> DataFrame:
    """Candidates for the newest files: three of each folder at most, with path, user, modified, record, size, ft.

    Folders' paths are found for folders that have such files; the user is the profile's, else the folder's name.
    """
    folders = mft.where("error IS NULL AND flags & 2 > 0")
    live = mft.where("error IS NULL AND flags & 2 = 0").where(f.is_user_file(F.col("name"), F.col("number"), F.col("modified_ft")))
    newest = f.folder_newest(live, [*VOLUME, "parent"], [F.desc("modified_ft"), F.desc("number")])
    placed = file_paths(folders.unionByName(newest))
    folder = F.substring("path", 1, F.length("path") - F.length("name") - 1)
    placed = placed.withColumn("folder", folder).where(f.is_user_path(F.col("folder")))
    top = F.substring_index(F.lower("folder"), "\\", 3)
    # A row for each profile of a volume.
    roots = people.where("profile <> ''").select(*VOLUME, F.lower(scalars.volume_path(F.col("profile"))).alias("top"), F.col("username").alias("owner")).groupBy(*VOLUME, "top").agg(F.max("owner").alias("owner"))
    owned = placed.withColumn("top", top).join(roots, [*VOLUME, "top"], "left")
    user = F.coalesce("owner", F.substring_index(F.substring_index("folder", "\\", 3), "\\", -1))
    return owned.select(*VOLUME, "path", "name", user.alias("user"), F.col("number").alias("record"), scalars.iso(scalars.filetime(F.col("modified_ft"))).alias("modified"), F.col("modified_ft").alias("ft"), "size")


def ranked(candidates: DataFrame) -> DataFrame:
    """The newest files of each volume, with rank."""
    return f.newest(candidates, VOLUME, [F.desc("ft"), F.desc("record")])


def last_saved(candidates: DataFrame) -> DataFrame:
    """Each user's newest file: image, volume, username, last_saved (path, modified, size)."""
    best = candidates.groupBy(*VOLUME, F.col("user").alias("username")).agg(F.max(F.struct("ft", "record", F.struct("path", "modified", "size").alias("file"))).alias("m"))
    return best.select(*VOLUME, "username", F.col("m.file").alias("last_saved"))
