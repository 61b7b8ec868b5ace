"""Triage of Linux volumes: system, device, users and newest files, from text files, folders and inodes.

Every function takes relations of the evidence source and gives a row, or rows, for each volume (image, volume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import files as f
from ..operators import paths

VOLUME = ["image", "volume"]
#: The root folder's inode, and the types of entries that are walked: files and folders.
TOP, FILE, FOLDER = 2, 1, 2


def _lines(texts: DataFrame, *names: str) -> DataFrame:
    return texts.where(F.col("path").isin(*names) & (F.col("kind") == "line"))


def _first(texts: DataFrame, path: str, out: str) -> DataFrame:
    """The first line of a text that isn't blank."""
    lines = _lines(texts, path).where(F.trim("text") != "")
    return lines.groupBy(*VOLUME).agg(F.min_by(F.trim("text"), "no").alias(out))


def os(texts: DataFrame, info: DataFrame) -> DataFrame:
    """image, volume, name, version, id, codename, kernel_versions; the name from the first source that has one."""
    known = f.settings(_lines(texts, "/etc/os-release", "/usr/lib/os-release", "/etc/lsb-release"), [*VOLUME, "path"], "text", "no")
    # The second file counts only where the first has no line at all.
    has = _lines(texts, "/etc/os-release").select(*VOLUME).distinct().withColumn("has", F.lit(True))
    known = known.join(has, VOLUME, "left").where("path <> '/usr/lib/os-release' OR has IS NULL")
    v = lambda name, lsb=False: F.max(F.when((F.col("path") == "/etc/lsb-release") == lsb, F.when(F.col("name") == name, F.col("value"))))
    release = known.groupBy(*VOLUME).agg(
        f.first_of_chain(v("PRETTY_NAME"), v("NAME")).alias("own"), v("DISTRIB_DESCRIPTION", True).alias("lsb"), f.first_of_chain(v("VERSION"), v("VERSION_ID")).alias("version"), scalars.filled(v("ID")).alias("id"), scalars.filled(v("VERSION_CODENAME")).alias("codename")
    )
    kernels = texts.where("path = '/boot' AND kind = 'entry'").select(*VOLUME, scalars.kernel_version(F.col("text")).alias("k")).groupBy(*VOLUME).agg(F.array_sort(F.collect_set("k")).alias("kernel_versions"))
    out = info.where("linux").select(*VOLUME).join(release, VOLUME, "left").join(_first(texts, "/etc/redhat-release", "redhat"), VOLUME, "left").join(_first(texts, "/etc/debian_version", "debian"), VOLUME, "left").join(kernels, VOLUME, "left")
    name = f.first_of_chain(F.col("own"), F.col("lsb"), F.col("redhat"), F.concat(F.lit("Debian "), F.col("debian")))
    return out.select(*VOLUME, name.alias("name"), "version", "id", "codename", F.when(F.size("kernel_versions") > 0, F.col("kernel_versions")).alias("kernel_versions"))


def device(texts: DataFrame, info: DataFrame) -> DataFrame:
    """image, volume, computer_name, time_zone, last_mounted_at, last_mounted, last_written, manufacturer."""
    link = texts.where("path = '/etc/localtime' AND kind = 'target'").groupBy(*VOLUME).agg(F.max(scalars.zone_of_link(F.col("text"))).alias("linked"))
    out = info.where("linux")
    for path, name in (("/etc/hostname", "computer_name"), ("/etc/timezone", "zone"), ("/sys/class/dmi/id/sys_vendor", "manufacturer")):
        out = out.join(_first(texts, path, name), VOLUME, "left")
    time = lambda c: F.when(F.col(c) != 0, scalars.iso(F.timestamp_seconds(c)))
    return out.join(link, VOLUME, "left").select(*VOLUME, "computer_name", F.coalesce("zone", "linked").alias("time_zone"), scalars.filled(F.col("mounted_at")).alias("last_mounted_at"), time("mounted").alias("last_mounted"), time("written").alias("last_written"), "manufacturer")


def last_logins(logins: DataFrame) -> DataFrame:
    """image, volume, username, last_logon of records that are logins."""
    rows = logins.where("error IS NULL AND type = 7 AND user <> '' AND sec > 0").groupBy(*VOLUME, F.col("user").alias("username")).agg(F.max("sec").alias("sec"))
    return rows.select(*VOLUME, "username", scalars.iso(F.timestamp_seconds("sec")).alias("last_logon"))


def users(texts: DataFrame, logins: DataFrame) -> DataFrame:
    """Root and people, in the order of /etc/passwd (ord)."""
    own = f.login_accounts(_lines(texts, "/etc/passwd"), "text").join(last_logins(logins), [*VOLUME, "username"], "left")
    order = F.struct(F.lit(0).alias("part"), F.col("no").cast("long").alias("at")).alias("ord")
    return own.select(*VOLUME, order, "username", "uid", "full_name", "profile", "shell", F.lit("local").alias("account"), "last_logon", "disabled")


def folders(entries: DataFrame) -> DataFrame:
    """image, volume, number, path of every folder that the root leads to; the root's path is empty."""
    key = [*VOLUME, "number"]
    below = entries.where(f"error IS NULL AND ftype = {FOLDER}").select(*VOLUME, F.col("child").alias("number"), F.col("parent").alias("_p"), "name")
    # A folder has one parent; in a damaged volume that lists it twice, the smaller one is taken.
    below = below.groupBy(*key).agg(F.min(F.struct("_p", "name")).alias("m")).select(*key, F.col("image").alias("_i"), F.col("volume").alias("_v"), F.col("m._p").alias("_p"), F.col("m.name").alias("name"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("_i", "string"), ("_v", "int"), ("_p", "long"))]
    tops = entries.where("error IS NULL").select(*VOLUME).distinct().select(*VOLUME, F.lit(TOP).cast("long").alias("number"), *none, F.lit("").alias("name"))
    return paths.resolve(below.where(f"number <> {TOP}").unionByName(tops), key, ["_i", "_v", "_p"], "name", "/")


def home_files(entries: DataFrame, inodes: DataFrame, people: DataFrame, budget: int | None = None) -> DataFrame:
    """Files below users' homes: path, name, user, mtime, size; names that begin with a dot, and what is below them, are left out.

    budget: entries of each volume that are looked at, in the order of their paths; without one, all are. A link in a home is
    not followed, and files more than DEPTH folders down are left out.
    """
    homes = people.where("profile <> '' AND profile <> '/'").select(*VOLUME, F.rtrim(F.col("profile"), F.lit("/")).alias("home"), F.col("username").alias("user")).groupBy(*VOLUME, "home").agg(F.min("user").alias("user"))
    # Homes are a few rows a volume; folders meet them on the volume and are kept where a home's path leads.
    placed = folders(entries).join(F.broadcast(homes), VOLUME)
    inside = placed.where((F.col("path") == F.col("home")) | F.col("path").startswith(F.concat("home", F.lit("/")))).withColumn("below", F.substring("path", F.length("home") + 1, F.length("path")))
    walked = inside.where(~F.col("below").contains("/.") & (F.size(F.split("below", "/")) - 1 <= f.DEPTH))
    each = entries.where("error IS NULL").withColumnRenamed("parent", "number").join(walked, [*VOLUME, "number"])
    each = each.withColumn("full", F.concat("path", F.lit("/"), "name"))
    if budget is not None:
        from ..operators.scans import prefix_sums

        ones = prefix_sums(each, [F.col(c) for c in (*VOLUME, "full", "home")], {"before": F.lit(1).cast("long")})
        starts = ones.groupBy(*VOLUME).agg(F.min("before").alias("start"))
        each = ones.join(starts, VOLUME).where(F.col("before") - F.col("start") < budget).drop("before", "start")
    files = each.where((F.col("ftype") == FILE) & ~F.col("name").startswith("."))
    known = inodes.where("error IS NULL AND mode & 61440 = 32768").select(*VOLUME, F.col("number").alias("child"), "mtime", "size")
    return files.join(known, [*VOLUME, "child"]).select(*VOLUME, F.col("full").alias("path"), "name", "user", "mtime", "size")


def ranked(files: DataFrame) -> DataFrame:
    """The newest files of each volume, with rank; ties go by path, then user, then size, the last first."""
    newest = f.newest(files, VOLUME, [F.desc("mtime"), F.desc("path"), F.desc("user"), F.desc("size")])
    return newest.select(*VOLUME, "path", "name", "user", scalars.iso(F.timestamp_seconds("mtime")).alias("modified"), "size", "rank")


def last_saved(files: DataFrame) -> DataFrame:
    best = files.groupBy(*VOLUME, F.col("user").alias("username")).agg(F.max(F.struct("mtime", "path", "size")).alias("m"))
    return best.select(*VOLUME, "username", F.struct(F.col("m.path").alias("path"), scalars.iso(F.timestamp_seconds("m.mtime")).alias("modified"), F.col("m.size").alias("size")).alias("last_saved"))
