"""What triage asks of files and accounts, as functions of DataFrames and columns. Lists are parameters; their defaults are fixed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from .relational import is_noise, top_per_group

# Files that systems and programs write by themselves, and profiles that are no user's.
NOISE_NAMES = ["desktop.ini", "thumbs.db", "ntuser.dat", "ntuser.ini", "ntuser.pol", "usrclass.dat", "iconcache.db"]
NOISE_PREFIXES = ["ntuser.dat", "usrclass.dat", "~$", "~wr"]
NOISE_SUFFIXES = [".tmp", ".lock", ".log1", ".log2", ".regtrans-ms", ".blf", ".etl"]
NO_PROFILES = ["default", "default user", "all users", "defaultapppool"]
BUILTIN_SIDS = ["S-1-5-18", "S-1-5-19", "S-1-5-20"]
#: Records below this number are the volume's own.
FIRST_FILE = 24
#: Newest files of a folder and of a system; levels that a home is walked down.
PER_FOLDER, TOTAL, DEPTH = 3, 15, 24
#: Users' numbers on Linux, beside root's 0.
UIDS = (1000, 59999)


def is_user_file(name: Column, number: Column, modified: Column) -> Column:
    """Files of users: not the volume's own, with a time, and not written by the system itself."""
    return (number >= FIRST_FILE) & (F.coalesce(modified, F.lit(0)) != 0) & ~is_noise(name, NOISE_NAMES, NOISE_PREFIXES, NOISE_SUFFIXES)


def is_user_path(folder: Column, sep: str = "\\", top: str = "users", skip: Sequence[str] = tuple(NO_PROFILES), hidden: str = "appdata") -> Column:
    """Folders \\Users\\name and below, but for profiles in skip and what is below a folder named hidden."""
    parts = F.split(F.lower(folder), F.lit("\\" + sep), -1)
    below = F.slice(parts, 4, F.greatest(F.lit(0), F.size(parts) - 3))
    return (F.size(parts) >= 3) & (F.get(parts, 1) == top) & ~F.get(parts, 2).isin(*skip) & ~F.array_contains(below, hidden)


def is_profile_sid(sid: Column) -> Column:
    return sid.startswith("S-1-") & ~sid.isin(*BUILTIN_SIDS)


def login_accounts(lines: DataFrame, text: str) -> DataFrame:
    """Lines of a passwd file -> username, uid, full_name, profile, shell, disabled, of root and users; others are left out."""
    f = F.split(F.col(text), ":", -1)
    uid = F.when(F.get(f, 2).rlike("^[0-9]+$"), F.get(f, 2).try_cast("long"))
    out = lines.where((F.size(f) >= 7) & ((uid == 0) | uid.between(*UIDS)))
    shell = F.get(f, 6)
    return out.select("*", F.get(f, 0).alias("username"), uid.cast("int").alias("uid"), scalars.full_name(F.get(f, 4)).alias("full_name"), F.get(f, 5).alias("profile"), shell.alias("shell"), scalars.is_disabled_shell(shell).alias("disabled"))


def settings(lines: DataFrame, by: Sequence[str], text: str, no: str) -> DataFrame:
    """by, name, value of lines name=value: comments left out, quotes taken off, of equal names the last one."""
    at = F.instr(text, "=")
    named = lines.where((at > 0) & ~F.ltrim(F.col(text)).startswith("#"))
    value = F.trim(F.substring(F.col(text), at + 1, F.length(text)))
    for quote in ('"', "'"):
        value = F.trim(value, F.lit(quote))
    return named.select(*by, F.trim(F.substring(F.col(text), F.lit(1), at - 1)).alias("name"), value.alias("value"), no).groupBy(*by, "name").agg(F.max_by("value", no).alias("value"))


def newest(files: DataFrame, by: Sequence[str], order: Sequence[Column], total: int = TOTAL) -> DataFrame:
    """The newest files of each system, with their rank from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(*order)
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= total)


def folder_newest(files: DataFrame, by: Sequence[str], order: Sequence[Column], per_folder: int = PER_FOLDER) -> DataFrame:
    """The newest files of each folder; Spark limits each group before it is moved."""
    return top_per_group(files, by, order, per_folder)


def first_of_chain(*sources: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(scalars.filled(s) for s in sources))


def ordered_distinct(df: DataFrame, by: Sequence[str], value: str, order: str, out: str) -> DataFrame:
    """by, array of the distinct values in the order of their first places."""
    first = df.groupBy(*by, value).agg(F.min(order).alias("_first"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", F.col(value).alias("v")))), lambda x: x["v"]).alias(out))
