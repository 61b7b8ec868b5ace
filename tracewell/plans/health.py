"""SMART documents as rows: attributes that should be zero, issues, findings, verdicts."""

from __future__ import annotations

import json
import re
import shutil
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attributes of ATA disks whose value is 0 on a healthy one.
WATCHED = {5: "Reallocated sectors", 187: "Reported uncorrectable errors", 196: "Reallocation events", 197: "Current pending sectors", 198: "Offline uncorrectable sectors"}
#: What is read of smartctl's document.
DOCUMENT = (
    "smart_status struct<passed: boolean>, ata_smart_attributes struct<table: array<struct<id: int, name: string, raw: struct<value: bigint>>>>, "
    "nvme_smart_health_information_log struct<media_errors: bigint, critical_warning: bigint, percentage_used: bigint>, scsi_grown_defect_list bigint, power_on_time struct<hours: bigint>, "
    "model_name string, scsi_model_name string, serial_number string, smartctl struct<messages: array<struct<string: string>>>"
)


def _row(name: Column | str, value: Column, watched: bool, id_: Column | None = None) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    n = F.coalesce(value.cast("long"), F.lit(0).cast("long")) if watched else value.cast("long")
    return F.struct((F.lit(None).cast("int") if id_ is None else id_.cast("int")).alias("id"), name.alias("name"), n.alias("value"), (F.coalesce(n > 0, F.lit(False)) if watched else F.lit(False)).alias("flag"))


def watch_list(spark: SparkSession) -> DataFrame:
    """id, label: a fixed table."""
    return spark.createDataFrame(list(WATCHED.items()), "id int, label string")


def flagged(values: DataFrame, watched: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """values of watched attributes, with their label and whether they are above 0."""
    return values.join(F.broadcast(watched.withColumnRenamed("id", id_col)), id_col).withColumn("flag", F.coalesce(F.col(value_col) > 0, F.lit(False)))


def smart(spark: SparkSession, documents: Sequence[tuple[str, str | None]]) -> DataFrame:
    """(device, smartctl's document) -> device, available, reason, passed, model, serial, attributes (id, name, value, flag)."""
    return read(spark.createDataFrame(list(documents), "device string, document string"))


def read(rows: DataFrame) -> DataFrame:
    """rows: device, document."""
    d = rows.select("device", F.from_json("document", DOCUMENT).alias("d"))
    ids = F.create_map(*(F.lit(x) for pair in WATCHED.items() for x in pair))
    table = F.filter(F.col("d.ata_smart_attributes.table"), lambda x: F.array_contains(F.map_keys(ids), x["id"]))
    ata = F.transform(F.coalesce(table, F.array().cast("array<struct<id: int, name: string, raw: struct<value: bigint>>>")), lambda x: _row(F.element_at(ids, x["id"]), x["raw"]["value"], True, x["id"]))
    log, none = F.col("d.nvme_smart_health_information_log"), F.array().cast("array<struct<id: int, name: string, value: bigint, flag: boolean>>")
    nvme = F.when(log.isNotNull(), F.array(_row("Media and data integrity errors", log["media_errors"], True), _row("Critical warning", log["critical_warning"], True)))
    used = F.when(log["percentage_used"].isNotNull(), F.array(_row("Percentage used", log["percentage_used"], False)))
    grown = F.when(F.col("d.scsi_grown_defect_list").isNotNull(), F.array(_row("Grown defect list", F.col("d.scsi_grown_defect_list"), True)))
    hours = F.when(F.col("d.power_on_time").isNotNull(), F.array(_row("Power-on hours", F.col("d.power_on_time.hours"), False)))
    known = F.col("d.smart_status").isNotNull() | F.col("d.ata_smart_attributes").isNotNull() | log.isNotNull()
    told = F.array_join(F.transform(F.col("d.smartctl.messages"), lambda m: F.coalesce(m["string"], F.lit(""))), "; ")
    reason = F.when(~F.coalesce(known, F.lit(False)), F.coalesce(F.when(told != "", told), F.when(F.col("d").isNull(), "no SMART document").otherwise("SMART not supported by this device")))
    attributes = F.concat(*(F.coalesce(x, none) for x in (ata, nvme, used, grown, hours)))
    return d.select("device", F.coalesce(known, F.lit(False)).alias("available"), reason.alias("reason"), F.col("d.smart_status.passed").alias("passed"), F.coalesce("d.model_name", "d.scsi_model_name", F.lit("")).alias("model"), F.coalesce("d.serial_number", F.lit("")).alias("serial"), attributes.alias("attributes"))


def findings_of(found: DataFrame) -> DataFrame:
    """device, seq, level, title, detail: unavailable, a defect for each issue, or healthy."""
    defects = F.transform(F.filter("attributes", lambda a: a["flag"]), lambda a: F.concat(a["name"], F.lit(": "), a["value"].cast("string")))
    failed = F.when(~F.coalesce("passed", F.lit(True)), F.array(F.lit("SMART overall health self-assessment: FAILED"))).otherwise(F.array().cast("array<string>"))
    row = lambda level, title, detail: F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"), detail.alias("detail"))
    bad = F.transform(F.concat(failed, defects), lambda i: row("bad", "SMART defect", i))
    healthy = F.array(row("ok", "SMART healthy", F.lit("No reallocated, pending or uncorrectable sectors reported")))
    all_rows = F.when(~F.col("available"), F.array(row("info", "SMART unavailable", F.col("reason")))).when(F.size(bad) > 0, bad).otherwise(healthy)
    return found.select("device", F.posexplode(all_rows).alias("seq", "f")).select("device", "seq", "f.*")


def verdicts(findings: DataFrame, by: str, level: str = "level") -> DataFrame:
    """by, verdict: attention if any finding is bad, else clear."""
    return findings.groupBy(by).agg(F.when(F.bool_or(F.col(level) == "bad"), "attention").otherwise("clear").alias("verdict"))


def smartctl(path: str) -> str | None:
    """The document that smartctl prints of the disk, where it is installed."""
    tool = shutil.which("smartctl")
    if not tool:
        return None
    disk = re.sub(r"^(/dev/(?:nvme\d+n|mmcblk)\d+)p\d+$|^(/dev/[shv]d[a-z]+)\d+$", lambda m: m[1] or m[2], path)
    try:
        out = subprocess.run([tool, "-j", "-a", disk], capture_output=True, text=True, timeout=30).stdout
        return json.dumps(json.loads(out or "{}"))
    except (OSError, ValueError, subprocess.TimeoutExpired):
        return None
