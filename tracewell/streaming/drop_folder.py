"""A folder that images are put into, triaged as they come: an extension, as triage by itself looks at one image at a time."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import triage

#: Names of first files of images; further segments are found from these.
FIRST = r"(?i)\.(e01|001|dd|raw|img|bin)$"


def arrivals(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream of path, modificationTime, length of the images that are put into a folder; their bytes are not read."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(folder)
    return stream.select("path", "modificationTime", "length").where(F.col("path").rlike(FIRST))


def _append(target: str):
    def run(batch: DataFrame, number: int) -> None:
        paths = [unquote(urlparse(r.path).path) for r in batch.select("path").distinct().collect()]  # as many as a trigger takes
        if not paths:
            return
        t = triage.run(batch.sparkSession, paths)
        for name, df in (("documents", triage.documents(t)), ("findings", t.findings), ("recent", t.recent), ("summary", triage.summary(t))):
            # A batch that runs again replaces what it wrote.
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return run


def watch(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Triages what comes and writes documents, findings, recent and summary below target, a part for each batch; once: what is there, then ends."""
    writer = arrivals(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(_append(target))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
