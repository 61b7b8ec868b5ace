"""What the corpus operators share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a character class of Java's and RE2's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: The same characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Spark's setting that deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    It is read from the session. Only a local session without the setting gets a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="tracewell-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, so lost executors cost no recomputation.

    What was shuffled for it goes as soon as it is written, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    own = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if own is None else spark.conf.set(CLEANUP, own)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more: all that was made of them has been written itself."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.written_to
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def words(text: Column) -> Column:
    """The words of a text, as runs of what isn't white space; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words(text) as long, without a pass over the array's strings."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, SPACE))
    first, last = F.substring(t, 1, 1), F.substring(t, -1, 1)
    blank = [F.lit(c) for c in SPACE_CHARS]
    n = parts - first.isin(*blank).cast("int") - last.isin(*blank).cast("int")
    # A text of white space alone splits into two empty parts.
    return F.when(F.length(F.translate(t, SPACE_CHARS, "")) == 0, F.lit(0)).otherwise(n).cast("long")
