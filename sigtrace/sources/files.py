"""Files and texts as rows, and results as tables with an age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that is looked at, in bytes.
MOST_BYTES = 200 * 1024 * 1024


def read_files(spark: SparkSession, where: str, glob: str | None = None, most: int = MOST_BYTES) -> DataFrame:
    """path, modificationTime, length, content of files up to most bytes; larger ones are left out when listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(where).where(F.col("length") <= most)


def write_results(df: DataFrame, where: str, run: str) -> None:
    """Appends results with the run's name and the time, partitioned by run."""
    df.withColumn("run", F.lit(run)).withColumn("made_at", F.current_timestamp()).write.mode("append").partitionBy("run").parquet(where)


def read_results(spark: SparkSession, where: str, run: str | None = None, hours: float = 1.0) -> DataFrame:
    """Results not older than hours; a run's partition is the only one read if it is named."""
    rows = spark.read.parquet(where)
    rows = rows.where(F.col("run") == run) if run else rows
    return rows.where(F.col("made_at") > F.current_timestamp() - F.expr(f"INTERVAL {int(hours * 3600)} SECOND"))


def decoded(content: str | Column) -> Column:
    """UTF-8 text of bytes; invalid sequences become the replacement character."""
    c = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(c.cast("string"))
