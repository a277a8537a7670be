"""What the operators of this subpackage share: tables in the shared folder, folds, samples of labelled rows, numbers
for rows that repeat each other."""

from __future__ import annotations

import ctypes
import functools
import gc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, remove, shared_dir, written

__all__ = ["among_equals", "bounded_batches", "class_sample", "discard", "fold", "in_one", "lean", "maybe_in", "one_each", "plain_text", "release", "remove", "row_hash", "shared_dir", "trim", "unit_hash", "written"]

#: Upper bound on the text that one Arrow batch carries to a Python worker, whatever the row count.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for a Python worker even if every text is very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts of finished queries, which it does only after the driver's JVM collects."""
    trim()
    spark._jvm.java.lang.System.gc()


def lean(scan):
    """The scan, after which a Python worker gives its free memory back before it goes on to other work."""

    @functools.wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            trim()

    return run


def in_one(table: DataFrame) -> DataFrame:
    """A small written() table as one partition: what follows on such tables alone is one task, without a shuffle."""
    out = table.coalesce(1)
    out._written_to = getattr(table, "_written_to", None)  # discard() deletes what it reads
    return out


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds (null ids: fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def unit_hash(*cols: str | Column, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) of the given columns."""
    h = F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def row_hash(*cols: str | Column, seed: int = 7) -> Column:
    """A repeatable 64-bit hash of what a row holds, its text included: rows that only lack an id differ in it."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])


def class_sample(rows: DataFrame, label: str, per_class: int, pick: str = "__pick") -> DataFrame:
    """rows of about per_class different values of pick (a long, a hash) for each label value, with __share of its class.

    One sketched count of different values by label (combined before the shuffle) sets the shares, so that the sample stays bounded at any input size
    and a common class cannot crowd out a rare one. Counts stay a table, so any number of labels will do; null labels take
    no part. Rows equal in pick enter together: reduce them with one_each() before the driver gathers them.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("__class")).agg(F.approx_count_distinct(pick, 0.02).alias("__n"))
    counts = written(counts, "classes")  # as a table its size is known, so that it is broadcast only if it is small
    both = rows.join(counts.withColumn("__share", F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("__n"))), F.col(label) == F.col("__class"))
    return both.where(F.shiftrightunsigned(F.col(pick), 11) / F.lit(float(1 << 53)) < F.col("__share")).drop("__class", "__n")


def one_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One of the rows that are equal in keys, combined in each task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("__one")).select(*keys, *[F.col(f"__one.{c}").alias(c) for c in rest])


def among_equals(rows: DataFrame, key: str, out: str = "__nth") -> DataFrame:
    """rows with out: 0 for a row whose key (a long) no other row has, else its number among the rows of that key.

    Only keys that repeat are numbered: a count combined before its shuffle finds them, and no other row moves if they are
    few enough to broadcast. Rows of one key are numbered in cells by the task that read them, so no task gets all rows
    of a key. Which of several equal rows gets which number is open; the numbers of a key are always 0 to n - 1.
    """
    often = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key), "repeated")
    zero = F.lit(0).cast("long")
    if often.isEmpty():
        return rows.withColumn(out, zero)
    once = rows.join(often, key, "left_anti").withColumn(out, zero)
    again = rows.join(often, key, "left_semi").withColumn("__at", F.monotonically_increasing_id())
    again = written(again.withColumn("__cell", F.shiftrightunsigned("__at", 33)), "again")
    cells = again.groupBy(key, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col(key).alias("__key"), F.col("__cell").alias("__in"), F.coalesce(F.sum("__n").over(ahead), zero).alias("__first"))
    place = F.row_number().over(Window.partitionBy(key, "__cell").orderBy("__at"))
    numbered = again.withColumn("__place", place).join(cells, (F.col(key) == F.col("__key")) & (F.col("__cell") == F.col("__in")))
    numbered = numbered.withColumn(out, (F.col("__first") + F.col("__place") - 1).cast("long"))
    return once.unionByName(numbered.select(*once.columns))


def plain_text(text: bytes | None) -> str:
    """The text of UTF-8 bytes; each invalid sequence becomes the replacement character, and null the empty text."""
    return "" if text is None else text.decode("utf-8", "replace")


#: Bits of a membership filter: 8 MB at most on the driver and on each executor, whatever the number of keys.
FILTER_BITS = 26


def maybe_in(keys: DataFrame, key: str):
    """A function of a Column of longs: false only where its value is surely not among keys.key.

    The filter is an array of 2**FILTER_BITS bits, gathered as at most 2**(FILTER_BITS - 6) words of 64 bits that are
    combined before the shuffle. With more keys than bits it says yes more often, and the exact join that must follow
    moves more rows.
    """
    spark = keys.sparkSession
    place = F.shiftrightunsigned(F.xxhash64(F.lit(31), F.col(key)), 64 - FILTER_BITS)
    words = keys.where(F.col(key).isNotNull()).select(F.shiftright(place, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("b"))
    # As Arrow, not as rows: a million Python objects take some hundred times their numbers' bytes.
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    del found
    trim()
    held = spark.sparkContext.broadcast(bits.view(np.uint64))

    @F.pandas_udf("boolean")
    def inside(place: pd.Series) -> pd.Series:
        at = place.to_numpy(np.int64, na_value=0)
        return pd.Series(held.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) != 0)

    return lambda c: inside(F.coalesce(F.shiftrightunsigned(F.xxhash64(F.lit(31), c), 64 - FILTER_BITS), F.lit(0)))
