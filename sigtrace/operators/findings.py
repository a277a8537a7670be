"""The findings table: one row for each record and kind of signal, and what compares two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "ordinal int, id string, category string, name string, severity string, confidence double, evidence string, removable boolean, removal string"
COLUMNS = [c.split()[0] for c in FINDING.split(", ")]
CATEGORIES = ("metadata", "provenance", "pixel", "audio", "text", "tracking")
#: Order of severities.
RANKS = {"info": 0, "low": 1, "medium": 2, "high": 3}


def finding(ordinal: int, id: str, name: str, severity: str | Column, confidence: float | Column, evidence: Column, present: Column, *, category: str = "text", removable: bool = True, removal: str = "") -> Column:
    """A finding as a struct, null where it is not present."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = (lit(ordinal).cast("int"), lit(id), lit(category), lit(name), lit(severity), lit(confidence).cast("double"), evidence.cast("string"), lit(removable), lit(removal))
    return F.when(present, F.struct(*[v.alias(c) for v, c in zip(values, COLUMNS, strict=True)]))


def to_long(df: DataFrame, keys: list[str], found: list[Column]) -> DataFrame:
    """keys and the findings present, one row each."""
    return df.select(*keys, F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select(*keys, "f.*")


def severity_ranks(df: DataFrame) -> DataFrame:
    """The severities and their order, four rows."""
    return df.sparkSession.createDataFrame(list(RANKS.items()), "severity string, rank int")


def compare(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, in_before, in_after, status (removed, remained, introduced): a full outer join of two findings tables."""
    a = before.select(*keys, "id").distinct().withColumn("in_before", F.lit(True))
    b = after.select(*keys, "id").distinct().withColumn("in_after", F.lit(True))
    both = a.join(b, [*keys, "id"], "full_outer").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_before", "in_after")})
    return both.withColumn("status", F.when(F.col("in_before") & F.col("in_after"), "remained").when(F.col("in_before"), "removed").otherwise("introduced"))
