"""Corpus reports over findings: aggregates, cubes, rankings, joins with labels, and what cleaning changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.findings import RANKS, severity_ranks
from ..operators.text import clean_text, verify_cleaning


def by_severity(findings: DataFrame, docs: DataFrame, key: str, by: str) -> DataFrame:
    """Findings by a column of the documents and severity, with the severity's rank; four ranks are broadcast."""
    joined = findings.join(docs.select(key, by), key).join(F.broadcast(severity_ranks(docs)), "severity")
    return joined.groupBy(by, "severity", "rank").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct(key).alias("n_docs"))


def cube(findings: DataFrame, by: str) -> DataFrame:
    return findings.cube(by, "id").agg(F.count(F.lit(1)).alias("n"))


def top_sources(findings: DataFrame, by: str, k: int) -> DataFrame:
    """The k values of by with the most findings of each kind; counts are combined before the ranking's shuffle."""
    counts = findings.groupBy("id", by).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), by))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def worst(findings: DataFrame, key: str, k: int) -> DataFrame:
    """The k records whose findings weigh most, by the sum of their severities' ranks; a top-k report."""
    ranks = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    counts = findings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at(ranks, F.col("severity")).cast("long")).alias("rank"))
    return counts.orderBy(F.col("rank").desc(), F.col("n").desc(), key).limit(k)


def canonical_duplicates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Groups of documents that become one text once cleaned: digest, size of the group, smallest key."""
    cleaned = clean_text(docs, text, actions=False).select(key, F.md5(F.col(text).cast("binary")).alias("digest"))
    return cleaned.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


__all__ = ["RANKS", "by_severity", "canonical_duplicates", "cube", "top_sources", "verify_cleaning", "worst"]
