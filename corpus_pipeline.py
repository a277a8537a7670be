"""A corpus pipeline of five stages, each calling one operator of sigtrace.llm on all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtrace.llm import langid, mixing, packing, simhash, toxicity
from sigtrace.llm.common import discard, fold, maybe_in, release, trim, written
from sigtrace.llm.tokens import vocabulary


def _inner(docs: DataFrame, name: str) -> str:
    return f"__c{docs.columns.index(name)}"


def _own_names(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs under names that no operator adds, and the columns that give them their own names back."""
    names = docs.columns
    return docs.toDF(*[_inner(docs, c) for c in names]), [F.col(_inner(docs, c)).alias(c) for c in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter, or like none of the languages learned.

    Learns from the rows of docs with a language whose crc32(doc_id) modulo 3 is not 1. Null and empty texts have no letter
    and go; null ids and repeated rows are judged by their text alone; with no language to learn from all go.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang").where(fold("doc_id", 3) != 1))
    trim()
    inner, back = _own_names(docs)
    return langid.identify(inner, model, _inner(docs, "text")).where(~F.col("lang_rejected")).select(*back)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.3 or more for toxicity; learns from labels whose crc32(doc_id) modulo 4 is not 2.

    Every row is scored, null and empty texts too; repeated rows share their fate. Without labels all score about 0 and stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2)
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    trim()
    inner, back = _own_names(docs)
    return toxicity.toxicity(inner, model, _inner(docs, "text")).where("toxic = 0").select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies.

    SimHash links texts whose fingerprints of three-word shingles differ in two bits at most, as op9 does; what that leaves
    apart is compared exactly, and links at similarity 0.8 on shingles of five words too.
    Rows that repeat both id and text of a group's kept document are further copies of it and go too. Of rows that share an
    id but not their text, each goes or stays by its own text.
    """
    names = docs.columns
    groups = simhash.similar_rows(docs, distance=2)
    rows = groups.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("keeper").alias("keeper"))
    unsure = written(rows.where("n > 1 or row <> keeper").select(F.col("row").alias("__row"), (F.col("row") == F.col("keeper")).alias("__stays")), "unsure")
    discard(groups)
    # Most rows are surely not among those that go or repeat; their texts need not move.
    marked = docs.withColumn("__row", simhash.row_key(simhash.own_id(), "text")).withColumn("__maybe", maybe_in(unsure, "__row")(F.col("__row")))
    alone = marked.where(~F.col("__maybe"))
    looked = marked.where("__maybe").join(unsure, "__row", "left")
    sure, once = looked.where("__stays is null"), looked.where("__stays").dropDuplicates(["__row"])
    return alone.select(*names).unionByName(sure.select(*names)).unionByName(once.select(*names))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights: a row for each time a document is taken, so some repeat, some go.

    Rows are written by output shard and within it by shuffle key, the order of the local shuffle. Null ids, null sources
    and repeated rows are rows like any other; texts of no word count nothing towards a target.
    """
    return mixing.mix(docs).orderBy("out_shard", "shuffle_key").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row of the mix in sequences of at most 2048 ids; a row that the mix repeats is packed as often."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 2048, 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("toxicity", toxic),
    ("near_copies", near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can express neither the learned models nor the hashes; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), name)
        discard(docs)  # the documents themselves are no table of ours and stay
        docs = done
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
