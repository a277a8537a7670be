"""The thin queries of the ten operators over the whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, near_vectors, packing, quality, sharding, simhash, token_counts, topk, toxicity
from .common import fold, remove, shared_dir
from .tokens import vocabulary

SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of nearly equal bytes, with a gapless slot. Null texts count 1 byte and checksum 0;
    rows equal in id and text are rows of their own; grown_shard is null, as the law is bytes."""
    rows = sharding.digest(_table(spark, sf_dir, "documents"))
    out = sharding.shard_by_bytes(rows, SHARDS, "text_hash", "doc_id", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, for its source's target. Null texts have size 0, null sources are one
    source; rows that repeat others each have a place in the order. out_shards: the shard of each time it is taken."""
    out = mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), SHARDS, narrow=True)
    taken = (F.col("size") * F.col("copies")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("draws.shard").alias("out_shards"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 its rule alone fixes, so that SQL can ask it: each document's size, its source's size and target."""
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), SHARDS, narrow=True).select("doc_id", "size", "source_size", "target")


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, file_id, ordinal, start: documents written as flat token files, counted by the scan alone, then named."""
    where = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    names = token_counts.write_flat(_table(spark, sf_dir, "documents"), where)
    counts = token_counts.count_tokens(token_counts.flat_files(spark, where, names))
    remove(spark, where)  # what the scan found is a table by now
    return names.select("file_id", "ordinal", "doc_id").join(counts, ["file_id", "ordinal"], "left").select("doc_id", "n_tokens", "file_id", "ordinal", "start")


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text, null and empty ones too, learned from the labels outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    return toxicity.toxicity(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").alias("predicted"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest integer products of each query vector; rows of a null id or an unusable vector take no part."""
    return topk.search(_table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0, k=5)


def op6_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and keeper of every vector, whatever its label; unusable vectors are alone in their component."""
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 ids in sequences; a null or empty text is one piece of the id 0."""
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, 0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text, learned outside the held-out fold; und for null texts and those without a letter."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of three-word shingles and group at two bits of every document; texts without a word have fingerprint 0."""
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=2)
    return out.select("doc_id", simhash.hex16("fingerprint").alias("fingerprint"), "component_id")


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, null and empty ones too, from trusted positives outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return quality.quality(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_histogram_sort, op2_source_mix, op3_separator_scan, op4_toxicity_fm, op5_exact_topk, op6_vector_near_dedup, op7_sum_of_squares_packing, op8_language_id, op9_simhash_near_dedup, op10_quality_pu, mix_targets)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """The others rest on hashes that DuckDB lacks, on learned models, or on choices that only a contract bounds."""
    return {
        "mix_targets": r"""
            WITH RECURSIVE sized AS (
                SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
            ), s AS (
                SELECT source, sum(size) AS size, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM sized GROUP BY source
            ), rounds(n, source, size, w, fixed) AS (
                SELECT CAST(0 AS BIGINT), source, size, w, false FROM s
                UNION ALL
                SELECT n + 1, source, size, w, fixed OR share > 3 * size FROM (
                    SELECT *, (sum(size) OVER () - sum(CASE WHEN fixed THEN 3 * size ELSE 0 END) OVER ()) * w / sum(CASE WHEN fixed THEN 0 ELSE w END) OVER () AS share FROM rounds
                ) WHERE n < (SELECT count(*) FROM s)
            ), last AS (
                SELECT source, size, CASE WHEN fixed THEN 3.0 * size
                    ELSE (sum(size) OVER () - sum(CASE WHEN fixed THEN 3 * size ELSE 0 END) OVER ()) * w / sum(CASE WHEN fixed THEN 0 ELSE w END) OVER () END AS target
                FROM rounds WHERE n = (SELECT max(n) FROM rounds)
            )
            SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(l.size AS BIGINT) AS source_size, CAST(l.target AS DOUBLE) AS target
            FROM sized d JOIN last l ON d.source IS NOT DISTINCT FROM l.source""",
        "op5_exact_topk": """
            WITH numbered AS (SELECT *, row_number() OVER () AS r FROM embeddings), good AS (
                SELECT r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
                FROM numbered
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), scored AS (
                SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
                FROM good a JOIN good b ON a.r <> b.r AND len(a.q) = len(b.q)
                WHERE a.vec_id % 50 = 0
            )
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
                SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored
            ) WHERE rank <= 5""",
        "op6_vector_near_dedup": """
            WITH RECURSIVE good AS (
                SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), links AS (
                SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b
                ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
            ), reach(u, w) AS (
                SELECT vec_id, vec_id FROM embeddings
                UNION
                SELECT r.u, l.w FROM reach r JOIN links l ON r.w = l.u
            )
            SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
            FROM embeddings e
            LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) n ON n.u = e.vec_id
            JOIN (SELECT u, min(w) AS component_id FROM reach GROUP BY u) c ON c.u = e.vec_id""",
    }
