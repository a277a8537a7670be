"""Documents with one kind of mark each, the same in Spark and in DuckDB: the raw tables hold no marks at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_PAYLOAD = "".join(chr(0xE0000 + ord(c)) for c in "id=173")

MARKED = f"""
SELECT doc_id, lang, source, CASE doc_id % 14
    WHEN 0 THEN replace(text, '. ', '.\u200b ')
    WHEN 1 THEN concat(text, '\u202e')
    WHEN 2 THEN replace(text, 'a', 'a\ufe01')
    WHEN 3 THEN concat(text, '{_PAYLOAD}')
    WHEN 4 THEN replace(text, ' ', '\u00a0')
    WHEN 5 THEN replace(text, 'en', 'e\u00adn')
    WHEN 6 THEN replace(text, 'an', '\u0430n')
    WHEN 7 THEN concat('\ue001', text)
    WHEN 8 THEN concat(replace(text, chr(10), concat('  ', chr(10))), '  ')
    WHEN 9 THEN replace(text, '. ', '.  ')
    WHEN 10 THEN concat('\u201c', text, '\u201d\u2014\u2026')
    WHEN 11 THEN concat(text, ' \U0001f468\u200d\U0001f469')
    ELSE text END AS text
FROM documents"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, text with a mark chosen by doc_id modulo 14."""
    return spark.sql(MARKED.replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
