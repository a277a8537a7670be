"""Functions for SQL users: counts of marks and rules for links as SQL functions, parts of files as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import marks as M

#: Name, argument, result and body of each SQL function; bodies are inlined into the plan, so nothing leaves the JVM.
SCALAR = {
    "zero_width_count": ("t STRING", "INT", f"regexp_count(t, r'[{M.ZERO_WIDTH}]')"),
    "bidi_count": ("t STRING", "INT", f"regexp_count(t, r'[{M.BIDI}]')"),
    "private_use_count": ("t STRING", "INT", f"regexp_count(t, r'[{M.PRIVATE_USE}]')"),
    "unusual_space_count": ("t STRING", "INT", f"regexp_count(t, r'[{M.UNUSUAL_SPACES}]')"),
    "is_tracked_link": ("u STRING", "BOOLEAN", "contains(u, '?') OR u RLIKE r'(?i)(utm_|track|pixel|1x1|beacon)'"),
    "without_query": ("u STRING", "STRING", "substring_index(u, '?', 1)"),
}


def register(spark: SparkSession) -> list[str]:
    """Adds the functions to the session and returns their names.

    ``file_parts(content)`` is a table function: (ordinal, part_type, payload) of a picture's or an archive's bytes, for use
    with LATERAL. A null or unknown content has no rows, a broken one those before the damage.
    """
    for name, (given, kind, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")

    @F.udtf(returnType="ordinal int, part_type string, payload binary")
    class FileParts:
        def eval(self, content: bytes) -> Iterator[tuple[int, str, bytes]]:
            from ..operators import containers

            data = bytes(content or b"")
            reader = containers.zip_parts if data[:2] == b"PK" else containers.image_parts
            try:
                for i, (kind, body) in enumerate(reader(data)):
                    yield i, kind, body
            except containers.DAMAGED:
                return

    spark.udtf.register("file_parts", FileParts)
    return [*SCALAR, "file_parts"]
