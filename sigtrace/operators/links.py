"""Links that track their readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of an address that tell of tracking, beside a query string.
TRACKERS = "utm_|track|pixel|1x1|beacon"


def is_tracked(url: Column) -> Column:
    return F.contains(url, F.lit("?")) | url.rlike(f"(?i)({TRACKERS})")


def strip_query(url: Column) -> Column:
    """The address up to its query string."""
    return F.substring_index(url, "?", 1)


def tracked_links(pages: DataFrame, url: str = "url") -> DataFrame:
    """Rows of pages whose address is tracked; null addresses are not."""
    return pages.where(is_tracked(F.col(url)))
