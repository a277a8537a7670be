"""Sharding by histogram sort: splitters from exact byte counts below refined probes, then one exchange.

DataFrame functions only; the driver sees histograms of at most ``probes`` rows for each splitter and round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import among_equals, discard, written

#: Keys are 62-bit numbers, so that differences and sums of two stay within a long.
KEY_BITS = 62
TOP = (1 << KEY_BITS) - 1


def key62(*cols: str | Column, seed: int = 0) -> Column:
    """A 62-bit hash of columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols]), 64 - KEY_BITS)


@dataclass
class _Search:
    """One splitter's search: bytes wanted below it, and the interval (low, high] of the first key, or, once group is
    set, of the second key within that value of the first. below: bytes up to low."""

    wanted: float
    low: int = -1
    high: int = TOP
    below: int = 0
    group: int | None = None
    found: tuple[int, int] | None = None


def splitters(keyed: DataFrame, shards: int, total: int, tolerance: float = 0.001, probes: int = 512, first: str = "k1", second: str = "k2", size: str = "size") -> list[tuple[int, int]]:
    """Upper bounds (first key, second key) of shards 0 to shards - 2.

    Every round counts the bytes in ``probes`` equal steps of each open interval, in one aggregation that is combined
    before its shuffle, and narrows each interval to the step that holds the wanted byte count. A splitter is found when
    its bytes are within tolerance of a shard from the target, or nothing is left to divide; a first key that alone is
    too heavy (a large group of copies) is divided by the second key. With 512 probes ten thousand million rows take
    about four rounds.
    """
    near = tolerance * total / shards
    searches = [_Search(total * j / shards) for j in range(1, shards)]
    while open_ones := [s for s in searches if s.found is None]:
        spans = sorted({(s.group if s.group is not None else -1, s.low, s.high) for s in open_ones})
        number, step_no, key = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
        for i, (group, low, high) in enumerate(spans):
            k = F.col(first if group < 0 else second)
            inside = (k > low) & (k <= high)
            if group >= 0:
                inside &= F.col(first) == group
            step = -(-(high - low) // probes)
            number = F.when(inside, F.lit(i)).otherwise(number)
            step_no = F.when(inside, F.floor((k - F.lit(low + 1)) / F.lit(step)) if step <= 1 << 20 else F.expr(f"({first if group < 0 else second} - {low + 1}L) div {step}L")).otherwise(step_no)
            key = F.when(inside, k).otherwise(key)
        rows = (
            keyed.select(number.alias("i"), step_no.cast("long").alias("b"), key.alias("k"), F.col(size).alias("size"))
            .where("i is not null")
            .groupBy("i", "b")
            .agg(F.sum("size").alias("bytes"), F.min("k").alias("least"), F.max("k").alias("most"))
            .collect()
        )
        tables: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["i"], r["b"])):
            tables.setdefault(r["i"], []).append(r)
        for s in open_ones:
            at = s.below
            inside = tables.get(spans.index((s.group if s.group is not None else -1, s.low, s.high)), [])
            for n, r in enumerate(inside):
                upto = at + r["bytes"]
                if upto < s.wanted and n + 1 < len(inside):
                    at, s.low = upto, r["most"]
                    continue
                single = r["least"] == r["most"]
                before, after = abs(s.wanted - at), abs(s.wanted - upto)
                if min(before, after) <= near or (single and s.group is not None):
                    edge = r["most"] if after <= before else s.low
                    s.found = (edge, TOP) if s.group is None else (s.group, edge)
                elif single:
                    s.group, s.low, s.high, s.below = r["least"], -1, TOP, at
                else:
                    s.low, s.high, s.below = r["least"] - 1, r["most"], at
                break
            else:
                s.found = (s.low, TOP) if s.group is None else (s.group, s.low)
    return [s.found for s in searches]


def shard_of(bounds: list[tuple[int, int]], first: str = "k1", second: str = "k2") -> Column:
    """Number of splitters below a row."""
    out = F.lit(0)
    for a, b in bounds:
        out = out + F.when((F.col(first) > F.lit(a)) | ((F.col(first) == F.lit(a)) & (F.col(second) > F.lit(b))), 1).otherwise(0)
    return out.cast("int")


def with_slots(rows: DataFrame, shard: str = "shard", spread: str = "k2", order: tuple[str, ...] = ("k1", "k2"), n: int | None = None, cell_rows: int = 20_000) -> DataFrame:
    """rows with slot, gapless from 0 in each shard.

    A shard is numbered in cells, by the leading bits of a uniform hash, so that no task holds a whole shard and no group
    of copies meets in one cell. Cell counts (a few numbers for each 20,000 rows) give each cell's first slot.
    """
    n = rows.count() if n is None else n
    bits = max(4, min(40, (max(1, n) // cell_rows).bit_length()))
    celled = rows.withColumn("__cell", F.shiftrightunsigned(F.col(spread), KEY_BITS - bits))
    counts = celled.groupBy(shard, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(shard).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__cell", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    placed = celled.withColumn("__row", F.row_number().over(Window.partitionBy(shard, "__cell").orderBy(*order)))
    return placed.join(starts, [shard, "__cell"]).withColumn("slot", (F.col("__start") + F.col("__row") - 1).cast("long")).drop("__cell", "__row", "__start")


def shard_by_bytes(rows: DataFrame, shards: int, group: str | Column, spread: str | Column, size: str, tolerance: float = 0.001) -> DataFrame:
    """rows with shard and slot so that the shards' sums of size are nearly equal.

    group: rows of one value lie side by side, hence in one shard unless a splitter must divide them. spread tells the
    rows of a group apart; rows equal in both are told apart by a number, so that even a table of equal rows is divided
    row by row. Nulls are values like any other; a null size counts as 0. Columns of rows named shard or slot are
    replaced; all others come back as they are, whatever their names. An empty table gives an empty result.
    """
    rows = rows.drop("shard", "slot")
    names = rows.columns
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row_of"), key62(group, seed=1).alias("__k1"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("__size"), F.xxhash64(F.lit(2), *[F.col(c) if isinstance(c, str) else c for c in (group, spread)]).alias("__both"))
    held = written(held, "digests")
    told = among_equals(held, "__both")
    keyed = written(told.withColumn("__k2", key62("__both", "__nth", seed=2)).drop("__both", "__nth"), "keys")
    discard(held)
    seen = keyed.agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("total")).first()
    bounds = splitters(keyed, shards, seen["total"] or 0, tolerance, first="__k1", second="__k2", size="__size") if seen["n"] else []
    placed = with_slots(keyed.withColumn("shard", shard_of(bounds, "__k1", "__k2")), spread="__k2", order=("__k1", "__k2"), n=seen["n"])
    return placed.select(*[F.col("__row_of").getField(c).alias(c) for c in names], "shard", "slot")


def digest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, size (UTF-8 bytes + 1; null: 1) and text_crc32 (null: 0), the narrow rows that sharding moves."""
    return docs.select(
        id_col,
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
    )


