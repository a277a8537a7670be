"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_one, lean, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node among it and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node's smaller neighbours, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _joined(batches):
    """All of a few links(u, v) in one task: each node once, with the smallest node reachable."""
    held = [(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while True:
        least = np.minimum(root[a], root[b])
        now = root.copy()
        for end in (a, b):
            np.minimum.at(now, root[end], least)
        while (now != (further := now[now])).any():
            now = further
        if (now == root).all():
            break
        root = now
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "root"])


def components(edges: DataFrame, most_rounds: int = 40, few: int = 0) -> DataFrame:
    """edges(u long, v long), in any direction, repeats allowed -> (node, root), root the smallest node reachable.

    Only nodes with a link to another node appear. Nulls and self links are dropped. Each round is written to the shared
    folder, so that a lost executor costs one round at most; rounds grow with the logarithm of the longest path. Minima
    are combined before each shuffle and a node with very many links is a skewed join that adaptive execution splits.
    Up to few links, repeats counted, are joined in one task instead of rounds, to the same result.
    """
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if few:
        raw = written(now, "links")
        if raw.count() <= few:
            out = written(in_one(raw).mapInArrow(lean(_joined), "node long, root long"), "joined")
            discard(raw)
            return out
        now = written(raw.distinct(), "links")
        discard(raw)
    else:
        now = written(now.distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        after = written(_small_star(_large_star(now)), "links")
        discard(now)
        now = after
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == mark or not seen["n"]:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._written_to = now._written_to  # discard() deletes what it reads
    return out
