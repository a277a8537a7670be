"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over exact block quotas."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among_equals, discard, row_hash, written
from .sharding import KEY_BITS, key62

#: A source's permuted order is cut into 2**CELL_BITS blocks at most, and into fewer if a block had less than BLOCK_ROWS rows.
CELL_BITS, BLOCK_ROWS = 10, 32
WEIGHTS = (1, 2, 3)


def word_count(text: str):
    """Number of runs of characters that are not ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, most: float = 3.0, weights: tuple[float, ...] = WEIGHTS) -> dict:
    """Target of each source: its weight's part of all sizes, at most ``most`` times its own size.

    Sources go by code point, null last, and weigh 1, 2, 3, repeating. What a source cannot take is shared among the
    others by weight until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, out, free = float(sum(sizes.values())), {}, list(order)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
    return out


def splitting_tree(quotas: np.ndarray, leaves: int, rng: np.random.Generator) -> np.ndarray:
    """(leaves, kinds): how many draws of each kind go to each output shard; exact in both directions.

    A node splits its quotas between its halves by one multivariate-hypergeometric draw; leaves differ by one draw at
    most. A kind is a pass over a source.
    """
    if leaves == 1:
        return quotas[None]
    left = leaves // 2
    total = int(quotas.sum())
    want = total * left // leaves
    taken = rng.multivariate_hypergeometric(quotas, want, method="marginals") if total else np.zeros_like(quotas)
    return np.concatenate([splitting_tree(taken, left, rng), splitting_tree(quotas - taken, leaves - left, rng)])


@dataclass
class SourcePlan:
    """One source: its size and target, the bits of a block's number, for each pass the output shard that draws each block
    (-1: none), and the block that the target cuts with the last place in it that is taken."""

    source: str | None
    size: int
    target: float
    bits: int
    passes: list[list[int]]
    cut: int
    upto: int


def leaf_draws(free: int, quotas: np.ndarray) -> list[tuple[range, range]]:
    """For each leaf the blocks it draws, and those it leaves, out of free permuted blocks in a row.

    The blocks that no leaf draws are spread evenly over the leaves, so a leaf's place in the order, and with it the
    blocks it draws, follow from the quotas of all leaves before it.
    """
    spare, at, out = free - int(quotas.sum()), 0, []
    for i, q in enumerate(quotas.tolist()):
        left = spare * (i + 1) // len(quotas) - spare * i // len(quotas)
        out.append((range(at, at + q), range(at + q, at + q + left)))
        at += q + left
    return out


def plan(sized: DataFrame, shards: int = 16, seed: int = 17, source: str = "source", size: str = "size", order: str = "__order") -> list[SourcePlan]:
    """What each output shard draws of each source, from sized(source, size, __order: a 62-bit permutation).

    One aggregation gives the words and rows of each source's blocks. A source's quota is all its blocks in each whole
    pass and, in the partial one, the share of them that its target asks for; the tree deals these quotas to the output
    shards, and every shard draws its blocks of the permuted order. Drawn blocks hold about the words wanted: a source
    that is short takes blocks that its shards left, one that is over gives back the last it drew, and the block in which
    the target falls is cut between two documents. That block alone is read again, in 256 cells a round.

    Only sums by source and block (2**CELL_BITS a source at most) reach the driver; the number of sources must be bounded
    (they are the mix's parameters).
    """
    cell = F.shiftright(F.col(order), KEY_BITS - CELL_BITS).cast("int")
    rows = sized.groupBy(source, cell.alias("cell")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    words: dict[str | None, np.ndarray] = {}
    count: dict[str | None, int] = {}
    for r in rows:
        words.setdefault(r[source], np.zeros(1 << CELL_BITS, np.int64))[r["cell"]] += r["size"]
        count[r[source]] = count.get(r[source], 0) + r["n"]
    names = sorted(words, key=lambda s: (s is None, s or ""))
    total = {s: int(words[s].sum()) for s in names}
    goal = targets(total)
    rng = np.random.default_rng(seed)
    plans, kinds, quotas = [], [], []
    for k, s in enumerate(names):
        bits = max(0, min(CELL_BITS, (count[s] // BLOCK_ROWS).bit_length() - 1))
        blocks = words[s] = words[s].reshape(1 << bits, -1).sum(axis=1)
        whole = min(3, int((goal[s] + 1e-6) // total[s])) if total[s] else 0
        want = goal[s] - whole * total[s]
        partial = total[s] > 0 and whole < 3 and want >= 0.5
        plans.append(SourcePlan(s, total[s], float(goal[s]), bits, [], -1, -1))
        for p in range(whole + partial):
            kinds.append((k, p < whole))
            quotas.append(len(blocks) if p < whole else min(len(blocks), round(want / total[s] * len(blocks))))
    leaf = splitting_tree(np.array(quotas, np.int64), shards, rng) if quotas else np.zeros((shards, 0), np.int64)
    cuts: dict[str | None, float] = {}
    for i, (k, whole) in enumerate(kinds):
        p, s = plans[k], names[k]
        blocks, owner = words[s], [-1] * len(words[s])
        dealt = leaf_draws(len(blocks), leaf[:, i])
        drawn = [(b, shard) for shard, (mine, _) in enumerate(dealt) for b in mine]
        for b, shard in drawn:
            owner[b] = shard
        if not whole:
            want = p.target - (p.target + 1e-6) // p.size * p.size
            have = float(blocks[[b for b, _ in drawn]].sum())
            spare = iter([(b, shard) for shard, (_, rest) in enumerate(dealt) for b in rest])
            while have > want:  # the last drawn goes back, and is cut if the target falls inside it
                b, shard = drawn.pop()
                have -= blocks[b]
                owner[b] = -1
                if have <= want:
                    p.cut, owner[b], cuts[s] = b, shard, want - have
            while p.cut < 0 and have < want and (more := next(spare, None)):
                b, shard = more
                if have + blocks[b] <= want:
                    have, owner[b] = have + blocks[b], shard
                else:
                    p.cut, owner[b], cuts[s] = b, shard, want - have
        p.passes.append(owner)
    for p in plans:
        if p.cut >= 0:
            p.upto = (p.cut << KEY_BITS - p.bits) - 1  # nothing of the block, until _cut finds more
    _cut(sized, {p.source: p for p in plans if p.cut >= 0}, cuts, source, size, order)
    return plans


def _cut(sized: DataFrame, plans: dict, want: dict, source: str, size: str, order: str) -> None:
    """Sets upto of each plan: the last place of its cut block that is taken, so that the words come nearest to want."""
    low, width = {s: p.cut << KEY_BITS - p.bits for s, p in plans.items()}, {s: 1 << KEY_BITS - p.bits for s, p in plans.items()}
    have, active = dict.fromkeys(plans, 0), set(plans)
    while active:
        floor, step = F.lit(None).cast("long"), F.lit(None).cast("long")
        for s in sorted(active, key=str):
            width[s] = max(1, width[s] >> 8)
            here = F.col(source).eqNullSafe(F.lit(s))
            floor, step = F.when(here, F.lit(low[s])).otherwise(floor), F.when(here, F.lit(width[s])).otherwise(step)
        cells = sized.select(source, size, F.col(order).alias("__o"), floor.alias("__low"), step.alias("__step")).where("__low is not null and __o >= __low")
        cells = cells.withColumn("__cell", F.expr("(__o - __low) div __step")).where("__cell < 256")
        found: dict = {}
        for r in cells.groupBy(source, "__cell").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).collect():
            found.setdefault(r[source], []).append((r["__cell"], r["size"], r["n"]))
        for s in list(active):
            inside = False
            for at, words, n in sorted(found.get(s, [])):
                last = low[s] + (at + 1) * width[s] - 1
                if have[s] + words <= want[s]:
                    have[s] += words
                    plans[s].upto = last
                elif n == 1 or width[s] == 1:
                    if have[s] + words - want[s] < want[s] - have[s]:
                        plans[s].upto = last
                    break
                else:
                    low[s], inside = low[s] + at * width[s], True
                    plans[s].upto = max(plans[s].upto, low[s] - 1)
                    break
            if not inside:
                active.discard(s)


def _placed(docs: DataFrame, seed: int, source: str, text_col: str, key: tuple[str, ...]) -> DataFrame:
    """docs with __order: a row's place in its source's permuted order. Rows equal in key, source and text get places of
    their own, and any of them may get any of these, so that reruns agree."""
    told = among_equals(docs.withColumn("__same", row_hash(*key, source, text_col, seed=seed)), "__same")
    return told.withColumn("__order", key62("__same", "__nth", seed=seed)).drop("__same", "__nth")


def _drawn(placed: DataFrame, plans: list[SourcePlan], source: str) -> DataFrame:
    """placed rows with source_size, target, copies and draws by the plans of their sources."""
    schema = "__source string, source_size long, target double, __bits int, __passes array<array<int>>, __cut int, __upto long"
    table = placed.sparkSession.createDataFrame([(p.source, p.size, p.target, p.bits, p.passes, p.cut, p.upto) for p in plans], schema)
    # A row for each source, the mix's parameters: at most 3 * 2**CELL_BITS numbers each.
    rows = placed.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("__source")), "left")
    rows = rows.withColumn("__block", F.expr(f"cast(shiftright(__order, {KEY_BITS} - __bits) as int)"))
    drawn = F.expr(
        """filter(transform(__passes, (owner, p) -> struct(cast(p as int) as pass,
            case when p = size(__passes) - 1 and __block = __cut and __order > __upto then -1 else owner[__block] end as shard)), d -> d.shard >= 0)"""
    )
    rows = rows.withColumn("draws", F.coalesce(drawn, F.expr("cast(array() as array<struct<pass:int,shard:int>>)")))
    return rows.withColumn("copies", F.size("draws")).drop("__source", "__bits", "__passes", "__cut", "__upto", "__block")


def mixed(docs: DataFrame, shards: int = 16, seed: int = 17, source: str = "source", text_col: str = "text", key: tuple[str, ...] = ("doc_id",), narrow: bool = False) -> DataFrame:
    """docs with size, source_size, target, copies and draws (pass, output shard): how often the mix takes each row.

    Every row of docs comes back once, whether taken or not; narrow leaves only key and source of its own columns, and
    then texts are read once. A source's documents lie in a permuted order of blocks; which of them an output shard draws
    follows from the quotas that the splitting tree dealt it, so shards are disjoint, and another seed takes other rows. A
    row is taken at most three times. Reruns agree, also on a table read in other parts. Columns of the five new names are
    replaced. Null sources are one source, null and empty texts have size 0 and any length is counted whole; rows that
    repeat others or lack a key have places of their own. An empty table gives an empty result.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "draws", "__order")
    names = docs.columns
    measured = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*key, source])], word_count(text_col).alias("size"), row_hash(*key, source, text_col, seed=seed).alias("__same"))
    measured = written(measured, "measured")
    told = among_equals(measured, "__same")
    sized = written(told.withColumn("__order", key62("__same", "__nth", seed=seed)).drop("__same", "__nth"), "sizes")
    discard(measured)
    plans = plan(sized, shards, seed, source)
    if narrow:
        return _drawn(sized, plans, source)
    discard(sized)
    rows = _placed(docs.withColumn("size", word_count(text_col)), seed, source, text_col, key)
    return _drawn(rows, plans, source).select(*[F.col(f"`{c}`") for c in names], "size", "source_size", "target", "copies", "draws")


def mix(docs: DataFrame, shards: int = 16, seed: int = 17, source: str = "source", text_col: str = "text", key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The mix itself: docs' columns, out_shard and shuffle_key, one row for each time a document is taken.

    Writing it partitioned by out_shard and sorted by shuffle_key within tasks is the local shuffle. Columns of the two new
    names are replaced, all others kept, whatever their names; the rest is as in mixed().
    """
    names = [c for c in docs.columns if c not in ("out_shard", "shuffle_key")]
    inner = {c: f"__own_{i}" for i, c in enumerate(names) if c in ("size", "source_size", "target", "copies", "draws")}
    drawn = mixed(docs.withColumnsRenamed(inner), shards, seed, source, text_col, key).withColumnRenamed("draws", "__drawn")
    drawn = drawn.drop("size", "source_size", "target", "copies").withColumnsRenamed({v: k for k, v in inner.items()})
    drawn = drawn.select(*[F.col(f"`{c}`") for c in names], F.explode("__drawn").alias("__draw"))
    return drawn.select(*[F.col(f"`{c}`") for c in names], F.col("__draw.shard").alias("out_shard"), F.xxhash64(F.lit(seed), F.col("__draw.pass"), *[F.col(c) for c in key]).alias("shuffle_key"))
