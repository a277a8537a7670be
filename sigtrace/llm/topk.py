"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, lean, written

#: Rows in a block of candidates and of queries; a pair of blocks is one step of the search.
CANDIDATES, QUERIES = 2048, 512
#: Segments at each resolution, coarse to fine, as shares of the components (the last is followed by exact products).
LEVELS = (1 / 8, 1 / 2, 3 / 4)
#: Rows sampled of each vector length, and bytes of all that is sampled; lengths beyond it go without turn and floor.
SAMPLED, SAMPLED_BYTES = 2048, 64 << 20


def usable(vector: str | Column) -> Column:
    """Not null, not empty, every component there and finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False))


def quantised(vector: str | Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as a double, as longs."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale))


def blocks_of(rows: DataFrame, size: int = CANDIDATES) -> DataFrame:
    """rows(id long, q array<long>, asks boolean) packed into blocks: (dim, nums, ids, q, asks) of at most size rows, as bytes.

    nums are numbers of the rows, rising in a block. A block holds vectors of one length. Blocks are cut within each task;
    nothing is shuffled.
    """
    bounded_batches(rows.sparkSession)

    def pack(batches):
        held: dict[int, list[list]] = {}
        at = TaskContext.get().partitionId() << 40

        def out(dim):
            nums, ids, q, asks = held.pop(dim)
            made = [np.array(nums, "<i8"), np.array(ids, "<i8"), np.array(q, "<i8"), np.array(asks, np.uint8)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([m.tobytes()]) for m in made)], names=["dim", "nums", "ids", "q", "asks"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "q", "asks")), strict=True):
                parts = held.setdefault(len(row[1]), [[], [], [], []])
                for part, value in zip(parts, (at, *row), strict=True):
                    part.append(value)
                at += 1
                if len(parts[0]) == size:
                    yield out(len(row[1]))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(lean(pack), "dim int, nums binary, ids binary, q binary, asks binary")


@dataclass
class Turn:
    """An orthogonal turn of the components and where the segments of each level begin. Products do not change by a turn,
    so any turn gives valid bounds; one that gathers energy in few components gives sharp ones."""

    matrix: np.ndarray | None
    cuts: list[np.ndarray]

    def levels(self, x: np.ndarray) -> list[np.ndarray]:
        return summaries(x if self.matrix is None else x @ self.matrix, self.cuts)


def plain_turn(dim: int) -> Turn:
    return Turn(None, [by_energy(np.ones(dim), max(1, int(dim * share))) for share in LEVELS])


def fitted_turn(x: np.ndarray) -> Turn:
    """Principal directions of the rows of x, most energy first, and segments of about equal energy."""
    energy, matrix = np.linalg.eigh(x.T @ x / max(1, len(x)))
    energy, matrix = np.maximum(energy[::-1], 0), np.ascontiguousarray(matrix[:, ::-1])
    return Turn(matrix, [by_energy(energy + 1e-12 * (energy[0] + 1), max(1, int(x.shape[1] * share))) for share in LEVELS])


def by_energy(energy: np.ndarray, n: int) -> np.ndarray:
    """Starts of n segments of components that hold about equal parts of the energy, one component at least."""
    total, starts = np.cumsum(energy) / energy.sum(), [0]
    for k in range(1, n):
        starts.append(min(max(int(np.searchsorted(total, k / n - 1e-9)) + 1, starts[-1] + 1), len(energy) - n + k))
    return np.array(starts)


def summaries(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """For each level, a row per vector whose products bound the inner product from above.

    In a segment of n components the inner product of x and y is n times the product of their means plus that of the
    deviations, which is at most n times the product of the standard deviations (Cauchy-Schwarz); the same sums bound the
    distance from below. Rows hold sqrt(n) * mean and sqrt(n) * deviation of every segment; a segment of one component has
    no deviation, so its part is exact.
    """
    out = []
    for starts in cuts:
        n = np.diff(np.append(starts, x.shape[1]))
        mean = np.add.reduceat(x, starts, axis=1) / n
        wide = n > 1
        var = np.maximum(np.add.reduceat(x * x, starts, axis=1) / n - mean**2, 0)[:, wide]
        out.append(np.concatenate([np.sqrt(n) * mean, np.sqrt(n[wide] * var)], axis=1))
    return out


#: Where more of the pairs than this are left, one matrix product is cheaper than products of single pairs.
DENSE = 0.05


def _refined(alive: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of the pairs alive, those whose bound at this resolution reaches the query's floor."""
    if alive.mean() > DENSE:
        return alive & (a @ b.T >= low[:, None])
    out = np.zeros_like(alive)
    i, j = np.nonzero(alive)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        keep = np.einsum("nd,nd->n", a[i[s]], b[j[s]]) >= low[i[s]]
        out[i[s][keep], j[s][keep]] = True
    return out


def _dots(q: np.ndarray, c: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Exact integer products of the pairs alive, in the order of nonzero()."""
    i, j = np.nonzero(alive)
    size = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if alive.mean() > DENSE and size < 2**52:  # sums of whole numbers this small are exact in doubles
        return (q.astype(np.float64) @ c.astype(np.float64).T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = np.einsum("nd,nd->n", q[i[s]], c[j[s]])
    return out


def survivors(queries: np.ndarray, rows: np.ndarray, low: np.ndarray, turn: Turn) -> list[np.ndarray]:
    """After each resolution, which pairs can still reach their query's floor; the last are to be computed exactly."""
    q, c = queries.astype(np.float64), rows.astype(np.float64)
    # What rounding may take from a bound, which is a sum of that many products.
    low = low - 1e-9 * (np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max(initial=1.0) + 1) - 1e-6
    out = [np.ones((len(q), len(c)), bool)]
    for a, b in zip(turn.levels(q), turn.levels(c), strict=True):
        out.append(_refined(out[-1], a, b, low))
    return out[1:]


def best(query_nums: np.ndarray, queries: np.ndarray, nums: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray, turn: Turn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of all candidates that can be among a query's k best here.

    floor: scores that k other candidates of a query are known to reach; rows below it are left out. A row is not its own
    candidate; nums must rise.
    """
    alive = survivors(queries, rows, floor, turn)[-1]
    own = np.searchsorted(nums, query_nums)
    mine = np.flatnonzero((own < len(nums)) & (nums[np.minimum(own, len(nums) - 1)] == query_nums))
    alive[mine, own[mine]] = False
    i, j = np.nonzero(alive)
    score = _dots(queries, rows, alive)
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = (place < k) & (score >= floor[i])
    return i[keep], j[keep], score[keep]


def floors(query_nums: np.ndarray, queries: np.ndarray, nums: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each query among some candidates, itself left out; minus infinity with fewer than k."""
    low = np.full(len(queries), -np.inf)
    size = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1])
    if len(rows) <= k or size >= 2**52:
        return low
    score = queries.astype(np.float64) @ rows.astype(np.float64).T
    score[query_nums[:, None] == nums[None]] = -np.inf
    return -np.partition(-score, k - 1, axis=1)[:, k - 1]


def _sample(cands: DataFrame) -> dict[int, tuple[Turn, np.ndarray, np.ndarray]]:
    """For the most frequent vector lengths a turn, and numbers and vectors of a block; SAMPLED_BYTES in all at most."""
    sizes = cands.groupBy("dim").agg(F.sum(F.length("asks")).alias("n"), F.max(F.length("asks")).alias("most"), F.min_by(F.crc32("nums"), F.struct(-F.length("asks"), F.crc32("nums"))).alias("block")).orderBy(F.col("n").desc(), "dim").limit(64).collect()
    out, room = {}, SAMPLED_BYTES
    for r in sizes:
        room -= 8 * r["dim"] * (r["dim"] + r["most"])
        if room < 0:
            break
        row = cands.where((F.col("dim") == r["dim"]) & (F.crc32("nums") == r["block"]) & (F.length("asks") == r["most"])).first()
        x = np.frombuffer(row["q"], "<i8").reshape(-1, r["dim"])
        out[r["dim"]] = (fitted_turn(x.astype(np.float64)), np.frombuffer(row["nums"], "<i8"), x)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row against all other rows.

    Ties go to the smaller id; a query with fewer than k candidates gets all. Rows with a null id, a null or empty vector
    or components that are null or not finite take no part, and vectors meet only those of their own length. A row is
    never its own candidate; other rows that repeat its id or its vector are, and a query id that repeats is answered once
    for each of its rows. An empty table gives an empty result; other columns are not read.

    Candidate and query blocks are bounded; every query block meets every candidate block once, which is the stated query
    set against all rows, and each meeting yields at most k rows a query. A block of sampled candidates gives each query a
    floor, and gives the turn that sharpens the bounds; neither changes a result.
    """
    good = vectors.where(usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised(vector, scale).alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    spark = vectors.sparkSession
    cands = written(blocks_of(good), "candidates")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = spark.sparkContext.broadcast(_sample(cands))

    def arrays(row, dim, *names):
        nums, ids, q = (np.frombuffer(row[n], "<i8") for n in names)
        return nums, ids, q.reshape(len(ids), dim)

    def asking(batches):
        for b in batches:
            for row in b.to_pylist():
                nums, ids, q = arrays(row, row["dim"], "nums", "ids", "q")
                at = np.flatnonzero(np.frombuffer(row["asks"], np.uint8))
                for lo in range(0, len(at), QUERIES):
                    some = at[lo : lo + QUERIES]
                    low = np.full(len(some), -np.inf)
                    if row["dim"] in held.value:
                        _, others, x = held.value[row["dim"]]
                        low = floors(nums[some], q[some], others, x, k)
                    made = [nums[some], ids[some], q[some], low.astype("<f8")]
                    yield pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), *(pa.array([m.tobytes()]) for m in made)], names=["dim", "qnums", "qids", "qq", "floor"])

    def meet(batches):
        for b in batches:
            for row in b.to_pylist():
                dim = row["dim"]
                qn, qi, q = arrays(row, dim, "qnums", "qids", "qq")
                cn, ci, c = arrays(row, dim, "nums", "ids", "q")
                turn = held.value[dim][0] if dim in held.value else plain_turn(dim)
                i, j, s = best(qn, q, cn, c, ci, k, np.frombuffer(row["floor"], "<f8"), turn)
                yield pa.RecordBatch.from_arrays([pa.array(qn[i]), pa.array(qi[i]), pa.array(ci[j]), pa.array(s)], names=["query", "query_id", "vec_id", "score"])

    asks = written(cands.mapInArrow(lean(asking), "dim int, qnums binary, qids binary, qq binary, floor binary"), "queries")
    # Each query block goes to every group of candidate blocks, each candidate block to one of them.
    groups = max(1, min(parts * 4, cands.count()))
    sent = asks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = cands.withColumn("grp", F.pmod(F.xxhash64("nums", "dim"), F.lit(groups)).cast("int")).select("grp", "dim", "nums", "ids", "q")
    found = sent.join(dealt.hint("merge"), ["grp", "dim"]).mapInArrow(lean(meet), "query long, query_id long, vec_id long, score long")
    rank = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    out = written(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "near")
    for t in (asks, cands):
        discard(t)
    return out
