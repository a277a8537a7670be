"""Near duplicates of embeddings: a robust-pruned flat graph over overlapping cluster shards, with range search; an exact
check of the pairs that met in no shard follows."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, lean, release, unit_hash, written
from .components import components
from .topk import usable

#: Most vectors in a shard, rows of a shard sampled for its centroids, and most centroids of one level.
SHARD, SAMPLE, BRANCH = 1500, 8192, 256
DEGREE, BEAM, ALPHA = 24, 40, 1.2
#: Components of the vectors of one part of the exact check; a task holds two parts.
PART = 1 << 20
#: Audit: vectors (in expectation) compared with all others, and the recall that must be reached.
AUDITED, LEAST_RECALL = 256, 0.95


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; large components cannot overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids by Lloyd's rounds on cosine from random rows; on the sphere no centroid lies near all rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the most nearest centroids of each row, nearest first."""
    return np.concatenate([np.argsort(-(x[i : i + 4096] @ c.T), axis=1, kind="stable")[:, :most] for i in range(0, len(x), 4096)])


class Graph:
    """A flat graph of unit vectors, grown by batched insertion: search, robust pruning, reverse links."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, alpha
        self.links = np.full((len(x), degree), -1, np.int32)
        centre = x.mean(axis=0)
        self.medoid = int((x @ centre).argmax())

    def build(self, seed: int = 2) -> Graph:
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate([[self.medoid], order[order != self.medoid]])
        at, size = 1, 1
        while at < n:
            batch = order[at : at + size]
            seen = self.search(batch, self.beam)
            known = order[at - 1 :: -1][: self.degree] if at > 1 else order[:1]  # so that first batches are linked at all
            cand = np.concatenate([seen, np.broadcast_to(known.astype(np.int32), (len(batch), len(known))), np.broadcast_to(batch.astype(np.int32)[None, :DEGREE], (len(batch), min(len(batch), DEGREE)))], axis=1)
            self.links[batch] = self.pruned(batch, cand)
            self.reverse(batch)
            at += size
            size = min(512, max(1, at))
        return self

    def reverse(self, batch: np.ndarray) -> None:
        src = np.repeat(batch, self.degree)
        dst = self.links[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        for lo in range(0, len(targets), 512):
            t = targets[lo : lo + 512]
            w = min(width, int(count[lo : lo + 512].max()))
            place = first[lo : lo + 512, None] + np.arange(w)[None]
            inside = np.arange(w)[None] < count[lo : lo + 512, None]
            new = np.where(inside, src[np.minimum(place, len(src) - 1)], -1).astype(np.int32)
            self.links[t] = self.pruned(t, np.concatenate([self.links[t], new], axis=1))

    def pruned(self, p: np.ndarray, cand: np.ndarray, keep: int = 96) -> np.ndarray:
        """Of each row's candidates, links that no nearer chosen one makes needless: alpha * d(chosen, c) <= d(p, c).

        Half of the places are for the nearest, whatever pruning says, so that a dense group round one vector hangs
        together without it; places left over go to the next nearest."""
        out = np.full((len(p), self.degree), -1, np.int32)
        for lo in range(0, len(p), 256):
            rows, c = p[lo : lo + 256], np.sort(cand[lo : lo + 256], axis=1)
            bad = (c < 0) | (c == rows[:, None])
            bad[:, 1:] |= c[:, 1:] == c[:, :-1]
            sim = np.einsum("pd,pcd->pc", self.x[rows], self.x[c])
            sim[bad] = -np.inf
            order = np.argsort(-sim, axis=1, kind="stable")[:, :keep]
            c, sim = np.take_along_axis(c, order, 1), np.take_along_axis(sim, order, 1)
            far = 2 - 2 * sim
            alive = np.isfinite(sim)
            valid = alive.copy()
            vec, every, rank = self.x[c], np.arange(len(rows)), np.full(c.shape, np.iinfo(np.int32).max)
            for r in range(self.degree):
                pick = alive.argmax(axis=1)
                some = alive[every, pick]
                if not some.any():
                    break
                rank[every[some], pick[some]] = r
                gap = 2 - 2 * np.einsum("pd,pcd->pc", vec[every, pick], vec)
                alive &= ~((self.alpha * gap <= far) & some[:, None])
                alive[every, pick] = False
            rank[:, : self.degree // 2] = -1
            place = np.argsort(np.where(valid, np.minimum(rank, self.degree + np.arange(c.shape[1])[None]), np.iinfo(np.int32).max), axis=1, kind="stable")[:, : self.degree]
            filled = np.where(np.take_along_axis(valid, place, 1), np.take_along_axis(c, place, 1), -1)
            out[lo : lo + 256, : filled.shape[1]] = filled
        return out

    def search(self, queries: np.ndarray, beam: int, least: float | None = None) -> np.ndarray:
        """Greedy beam search from the medoid for each query (rows of x). Without least: the beam's ids (-1 where none).
        With least: a boolean matrix of the rows found at cosine least or more, the search going on from each of them."""
        out = []
        for lo in range(0, len(queries), 256):
            out.append(self._search(queries[lo : lo + 256], beam, least))
        return np.concatenate(out) if out else np.zeros((0, len(self.x)), bool)

    def _search(self, queries: np.ndarray, beam: int, least: float | None) -> np.ndarray:
        m, x = len(queries), self.x
        q = x[queries]
        seen = np.zeros((m, len(x) + 1), bool)
        seen[:, -1] = True
        ids = np.full((m, beam), -1, np.int32)
        sims = np.full((m, beam), -np.inf)
        done = np.ones((m, beam), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = self.medoid, q @ x[self.medoid], False
        seen[:, self.medoid] = True
        hit = np.zeros((m, len(x)), bool) if least is not None else None
        if hit is not None:
            hit[:, self.medoid] = sims[:, 0] >= least
        while True:
            open_sims = np.where(done, -np.inf, sims)
            best = open_sims.argmax(axis=1)
            act = np.flatnonzero(open_sims[np.arange(m), best] > -np.inf)
            if not len(act):
                break
            cur = ids[act, best[act]]
            done[act, best[act]] = True
            near = self.links[cur]
            fresh = ~seen[act[:, None], near]
            seen[act[:, None], near] = True
            s = np.einsum("ad,ard->ar", q[act], x[near])
            s[~fresh] = -np.inf
            if hit is not None:
                a, r = np.nonzero(s >= least)
                hit[act[a], near[a, r]] = True
            all_s = np.concatenate([sims[act], s], axis=1)
            all_i = np.concatenate([ids[act], near], axis=1)
            all_d = np.concatenate([done[act], ~fresh], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[act], ids[act], done[act] = (np.take_along_axis(v, top, 1) for v in (all_s, all_i, all_d))
            done[act] |= ~np.isfinite(sims[act])
        if hit is None:
            return ids
        spread = np.zeros_like(hit)
        while (todo := hit & ~spread).any():
            spread |= todo
            qi, node = np.nonzero(todo)
            for lo in range(0, len(qi), 2048):
                a = np.repeat(qi[lo : lo + 2048], self.degree)
                b = self.links[node[lo : lo + 2048]].ravel()
                new = ~seen[a, b]
                a, b = a[new], b[new]
                if not len(a):
                    continue
                pair = np.unique(a.astype(np.int64) * (len(x) + 1) + b)
                a, b = pair // (len(x) + 1), pair % (len(x) + 1)
                seen[a, b] = True
                good = np.einsum("nd,nd->n", q[a], x[b]) >= least
                hit[a[good], b[good]] = True
        return hit


def _sharded(vectors: DataFrame, overlap: int, cap: int, radius: float) -> DataFrame:
    """vectors(rep, dim, vec binary) -> (shard, rep, vec): every vector in its nearest clusters, none of more than cap.

    Level by level, shards of more than cap rows are cut by centroids fitted on a bounded sample of each; a vector goes
    to the nearest centroid and to up to overlap - 1 others that are at most radius further: of two vectors within radius
    of each other, on either side of a border, one then lies on both sides. Centroids are joined by shard and
    never broadcast. A shard that centroids cannot cut (nearly equal vectors) is dealt into parts by hash that share
    some anchors, so that its parts still hang together. So not every near pair shares a shard; across() has the rest.

    Where a sample shows a group round one vector that would fill a third of a shard, the group goes to shards of its
    own: its rows are dealt into parts by hash, and every two parts make a shard, so that all its pairs meet in one.
    """
    now = written(vectors.select(F.col("dim").cast("long").alias("shard"), "rep", "vec"), "shards")
    for level in range(8):
        sizes = now.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rep").alias("reps")).where(F.col("n") > cap)
        large = written(sizes, "large")
        if large.isEmpty():
            break

        def cut(rows: pd.DataFrame, *, cap=cap, level=level, overlap=overlap, radius=radius) -> pd.DataFrame:
            x = unit(np.stack([np.frombuffer(v, "<f8") for v in rows["vec"]]))
            k = int(min(max(3 * overlap, min(BRANCH, -(-int(rows["n"].iloc[0]) * 3 * overlap // (2 * cap)))), len(x)))
            c = kmeans(x, k)
            hubs, sizes = _hubs(x, int(rows["n"].iloc[0]), cap, radius)
            share = np.bincount(_nearest(x, c, overlap).ravel(), minlength=len(c)).max() / len(x)
            stuck = level >= 6 or share > 0.9
            return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "n": [rows["n"].iloc[0]], "centres": [None if stuck else c.astype("<f8").tobytes()], "hubs": [hubs.astype("<f8").tobytes()], "sizes": [sizes]})

        chosen = now.join(large, "shard").where(unit_hash("rep", seed=level) < F.lit(SAMPLE) / F.col("n"))
        centres = written(chosen.groupBy("shard").applyInPandas(cut, "shard long, n long, centres binary, hubs binary, sizes array<long>"), "centres")
        rows = now.join(centres, "shard", "left")

        def assign(batches, overlap=overlap, cap=cap, radius=radius):
            for b in batches:
                shard, rep, vec, n, cen, hub, size = (b.column(i).to_pylist() for i in range(7))
                out_s, out_i = [], []
                inside, groups = set(), {}
                crowded: dict[int, list[int]] = {}
                for i, s in enumerate(shard):
                    if size[i]:
                        crowded.setdefault(s, []).append(i)
                for s, at in crowded.items():
                    x = unit(np.stack([np.frombuffer(vec[i], "<f8") for i in at]))
                    h = np.frombuffer(hub[at[0]], "<f8").reshape(-1, x.shape[1])
                    dist = np.sqrt(np.maximum(2 - 2 * x @ h.T, 0))
                    for row, i in enumerate(at):
                        for k, d in enumerate(dist[row]):
                            if d <= 1.5 * radius:
                                parts = -(-2 * size[i][k] * 10 // (7 * cap))
                                own = ((rep[i] * 0x9E3779B97F4A7C15 >> 20) & 0xFFFFFFFF) % parts
                                for other in range(parts):
                                    out_s.append(_child(s, -(1 << 20) - (k << 32) - min(own, other) * parts - max(own, other)))
                                    out_i.append(i)
                                if d <= radius:
                                    inside.add(i)
                for i, s in enumerate(shard):
                    if i in inside:
                        continue
                    if n[i] is None:
                        out_s.append(s)
                        out_i.append(i)
                    elif cen[i] is None:
                        parts = -(-int(n[i]) // max(1, cap - 64))
                        h = (rep[i] * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
                        anchor = (h >> 32) % max(1, int(n[i]) // 24) == 0
                        for part in range(parts) if anchor else (h % parts,):
                            out_s.append(_child(s, -1 - part))
                            out_i.append(i)
                    else:
                        groups.setdefault(s, []).append(i)
                for s, at in groups.items():
                    x = unit(np.stack([np.frombuffer(vec[i], "<f8") for i in at]))
                    c = np.frombuffer(cen[at[0]], "<f8").reshape(-1, x.shape[1])
                    near = _nearest(x, c, overlap)
                    dist = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nkd->nk", x, c[near]), 0))
                    for row, i in enumerate(at):
                        for k, v in zip(near[row], dist[row], strict=True):
                            if v <= dist[row, 0] + radius:
                                out_s.append(_child(s, int(k)))
                                out_i.append(i)
                take = pa.array(out_i, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out_s, pa.int64()), b.column(1).take(take), b.column(2).take(take)], names=["shard", "rep", "vec"])

        after = written(rows.select("shard", "rep", "vec", "n", "centres", "hubs", "sizes").mapInArrow(lean(assign), "shard long, rep long, vec binary").distinct(), "shards")
        for t in (now, large, centres):
            discard(t)
        now = after
    return now


def _hubs(x: np.ndarray, n: int, cap: int, radius: float) -> tuple[np.ndarray, list[int]]:
    """Centres of groups too dense for one shard, from a shard's sampled rows x, and how many of the n rows lie near each."""
    some = x[:2048]
    near = 2 - 2 * some @ some.T <= radius**2
    wide = 2 - 2 * some @ some.T <= (1.5 * radius) ** 2
    left, hubs, sizes = np.ones(len(some), bool), [], []
    while len(hubs) < 16:
        degree = (near & left[None]).sum(axis=1) * left
        k = int(degree.argmax())
        if degree[k] * n / len(some) <= cap / 3 or degree[k] < 8:
            break
        hubs.append(some[k])
        sizes.append(max(1, int(wide[k].sum() * n / len(some))))
        left &= ~near[k]
    return (np.stack(hubs) if hubs else np.zeros((0, x.shape[1]))), sizes


def _child(shard: int, k: int) -> int:
    """A number for child k of a shard, far from other shards' numbers."""
    z = (shard * 0x9E3779B97F4A7C15 + (k + 1 << 20) + 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    z ^= z >> 31
    return z - (1 << 64) if z >> 63 else z


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rep").reset_index(drop=True)
    x = unit(np.stack([np.frombuffer(v, "<f8") for v in rows["vec"]]))
    rep = rows["rep"].to_numpy(np.int64)
    links = Graph(x).build().links
    return pd.DataFrame({"rep": rep, "near": [rep[r[r >= 0]].tolist() for r in links]})


def _searched(rows: pd.DataFrame, least: float, beam: int) -> pd.DataFrame:
    """Links of one shard's members: what the search finds, completed by all products of the shard's rows; verified
    cosines, counted where the pair's first common shard is this one."""
    rows = rows.sort_values("rep").reset_index(drop=True)
    here = int(rows["shard"].iloc[0])
    x = unit(np.stack([np.frombuffer(v, "<f8") for v in rows["vec"]]))
    rep, copies = rows["rep"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
    near = [np.searchsorted(rep, np.array(sorted(n), np.int64)) for n in rows["near"]]
    near = [p[(p < len(rep))] if len(p) else p for p in near]
    near = [p[rep[p] == np.array(sorted(n), np.int64)[: len(p)]] if len(p) else p for p, n in zip(near, rows["near"], strict=True)]
    g = Graph(x, degree=max(1, max(map(len, near))))
    for i, p in enumerate(near):
        g.links[i, : len(p)] = p
    hit = g.search(np.arange(len(x)), beam, least)
    for lo in range(0, len(x), 1024):
        hit[lo : lo + 1024] |= x[lo : lo + 1024] @ x.T >= least - 1e-9
    hit |= hit.T
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    sure = np.concatenate([np.einsum("nd,nd->n", x[a[s : s + 65536]], x[b[s : s + 65536]]) >= least for s in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
    a, b = a[sure], b[sure]
    root = np.arange(len(x))
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[low]
        if (low == root).all():
            break
        root = low
    lists = [np.array(sorted(s), np.int64) for s in rows["shards"]]
    several = np.array([len(s) > 1 for s in lists])
    mine = np.ones(len(a), bool)
    if several.any() and len(a):
        width = max(map(len, lists))
        padded = np.full((len(x), width), np.iinfo(np.int64).max)
        for i, s in enumerate(lists):
            padded[i, : len(s)] = s
        check = np.flatnonzero(several[a] & several[b])
        step = max(1, (1 << 22) // width**2)
        for lo in range(0, len(check), step):
            c = check[lo : lo + step]
            pa_, pb = padded[a[c]], padded[b[c]]
            common = (pa_[:, :, None] == pb[:, None, :]).any(axis=2) & (pa_ != np.iinfo(np.int64).max)
            mine[c] = np.where(common, pa_, np.iinfo(np.int64).max).min(axis=1) == here
    links = np.bincount(a[mine], weights=copies[b[mine]], minlength=len(x)).astype(np.int64)
    return pd.DataFrame({"rep": rep, "links": links, "root": rep[root]})


def across(classes: DataFrame, shards: DataFrame, least: float, part: int | None = None) -> DataFrame:
    """(rep, links, root) of the pairs at cosine least or more that share no shard, of all pairs of classes of one length.

    classes(rep, dim, vec, copies) are dealt by hash into parts of about part components, shards(rep, shards) are their
    lists. Every two parts meet in one task, so a row is copied as often as there are parts; products of single
    precision, with room for their rounding, tell which pairs are worth one of double precision. No pair becomes a row.
    """
    parts = F.ceil(F.col("n") * F.col("dim") / F.lit(float(part or PART))).cast("int")
    sizes = written(classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select("dim", parts.alias("parts")), "sizes")
    rows = classes.select("rep", "copies", "dim", "vec").join(shards, "rep").join(sizes, "dim").withColumn("own", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = rows.select("dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "copies", "shards", "vec")
    return met.groupBy("dim", "low", "high").applyInPandas(partial(_met, least=least), "rep long, links long, root long")


def _met(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between two parts, or inside one, of rows that share no shard."""
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
    own = rows["own"].to_numpy()
    a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
    x = unit(np.stack([np.frombuffer(v, "<f8") for v in rows["vec"]]))
    rep, copies, lists = rows["rep"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64), rows["shards"].tolist()
    rough = x.astype(np.float32)
    links, root, enough = np.zeros(len(x), np.int64), np.arange(len(x)), np.float32(least - (x.shape[1] + 8) * 1.2e-7)
    other = rough[b].T
    for lo in range(0, len(a), 256):
        i, j = np.nonzero(rough[a[lo : lo + 256]] @ other >= enough)
        u, v = a[lo : lo + 256][i], b[j]
        if low == high:
            u, v = u[u < v], v[u < v]
        sure = np.concatenate([np.einsum("nd,nd->n", x[u[s : s + 65536]], x[v[s : s + 65536]]) >= least for s in range(0, len(u), 65536)]) if len(u) else np.zeros(0, bool)
        u, v = u[sure], v[sure]
        if not len(u):
            continue
        (us, i), (vs, j) = np.unique(u, return_inverse=True), np.unique(v, return_inverse=True)
        apart = ~_together([lists[k] for k in us], [lists[k] for k in vs])[i, j]
        u, v = u[apart], v[apart]
        links += np.bincount(u, weights=copies[v], minlength=len(x)).astype(np.int64) + np.bincount(v, weights=copies[u], minlength=len(x)).astype(np.int64)
        while len(u):
            first, now = np.minimum(root[u], root[v]), root.copy()
            for end in (u, v):
                np.minimum.at(now, root[end], first)
            while (now != (further := now[now])).any():
                now = further
            if (now == root).all():
                break
            root = now
    some = links > 0
    return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep[root[some]]})


def _together(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Which of the lists a have a number in common with which of b."""
    flat = [np.concatenate(x).astype(np.int64) for x in (a, b)]
    common = np.intersect1d(*flat)
    flags = []
    for lists, numbers in zip((a, b), flat, strict=True):
        m = np.zeros((len(lists), len(common)), np.float32)
        if len(common):
            row, at = np.repeat(np.arange(len(lists)), list(map(len, lists))), np.minimum(np.searchsorted(common, numbers), len(common) - 1)
            held = common[at] == numbers
            m[row[held], at[held]] = 1
        flags.append(m)
    return flags[0] @ flags[1].T > 0


def audit(classes: DataFrame, counted: DataFrame, least: float, sample: int = AUDITED) -> tuple[float, float]:
    """Share of the true links of a sample of vectors that were counted, of all links and on average over the vectors
    that have any, so that one large group cannot hide small ones; every vector is compared with the sample.

    Counted links are verified, so none is false and the shares are the recall. Without any true link they are 1.
    """
    n = classes.count()
    some = classes.where(unit_hash("rep", seed=99) < min(1.0, sample / max(1, n))).select("rep", "dim", "vec").limit(8 * sample).collect()
    if not some:
        return 1.0, 1.0
    by_dim: dict[int, tuple[list, np.ndarray]] = {}
    for dim in {r["dim"] for r in some}:
        part = [r for r in some if r["dim"] == dim]
        by_dim[dim] = ([r["rep"] for r in part], unit(np.stack([np.frombuffer(r["vec"], "<f8") for r in part])))
    held = classes.sparkSession.sparkContext.broadcast(by_dim)

    def compare(batches):
        for b in batches:
            total: dict[int, int] = {}
            rep, dim, vec, copies = (b.column(i).to_pylist() for i in range(4))
            for d in set(dim) & set(held.value):
                at = [i for i, x in enumerate(dim) if x == d]
                ids, q = held.value[d]
                s = unit(np.stack([np.frombuffer(vec[i], "<f8") for i in at])) @ q.T >= least
                for j, i in enumerate(ids):
                    hits = np.flatnonzero(s[:, j])
                    total[i] = total.get(i, 0) + sum(copies[at[h]] for h in hits if rep[at[h]] != i)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["rep", "true"])

    true = classes.select("rep", "dim", "vec", "copies").mapInArrow(lean(compare), "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    seen = F.least("true", F.coalesce("links", F.lit(0)))
    both = true.where(F.col("true") > 0).join(counted.select("rep", "links"), "rep", "left").agg(F.sum("true").alias("t"), F.sum(seen).alias("f"), F.avg(seen / F.col("true")).alias("each")).first()
    return (1.0, 1.0) if not both["t"] else (both["f"] / both["t"], both["each"])


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector: str | Column = "embedding", cap: int = SHARD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors, by cosine of least or more in double precision.

    Equal vectors collapse to a class first: they link with each other and share all links. Classes go to overlapping
    shards, each shard grows a robust-pruned graph, a class's links are the union of its lists from all its shards, and
    a range search in each shard finds pairs, whose cosine is checked. A pair in several shards counts in the first they
    share, so links are sums of bounded shards' counts and no pair of a large group ever becomes a row. An exact check
    follows, of all pairs that share no shard, so that no link is lost; it takes products in the square of the number of
    classes. A sampled audit against all rows measures recall; below LEAST_RECALL it raises. Rows with a null, zero or
    empty vector or components null or not finite link with nothing,
    as do rows with a null id; vectors of different lengths never link. component_id is the smallest id reachable. Rows
    that repeat an id each go by their own vector and link with each other only if near; an empty table gives no row, and
    other columns are not read.
    """
    bounded_batches(vectors.sparkSession)
    v = F.col(vector) if isinstance(vector, str) else vector
    part = usable(v) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v"), F.coalesce(part, F.lit(False)).alias("part"))
    rows = rows.select("vec_id", "part", F.when(F.col("part"), F.col("v")).alias("v"))
    keys = [F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")]

    def packed(batches):
        for b in batches:
            vec = b.column("v").to_pylist()
            given = [b.column(c) for c in ("h1", "h2", "rep", "least", "copies")]
            yield pa.RecordBatch.from_arrays([*given, pa.array([len(x) for x in vec], pa.int32()), pa.array([np.array(x, "<f8").tobytes() for x in vec])], names=["h1", "h2", "rep", "least", "copies", "dim", "vec"])

    grouped = rows.where("part").select("vec_id", "v", *keys).groupBy("h1", "h2").agg(F.min("vec_id").cast("long").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    # A class has a number of its own: an id may repeat with another vector, and then names several classes.
    grouped = grouped.withColumn("rep", F.monotonically_increasing_id())
    classes = written(grouped.mapInArrow(lean(packed), "h1 long, h2 long, rep long, least long, copies long, dim int, vec binary"), "classes")
    members = _sharded(classes.select("rep", "dim", "vec"), 2, cap, float(np.sqrt(2 - 2 * least)))
    lists = written(members.groupBy("shard").applyInPandas(_built, "rep long, near array<long>"), "lists")
    union = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    where = members.groupBy("rep").agg(F.collect_set("shard").alias("shards"))
    known = classes.select("rep", "copies").join(union, "rep").join(where, "rep")
    search = partial(_searched, least=least, beam=BEAM)
    found = written(members.join(known, "rep").groupBy("shard").applyInPandas(search, "rep long, links long, root long"), "found")
    discard(lists)
    release(vectors.sparkSession)
    rest = written(across(classes, where, least), "across")
    discard(members)
    release(vectors.sparkSession)
    shared = found.unionByName(rest)
    counted = shared.groupBy("rep").agg(F.sum("links").alias("links"))
    recall = min(audit(classes, counted, least))
    if recall < LEAST_RECALL:
        raise RuntimeError(f"recall {recall:.3f} of the audited links is below {LEAST_RECALL}")
    roots = components(shared.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    named = classes.select("h1", "h2", "rep", "least", "copies").join(counted, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = written(named.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.coalesce("root", "rep").alias("root")), "named")
    heads = named.groupBy("root").agg(F.min("least").alias("head"))
    named = written(named.join(heads, "root").select("h1", "h2", "links", F.col("head").alias("root")), "labels")
    for t in (found, rest, classes):
        discard(t)
    each = rows.select("vec_id", "part", *[F.when(F.col("part"), k).alias(n) for k, n in zip((F.xxhash64(F.lit(1), "v"), F.xxhash64(F.lit(2), "v")), ("h1", "h2"), strict=True)])
    out = each.join(named, ["h1", "h2"], "left")
    component = F.when(F.col("part"), F.col("root")).otherwise(F.col("vec_id"))
    return out.select(F.col("vec_id").alias(id_col), F.when(F.col("part"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
