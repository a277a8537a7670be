"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, class_sample, lean, one_each, plain_text, row_hash, trim
from .langid import words_of
from .tokens import forget

#: Labelled rows taken of each label value at most (in expectation), for fitting and calibration together.
SAMPLE_PER_CLASS = 4000
BUCKETS, FACTORS = 1 << 18, 8
#: A term takes part if this many sampled rows hold it and it tells alone (its shares in the two classes differ by
#: LEAST_ERRORS standard errors) or in a pair (PAIR_ERRORS, over the pairs of the PAIR_TERMS terms that divide the rows
#: most evenly, which are all that a sample of this size can show an interaction of).
LEAST_ROWS, LEAST_ERRORS, PAIR_ERRORS, PAIR_TERMS = 5, 4.0, 8.0, 2048
#: Rows that calibration takes at least.
LEAST_HELD = 100
#: Rows that a term of a pair must be in, and must be missing from.
PAIR_ROWS = 20


#: Besides a word itself, its beginnings of these lengths are terms, as many languages build on a stem.
BEGINNINGS = (3, 4, 5, 6)


def terms(text: str | None) -> np.ndarray:
    """Sorted buckets of a text's distinct terms: words (runs of letters, lower case, long runs in parts), beginnings."""
    found: set[str] = set()
    for w in set(words_of(text or "")):
        found.add(w)
        found.update([w[:n] + "*" for n in BEGINNINGS if len(w) > n])
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in found), np.int64, len(found)))


@dataclass
class ToxicityModel:
    """slot of each bucket (-1: not used), linear weights, factors, bias, and the calibration of the margin."""

    slot: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        s = self.slot[ids]
        s = s[s >= 0]
        return float(self.bias + self.linear[s].sum()) + interactions(self.factors[s])

    def score(self, text: bytes | None) -> float:
        z = self.slope * self.margin(terms(plain_text(text))) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def telling(rows: list[np.ndarray], labels: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Buckets that say something of the label, alone or only together with another; equal rows count once."""
    distinct = list({(rows[i].tobytes(), labels[i]): i for i in some}.values())
    with_term, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for i in distinct:
        with_term[labels[i], rows[i]] += 1
        n[labels[i]] += 1
    n = np.maximum(n, 1)
    found = with_term.sum(axis=0)
    both = (found + 1) / (n.sum() + 2)
    error = np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    apart = np.abs(with_term[1] / n[1] - with_term[0] / n[0])
    used = (found >= LEAST_ROWS) & (apart >= LEAST_ERRORS * error)
    used[telling_pairs([rows[i] for i in distinct], labels[distinct], found)] = True
    return np.flatnonzero(used)


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Terms of pairs whose interaction goes with the label: the mean product of both terms and the label, each less its
    mean and over its deviation, is 0 where the terms act apart, whatever each says alone. found: rows of each term."""
    even = np.minimum(found, len(rows) - found)
    terms_ = np.flatnonzero(even >= PAIR_ROWS)
    terms_ = np.sort(terms_[np.argsort(-even[terms_], kind="stable")[:PAIR_TERMS]])
    if len(terms_) < 2 or len(np.unique(labels)) < 2:
        return terms_[:0]
    place = np.full(BUCKETS, -1, np.int32)
    place[terms_] = np.arange(len(terms_))
    x = np.zeros((len(rows), len(terms_)), np.float32)
    for r, ids in enumerate(rows):
        at = place[ids]
        x[r, at[at >= 0]] = 1
    x -= x.mean(axis=0)
    x /= x.std(axis=0)
    y = ((labels - labels.mean()) / labels.std()).astype(np.float32)
    hit = np.zeros(len(terms_), bool)
    for lo in range(0, len(terms_), 256):
        z = np.abs((x[:, lo : lo + 256] * y[:, None]).T @ x) / np.sqrt(len(rows))
        z[np.arange(len(z)), lo + np.arange(len(z))] = 0
        strong = z >= PAIR_ERRORS
        hit[lo : lo + 256] |= strong.any(axis=1)
        hit |= strong.any(axis=0)
    return terms_[hit]


def interactions(factors: np.ndarray) -> float:
    """Sum over all pairs of rows of factors of their inner products, in time linear in the rows."""
    return 0.5 * float((factors.sum(axis=0) ** 2).sum() - (factors * factors).sum())


def train(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 12, rate: float = 0.1, ridge: float = 1e-3, seed: int = 5) -> ToxicityModel:
    """Logistic loss by AdaGrad over balanced classes; one row in five is kept to calibrate with the classes' true weights.

    Where no term tells anything the score is the share of toxic rows."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(fit):
        held = fit = order
    used = telling(rows, labels, fit)
    slot = np.full(BUCKETS, -1, np.int32)
    slot[used] = np.arange(len(used))
    short = [s[s >= 0] for s in (slot[r] for r in rows)]
    linear, factors, bias = np.zeros(len(used)), rng.normal(0, 0.02, (len(used), FACTORS)), 0.0
    lin_sq, fac_sq, bias_sq = np.full(len(used), 1e-2), np.full((len(used), FACTORS), 1e-2), 1e-2
    positive = max(labels[fit].mean(), 1e-6) if len(fit) else 0.5
    balance = np.where(labels == 1, 0.5 / positive, 0.5 / max(1 - positive, 1e-6))

    def parts(some: np.ndarray):
        ids = np.concatenate([short[i] for i in some])
        seg = np.repeat(np.arange(len(some)), [len(short[i]) for i in some])
        v = factors[ids]
        sums = np.zeros((len(some), FACTORS))
        np.add.at(sums, seg, v)
        squares = np.bincount(seg, (v * v).sum(axis=1), len(some))
        z = bias + np.bincount(seg, linear[ids], len(some)) + 0.5 * ((sums**2).sum(axis=1) - squares)
        return ids, seg, v, sums, z

    for _ in range(epochs):
        fit = rng.permutation(fit)
        for at in range(0, len(fit), 32):
            some = fit[at : at + 32]
            ids, seg, v, sums, z = parts(some)
            g = balance[some] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) / len(some)
            if len(ids):
                order = np.argsort(ids, kind="stable")
                touched, first = np.unique(ids[order], return_index=True)
                pull = g[seg[order]]
                grad_l = np.add.reduceat(pull, first) + ridge / len(some) * linear[touched]
                grad_v = np.add.reduceat(pull[:, None] * (sums[seg[order]] - v[order]), first, axis=0) + ridge / len(some) * factors[touched]
                lin_sq[touched] += grad_l**2
                fac_sq[touched] += grad_v**2
                linear[touched] -= rate * grad_l / np.sqrt(lin_sq[touched])
                factors[touched] -= 0.3 * rate * grad_v / np.sqrt(fac_sq[touched])
            bias_sq += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(bias_sq)
    model = ToxicityModel(slot, linear, factors, float(bias), 1.0, 0.0)
    if len(held) < LEAST_HELD:  # a share of so few rows says little; then all rows calibrate
        held = order
    if len(held):
        z = np.array([model.margin(rows[i]) for i in held])
        model.slope, model.shift = platt(z, labels[held], weights[held])
    return model


def platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope (positive) and shift of the weighted logistic fit of y on z, by Newton's method with a weak prior."""
    a, b = 1.0, 0.0
    w = w / w.sum() * len(w)
    target = np.where(y == 1, 1 - 1e-3, 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, s = w * (p - target), w * p * (1 - p) + 1e-9
        grad = np.array([(r * z).sum() + 1e-2 * (a - 1), r.sum()])
        hess = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = max(a - step[0], 1e-3), b - step[1]
    return float(a), float(b)


def sampled_terms(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text_col: str = "text", key: str = "doc_id") -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Terms, label and weight of a bounded sample of labelled ids, one text each. Labels are sampled before any text is read."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isin(0, 1) & F.col("__key").isNotNull())
    rows = one_each(class_sample(known.withColumn("__pick", row_hash("__key")), "__label", per_class), "__key", "__label")
    texts = docs.select(F.col(key).alias("__key"), F.col(text_col).cast("binary").alias("__text"))
    # About per_class ids of each of two classes: what is broadcast has a bound that does not grow.
    both = texts.join(F.broadcast(rows), "__key").select("__key", "__label", "__share", "__text")

    def scan(batches):
        for b in batches:
            ids = [terms(plain_text(t.as_py())).astype(np.int32).tobytes() for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays([b.column("__key").cast(pa.string()), b.column("__label"), b.column("__share"), pa.array(ids, pa.binary())], names=["key", "label", "share", "ids"])

    found = both.mapInArrow(lean(scan), "key string, label int, share double, ids binary")
    found = found.groupBy("key", "label").agg(F.min(F.struct(F.xxhash64("ids"), "ids", "share")).alias("one")).select("key", "label", "one.share", "one.ids")
    got = sorted(found.toArrow().to_pylist(), key=lambda r: (r["key"], r["label"]))
    y = np.array([r["label"] for r in got], np.int64)
    return [np.frombuffer(r["ids"], np.int32).astype(np.int64) for r in got], y, np.array([1 / r["share"] for r in got])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = SAMPLE_PER_CLASS, text_col: str = "text", key: str = "doc_id") -> ToxicityModel:
    """Trains on at most about per_class labelled ids of each class; the ids alone are joined to the documents.

    With no labelled row at all nothing is known to be toxic and every text scores about 0; rows with a null key, label or text add nothing. An id that
    repeats counts once for each label it has, with one of its texts, the same in each run.
    """
    rows, y, w = sampled_terms(docs.where(F.col(text_col).isNotNull()), labels, label, per_class, text_col, key)
    if not len(y):
        return ToxicityModel(np.full(BUCKETS, -1, np.int32), np.zeros(0), np.zeros((0, FACTORS)), 0.0, 1.0, -40.0)
    model = train(rows, y, w)
    del rows
    trim()
    return model


def add_score(docs: DataFrame, model, out: str, text_col: str = "text") -> DataFrame:
    """docs with one more column: model.score of the whole text as bytes (null and empty texts are scored too).

    A column of that name is replaced; others pass unchanged, invalid UTF-8 too, which counts as replacement characters.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField(out, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        forget()
        score = held.value.score
        for b in batches:
            found = [score(t.as_py()) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], names=[f.name for f in schema])

    every = [F.col(f"`{c}`") for c in names]
    return docs.select(*every, F.col(f"`{text_col}`").cast("binary").alias("__scored")).mapInArrow(lean(scan), schema)


def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic (1 from least on)."""
    return add_score(docs, model, "toxic_score", text_col).withColumn("toxic", (F.col("toxic_score") >= least).cast("int"))
