"""Quality: positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, class_sample, lean, one_each, row_hash
from .toxicity import add_score

#: Trusted positives and unlabelled rows taken at most (in expectation).
POSITIVES, UNLABELLED = 4000, 8000
HIDDEN = 24

#: Classes of bytes: end of line, other white space, upper case, lower case, digit, sentence marks, other ASCII, beyond ASCII.
_KIND = np.full(256, 7, np.uint8)
_KIND[:128] = 6
for _n, _chars in enumerate((b"\n\r", b" \t\x0b\x0c", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:'\"()?-")):
    _KIND[list(_chars)] = _n
KINDS = 8
CHUNK = 1 << 20


def features(text: bytes | None) -> np.ndarray:
    """How a UTF-8 text is built: shares of neighbouring byte classes, word lengths, and how much repeats.

    The whole text counts, in chunks of bounded memory. Null and empty texts give the all-zero row with its first entry 1.
    """
    text = text or b""
    pairs = np.zeros(KINDS * KINDS)
    last = 0
    for at in range(0, len(text), CHUNK):
        kind = _KIND[np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at), at)]
        before = np.concatenate([np.array([last], np.uint8), kind[:-1]])
        pairs += np.bincount(before * np.uint8(KINDS) + kind, minlength=KINDS * KINDS)
        last = int(kind[-1])
    out = np.zeros(KINDS * KINDS + 12)
    words = text.split()
    if not words:
        out[-1] = 1.0
        return out
    n = len(words)
    out[: KINDS * KINDS] = np.sqrt(pairs / len(text))
    lower = [w.lower() for w in words]
    distinct = set(lower)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, n)
    twice = sum(map(operator.eq, lower, lower[1:])) / n
    gaps = [sum(map(operator.eq, lower, lower[k:])) / n for k in (2, 3, 5)]
    out[KINDS * KINDS :] = [
        np.log1p(n) / 10,
        len(distinct) / n,
        len(distinct) / n**0.8,
        1 - len(set(lines)) / len(lines),
        np.sqrt(twice),
        *np.sqrt(gaps),
        lengths.mean() / 10,
        lengths.std() / 10,
        np.log1p(n / len(lines)) / 10,
        0.0,
    ]
    return out


WIDTH = KINDS * KINDS + 12


@dataclass
class QualityModel:
    """Scaling of the features and one hidden layer. The sigmoid of its margin is the score."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.first + self.first_bias) @ self.second + self.second_bias

    def score(self, text: bytes | None) -> float:
        z = float(self.margins(features(text)[None])[0])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def step(par: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """prior * R+, Ru- - prior * R- (sigmoid loss) of a batch of positive and unlabelled rows, and the gradient to follow.

    Where the second term is below zero that is the gradient of its negative alone, so that the model cannot gain by
    driving the risk of unlabelled rows under what the prior allows.
    """
    n = len(p)
    x = np.concatenate([p, u])
    hidden = np.tanh(x @ par[0] + par[1])
    g = hidden @ par[2] + par[3][0]
    s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))  # the loss of a positive is 1 - s, of a negative s
    slope = s * (1 - s) / np.concatenate([np.full(n, n), np.full(len(u), len(u))])
    negative = s[n:].mean() - prior * s[:n].mean()
    back = np.concatenate([-2 * prior * slope[:n], slope[n:]]) if negative >= 0 else np.concatenate([prior * slope[:n], -slope[n:]])
    inner = (back[:, None] * par[2]) * (1 - hidden**2)
    return prior * (1 - s[:n]).mean(), negative, [x.T @ inner, inner.sum(axis=0), hidden.T @ back, np.array([back.sum()])]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 9) -> QualityModel:
    """Minimises prior * R+(g) + max(0, Ru-(g) - prior * R-(g)) with the sigmoid loss by Adam, see step()."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    squash = lambda x: np.clip((x - mean) / scale, -8, 8)
    p, u = squash(positive), squash(unlabelled)
    par = [rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par], 0
    steps = max(1, -(-max(len(p), len(u)) // batch))
    for epoch in range(epochs):
        pi, ui = rng.permutation(np.resize(np.arange(len(p)), steps * batch)), rng.permutation(np.resize(np.arange(len(u)), steps * batch))
        for k in range(steps):
            _, _, grads = step(par, p[pi[k * batch : (k + 1) * batch]], u[ui[k * batch : (k + 1) * batch]], prior)
            t += 1
            now = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
            for i, grad in enumerate(grads):
                grad = grad + decay * par[i] * (i in (0, 2))
                m[i] += 0.1 * (grad - m[i])
                v[i] += 0.001 * (grad * grad - v[i])
                par[i] = par[i] - now * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(mean, scale, par[0], par[1], par[2], float(par[3][0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text", key: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """labels(key, label in 0/1) are the rows that may be learned from; documents without one are unlabelled text.

    Trusted positives are a bounded sample of label 1. The class prior is the share of label 1 among those rows, which
    were labelled whatever their class. Unlabelled rows are a bounded sample, by a hash of the key, of all documents but
    the trusted positives. Only the features of sampled texts reach the driver. Without positives every score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where(F.col("__label").isin(0, 1) & F.col("__key").isNotNull())
    counts = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs = docs.count()
    if not counts.get(1) or not n_docs:
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    prior = min(0.98, max(0.02, counts[1] / sum(counts.values())))
    trusted = one_each(class_sample(known.where("__label = 1").withColumn("__pick", row_hash("__key")), "__label", positives).select("__key", F.lit(1).alias("__trusted")), "__key")
    rows = docs.select(F.col(key).alias("__key"), F.col(text_col).cast("binary").alias("__text"), row_hash(key, text_col, seed=13).alias("__pick"))
    trusted = rows.join(F.broadcast(trusted), "__key", "left")
    share = F.shiftrightunsigned("__pick", 11) / F.lit(float(1 << 53))
    chosen = trusted.where(F.col("__trusted").isNotNull() | (share < min(1.0, unlabelled / n_docs)))
    # An id counts once among the trusted, with one of its texts; other rows once for each id and text.
    once = F.when(F.col("__trusted").isNotNull(), row_hash("__key")).otherwise(F.col("__pick"))
    chosen = chosen.select(F.coalesce("__trusted", F.lit(0)).alias("trusted"), once.alias("once"), F.col("__text").alias("text"))

    def scan(batches):
        for b in batches:
            x = pa.array([features(t.as_py()).astype(np.float32).tobytes() for t in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("trusted"), b.column("once"), x], names=["trusted", "once", "x"])

    found = chosen.mapInArrow(lean(scan), "trusted int, once long, x binary").groupBy("trusted", "once").agg(F.min("x").alias("x"))
    got = sorted(found.select("trusted", "x").toArrow().to_pylist(), key=lambda r: (r["trusted"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(np.float64) if got else np.zeros((0, WIDTH))
    mark = np.array([r["trusted"] for r in got], bool)
    if not mark.any():
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    # The population that the unbiased risk averages over holds the trusted rows in their share too.
    rest = x[~mark]
    return train(x[mark], rest if len(rest) else x, prior)


def quality(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs with quality_score (0 to 1; higher: better) and quality_pred (1 from least on); every whole text is scored."""
    return add_score(docs, model, "quality_score", text_col).withColumn("quality_pred", (F.col("quality_score") >= least).cast("int"))
