"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, class_sample, lean, one_each, plain_text, row_hash, trim
from .tokens import forget

#: Labelled rows taken from each language at most (in expectation), for fitting and calibration together.
SAMPLE_PER_LANGUAGE = 800
BUCKETS, WIDTH = 1 << 18, 16
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")  # letters, and numerals that are no digits
#: Longer words are taken in parts, so that a text without breaks needs no more memory than others.
PART = 64
CACHED_WORDS = 300_000


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode class L), lower case; a long run in parts of PART letters."""
    found = _WORD.findall(text.lower())
    if not all(map(str.isalpha, found)):
        found = "".join([c if c.isalpha() else " " for w in found for c in (*w, " ")]).split()
    if found and max(map(len, found)) > PART:
        found = [w[i : i + PART] for w in found for i in range(0, len(w), PART)]
    return found


def grams(word: str) -> list[int]:
    """Buckets of a word's subwords: 1 to 4 letters within < and >, and the whole word."""
    w = f"<{word}>"
    parts = [*word, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)), w]
    return [zlib.crc32(p.encode()) % BUCKETS for p in parts]


@dataclass
class LanguageModel:
    """classes, the table of each bucket's logits (embedding times softmax weights), temperature, least score,
    which buckets training saw, and the least share of a text's subwords that must be among them."""

    classes: list[str]
    table: np.ndarray
    temperature: float
    least: float
    seen: np.ndarray
    least_seen: float

    def scorer(self):
        """A function from texts to (class number or -1, probability, share of subwords seen); it remembers frequent words."""
        known: dict[str, int] = {}
        wide = np.column_stack([self.table, np.ones(len(self.table)), self.seen]).astype(np.float32)
        rows = np.zeros((CACHED_WORDS + 1, self.table.shape[1] + 2))

        def numbers(found: list[str]) -> np.ndarray:
            get, out = known.get, []
            for w in found:
                k = get(w)
                if k is None:
                    k = known[w] = len(known)
                    rows[k] = wide[grams(w)].sum(axis=0)
                out.append(k)
            return np.array(out, np.int64)

        def score(text: bytes | None) -> tuple[int, float, float]:
            found = words_of(plain_text(text))
            if not found:
                return -1, 0.0, 0.0
            total = np.zeros(rows.shape[1])
            for at in range(0, len(found), 100_000):
                part = found[at : at + 100_000]
                if len(known) + len(part) > CACHED_WORDS:
                    known.clear()
                total += rows[numbers(part)].sum(axis=0)
            p = softmax((total[:-2] / total[-2])[None] / self.temperature)[0]
            return int(p.argmax()), float(p.max()), float(total[-1] / total[-2])

        return score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss(mean: np.ndarray, weight: np.ndarray, labels: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean weighted cross-entropy of rows of averaged embeddings, and its gradients by them and by the softmax weights."""
    wrong = softmax(mean @ weight)
    every = np.arange(len(labels))
    value = -(balance * np.log(wrong[every, labels] + 1e-300)).mean()
    wrong[every, labels] -= 1
    wrong *= balance[:, None] / len(labels)
    return float(value), wrong @ weight.T, mean.T @ wrong


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: list[str], epochs: int = 5, rate: float = 20.0, seed: int = 3) -> LanguageModel:
    """texts: per document, its buckets and their counts. One in five rows is kept for calibration.

    Embeddings start at zero, there is no bias and classes weigh the same: subwords never seen say nothing, so that an
    unknown script stays near equal chances.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(fit):
        held = fit = order
    embed = np.zeros((BUCKETS, WIDTH))
    weight = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, len(classes)))
    balance = len(fit) / (len(classes) * np.maximum(np.bincount(labels[fit], minlength=len(classes)), 1))

    def means(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([texts[i][0] for i in rows])
        share = np.concatenate([texts[i][1] / texts[i][1].sum() for i in rows])
        seg = np.repeat(np.arange(len(rows)), [len(texts[i][0]) for i in rows])
        mean = np.zeros((len(rows), WIDTH))
        np.add.at(mean, seg, embed[ids] * share[:, None])
        return ids, share, seg, mean

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        fit = rng.permutation(fit)
        for at in range(0, len(fit), 16):
            rows = fit[at : at + 16]
            ids, share, seg, mean = means(rows)
            _, to_mean, to_weight = loss(mean, weight, labels[rows], balance[labels[rows]])
            weight -= step * 0.05 * to_weight
            np.add.at(embed, ids, -step * share[:, None] * to_mean[seg])
    logits = np.concatenate([means(held[i : i + 64])[3] @ weight for i in range(0, len(held), 64)]) if len(held) else np.zeros((0, len(classes)))
    seen = np.zeros(BUCKETS, bool)
    seen[np.concatenate([texts[i][0] for i in fit])] = True
    temperature, least, least_seen = 1.0, 0.0, 0.0
    if len(held):
        y = labels[held]
        grid = np.geomspace(0.05, 5, 60)
        temperature = float(grid[np.argmin([-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid])])
        p = softmax(logits / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        if len(right):
            least = float(min(0.5, 0.9 * right.min()))
        shares = np.array([(texts[i][1] * seen[texts[i][0]]).sum() / texts[i][1].sum() for i in held])
        least_seen = float(min(0.6, 0.9 * shares.min()))
    return LanguageModel(classes, (embed @ weight).astype(np.float64), temperature, least, seen, least_seen)


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", key: str = "doc_id", per_class: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Trains on a bounded sample of labelled rows: about per_class whole texts of each language, as subword counts.

    Executors reduce each text to counts; no text reaches the driver. Null texts and null labels take no part; rows equal
    in key and text count once, rows without a key by their text.
    """
    bounded_batches(rows.sparkSession)
    rows = rows.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("binary").alias("text"), F.col(label_col).alias("label"), row_hash(key, text_col).alias("__pick"))
    schema = "pick long, label string, ids binary, counts binary"

    def count(batches):
        for b in batches:
            picks, labels, ids, counts = [], [], [], []
            for text, label, pick in zip(b.column("text"), b.column("label").to_pylist(), b.column("__pick").to_pylist(), strict=True):
                seen: dict[int, int] = {}
                tally: dict[str, int] = {}
                for w in words_of(plain_text(text.as_py())):
                    tally[w] = tally.get(w, 0) + 1
                for w, n in tally.items():
                    for g in grams(w):
                        seen[g] = seen.get(g, 0) + n
                if seen:
                    picks.append(pick)
                    labels.append(label)
                    ids.append(np.fromiter(seen, np.int32, len(seen)).tobytes())
                    counts.append(np.fromiter(seen.values(), np.float32, len(seen)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(picks, pa.int64()), pa.array(labels, pa.string()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["pick", "label", "ids", "counts"])

    chosen = class_sample(rows, "label", per_class).select("text", "label", "__pick")
    got = one_each(chosen.mapInArrow(lean(count), schema), "pick", "label").select("label", "ids", "counts").toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], bytes(r["ids"])))
    classes = sorted({r["label"] for r in got})
    if not classes:
        return LanguageModel([], np.zeros((BUCKETS, 0)), 1.0, 0.0, np.zeros(BUCKETS, bool), 0.0)
    texts = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.float32)) for r in got]
    number = {c: i for i, c in enumerate(classes)}
    model = train(texts, np.array([number[r["label"]] for r in got]), classes)
    del texts, got
    trim()
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (a learned language; ``und`` for a null text or one without any letter), lang_score and lang_rejected.

    lang_score is the calibrated probability. Rejected: no letter, no language learned, or a score not above what every
    calibration row of a right answer had (times 0.9, 0.5 at most), or fewer of its subwords known from training than any
    calibration row had (times 0.9, 0.6 at most). Other columns pass unchanged and are never read; columns
    of the three new names are replaced. Invalid UTF-8 counts as replacement characters, which are no letters; repeated
    rows get equal answers.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        forget()
        m = held.value
        score = m.scorer()
        for b in batches:
            found = [score(t.as_py()) if m.classes else (-1, 0.0, 0.0) for t in b.column(len(names))]
            pred = pa.array([m.classes[k] if k >= 0 else UNDETERMINED for k, _, _ in found], pa.string())
            prob = pa.array([p for _, p, _ in found], pa.float64())
            out = pa.array([k < 0 or p <= m.least or s < m.least_seen for k, p, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pred, prob, out], names=[f.name for f in schema])

    every = [F.col(f"`{c}`") for c in names]
    return docs.select(*every, F.col(f"`{text_col}`").cast("binary").alias("__scored")).mapInArrow(lean(scan), schema)
