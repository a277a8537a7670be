"""Periodic signals in sound and pictures, found with array transforms in Arrow batches.

Inputs are arrays in rows: sound as one-second segments, so that a long recording spreads over tasks; pictures as one
binary of 8-bit samples. Detectors return id-level findings; nothing here alters a signal.
"""

from __future__ import annotations

import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .findings import finding

#: Seconds of a recording that are looked at for tones.
SEGMENTS = 30
#: Bytes of windows that a filter holds at once.
WINDOW_BYTES = 32 << 20

# Name, severity, confidence (where it is fixed), category and remedy of each finding.
SIGNALS = {
    "ultrasonic-tone": ("Persistent ultrasonic tone", "medium", 0.9, "tracking", "Low-pass filtered below 16–18 kHz on clean"),
    "periodic-spectral-pattern": ("Periodic spectral pattern", "low", None, "audio", "Phase jitter + stretch decorrelate the pattern"),
    "periodic-carrier": ("Periodic carrier signal", "medium", None, "pixel", "FFT notch attenuates peak frequencies on luma"),
    "printer-dots": ("Printer tracking dots", "high", 0.9, "tracking", "Inpainted (TELEA) before pixel transforms"),
}


def _finding(place: int, id: str, evidence: Column, present: Column, confidence: Column | None = None) -> Column:
    name, severity, sure, category, removal = SIGNALS[id]
    return finding(place, id, name, severity, sure if confidence is None else confidence, evidence, present, category=category, removal=removal)


def wav_samples(data: bytes, seconds: int | None = None) -> tuple[int, np.ndarray]:
    """Rate and the first channel's samples (-1 to 1) of a PCM WAV file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(w.getnframes() if seconds is None else min(w.getnframes(), rate * seconds))
    raw = raw[: len(raw) // (channels * width) * channels * width]
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, channels, 3)[:, 0].astype(np.int32)
        x = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / float(1 << 31)
    else:
        x = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).reshape(-1, channels)[:, 0].astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return rate, x.astype(np.float32)


def wav_segments(data: bytes) -> list[tuple[int, int, bytes]]:
    """(rate, second, float32 samples) of a PCM WAV file, whole seconds of its beginning only."""
    rate, x = wav_samples(data, SEGMENTS)
    return [(rate, i, x[i * rate : (i + 1) * rate].astype("<f4").tobytes()) for i in range(len(x) // rate)]


def read_wav(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, rate, second, samples; files that are no PCM WAV give nothing."""

    def scan(batches):
        for b in batches:
            out = []
            for k, data in zip(b.column(key).to_pylist(), b.column(content).to_pylist(), strict=True):
                try:
                    out += [(k, *s) for s in wav_segments(data or b"")]
                except (wave.Error, EOFError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], b.column(key).type), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.binary())], names=[key, "rate", "second", "samples"])

    return files.select(key, content).mapInArrow(scan, f"{key} {files.schema[key].dataType.simpleString()}, rate int, second int, samples binary")


def welch(x: np.ndarray, rate: int, size: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Power density by averaged Hann windows that overlap by half."""
    size = min(size, len(x))
    window = np.hanning(size + 1)[:-1]
    starts = range(0, len(x) - size + 1, max(1, size // 2))
    power = np.zeros(size // 2 + 1)
    for s in starts:
        frame = x[s : s + size].astype(np.float64)
        power += np.abs(np.fft.rfft((frame - frame.mean()) * window)) ** 2
    power /= len(starts) * rate * (window**2).sum()
    power[1:-1] *= 2
    return np.fft.rfftfreq(size, 1 / rate), power


def tones(samples: bytes | np.ndarray, rate: int) -> list[float]:
    """Frequencies above 16 kHz that stand out of their band and of the middle band."""
    if rate < 32000:
        return []
    x = np.frombuffer(samples, "<f4") if isinstance(samples, bytes) else samples
    f, p = welch(x, rate)
    db = 10 * np.log10(p + 1e-20)
    high, middle = f > 16000, (f > 300) & (f < 15000)
    out = high & (db > np.median(db[high]) + 20) & (db > np.median(db[middle]) + 12) & (db > -55)
    return [float(x) for x in f[out]]


def ultrasonic_findings(segments: DataFrame, key: str = "path") -> DataFrame:
    """Findings of segments(key, second, rate, samples), see tone_findings(). Segments are looked at apart."""

    def scan(batches):
        for b in batches:
            found = [tones(s, r) for s, r in zip(b.column("samples").to_pylist(), b.column("rate").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("second"), pa.array(found, pa.list_(pa.float64()))], names=[key, "second", "freqs"])

    schema = T.StructType([segments.schema[key], T.StructField("second", T.IntegerType()), T.StructField("freqs", T.ArrayType(T.DoubleType()))])
    return tone_findings(segments.where(F.col("second") < SEGMENTS).select(key, "second", "rate", "samples").mapInArrow(scan, schema), key)


def tone_findings(rows: DataFrame, key: str = "path") -> DataFrame:
    """ultrasonic-tone from rows(key, second, freqs): a frequency above 16 kHz in at least 70 % of a file's first 30 seconds
    (two at least). Seconds meet in one aggregation with a condition on the count."""
    total = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"))
    kept = rows.select(key, F.explode("freqs").alias("freq")).groupBy(key, "freq").agg(F.count(F.lit(1)).alias("c")).join(total, key).where("n_segments >= 2 and c >= 0.7 * n_segments")
    one = kept.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("freq")), 1, 5).alias("freqs"))
    listed = F.array_join(F.transform("freqs", lambda x: F.format_string("%.2f kHz", x / 1000)), ", ")
    # Fixed value: the evidence's wording.
    said = F.concat(F.lit("Persistent narrowband energy at "), listed, F.lit(" (>16 kHz, in ≥70% of 1-s windows) — possible ultrasonic cross-device beacon"))
    return one.select(key, F.explode(F.array(_finding(8, "ultrasonic-tone", said, F.lit(True)))).alias("f")).select(key, "f.*")


def spectral_lag(x: np.ndarray, rate: int) -> tuple[int, float, float]:
    """Lag in bins (8 to 407), height and hertz of the largest autocorrelation of the log spectrum above 300 Hz."""
    f, p = welch(x, rate)
    s = np.log10(p[f > 300] + 1e-20)
    s = s - s.mean()
    if len(s) < 64:
        return 0, 0.0, 0.0
    power = np.abs(np.fft.rfft(s, 2 * len(s))) ** 2
    ac = np.fft.irfft(power)[: len(s)]
    ac = ac / (ac[0] + 1e-20)
    lag = int(ac[8 : min(408, len(ac))].argmax()) + 8
    return lag, float(ac[lag]), lag * float(f[1] - f[0])


def lag_findings(rows: DataFrame, key: str = "path") -> DataFrame:
    """periodic-spectral-pattern from rows(key, lag, height, hertz) of recordings of four seconds or more."""
    # Fixed value: the evidence's wording.
    said = F.format_string("Comb-like periodicity in long-term spectrum (autocorr %.2f at lag %d bins ≈ %.0f Hz)", F.col("height"), F.col("lag"), F.col("hertz"))
    found = _finding(9, "periodic-spectral-pattern", said, F.lit(True), F.least(F.lit(1.0), F.col("height")))
    return rows.where("height > 0.6").select(key, F.explode(F.array(found)).alias("f")).select(key, "f.*")


def _medians(a: np.ndarray, size: int, mode: str, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Medians of the size x size windows round the points of a grid of rows ys and columns xs."""
    half = size // 2
    view = np.lib.stride_tricks.sliding_window_view(np.pad(a, half, mode=mode), (size, size))
    out = np.empty((len(ys), len(xs)), a.dtype)
    step = max(1, WINDOW_BYTES // (size * size * a.itemsize * max(1, len(xs))))
    for i in range(0, len(ys), step):
        out[i : i + step] = np.median(view[ys[i : i + step][:, None], xs[None]].reshape(-1, len(xs), size * size), axis=2)
    return out


#: Points of a spectrum at which its background is measured exactly; other points are looked at if they stand out of it.
BACKGROUND = 65_536


def carrier_pairs(gray: np.ndarray) -> list[tuple[int, int, float]]:
    """Mirror pairs of peaks in the spectrum of what a 5 x 5 median leaves: (row, column, robust z), strongest first.

    z is the height over the 21 x 21 median, in robust deviations. Up to BACKGROUND points all are measured; in a larger
    spectrum an even grid of about as many gives the deviation and a first background, and all points that stand out of
    it by four deviations, with their neighbours, are measured exactly.
    """
    h, w = gray.shape
    if min(h, w) < 3:
        return []
    residual = gray - _medians(gray, 5, "edge", np.arange(h), np.arange(w))
    m = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(residual))))
    cy, cx = h // 2, w // 2
    y, x = np.ogrid[:h, :w]
    mask = ~(((y - cy) ** 2 + (x - cx) ** 2 <= 64) | (y == cy) | (x == cx))
    step = max(1, int(np.sqrt(h * w / BACKGROUND)))
    ys, xs = np.arange(step // 2, h, step), np.arange(step // 2, w, step)
    ground = _medians(m, 21, "symmetric", ys, xs)
    some = (m[np.ix_(ys, xs)] - ground)[mask[np.ix_(ys, xs)]]
    if not len(some):
        return []
    spread = max(1.4826 * float(np.median(np.abs(some - np.median(some)))), 1e-9)
    if step == 1:
        z = np.where(mask, (m - ground) / spread, 0.0)
    else:
        coarse = ground[np.minimum(np.arange(h) // step, len(ys) - 1)][:, np.minimum(np.arange(w) // step, len(xs) - 1)]
        z = np.where(mask, (m - coarse) / spread, 0.0)
        near = np.argwhere(z > 4)
        near = np.unique((near[:, None] + np.array([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])[None]).reshape(-1, 2), axis=0)
        near = near[(near >= 0).all(axis=1) & (near < (h, w)).all(axis=1)]
        view = np.lib.stride_tricks.sliding_window_view(np.pad(m, 10, mode="symmetric"), (21, 21))
        for at in range(0, len(near), 4096):
            r, c = near[at : at + 4096].T
            z[r, c] = np.where(mask[r, c], (m[r, c] - np.median(view[r, c].reshape(len(r), -1), axis=1)) / spread, 0.0)
    padded = np.pad(z, 1, mode="symmetric")
    nearby = np.max([padded[a : a + h, b : b + w] for a in (0, 1, 2) for b in (0, 1, 2)], axis=0)
    peaks = [(int(a), int(b), float(z[a, b])) for a, b in zip(*np.nonzero((z == nearby) & (z > 6)), strict=True)]
    used, out = set(), []
    for a, b, v in sorted(peaks, key=lambda p: -p[2]):
        mirror = (2 * cy - a, 2 * cx - b)
        if (a, b) not in used and 0 <= mirror[0] < h and 0 <= mirror[1] < w and z[mirror] > 6:
            used |= {(a, b), mirror}
            out.append((a, b, v))
    return out


def luma(bgr: np.ndarray) -> np.ndarray:
    """Brightness of BGR samples as whole numbers."""
    return np.floor(bgr[..., 2] * 0.299 + bgr[..., 1] * 0.587 + bgr[..., 0] * 0.114 + 0.5)


def _box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Means of the size x size windows, the picture mirrored at its borders."""
    half = size // 2
    sums = np.pad(np.pad(a.astype(np.float64), half, mode="reflect"), ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / (size * size)


def blobs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Area, box (height, width) and centre of each 8-connected group of cells, by smallest labels over neighbour pairs."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return np.zeros(0, int), np.zeros((0, 2), int), np.zeros((0, 2)), np.zeros(0, int)
    number = np.full((mask.shape[0] + 1, mask.shape[1] + 2), -1, np.int64)
    number[ys, xs + 1] = np.arange(len(ys))
    pairs = [(np.arange(len(ys)), number[ys + dy, xs + 1 + dx]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
    a, b = (np.concatenate(p) for p in zip(*[(i[j >= 0], j[j >= 0]) for i, j in pairs], strict=True))
    root = np.arange(len(ys))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    while (root != root[root]).any():
        root = root[root]
    _, group = np.unique(root, return_inverse=True)
    n = group.max() + 1
    area = np.bincount(group, minlength=n)
    low, high = np.full((n, 2), 1 << 40), np.full((n, 2), -1)
    for axis, v in enumerate((ys, xs)):
        np.minimum.at(low[:, axis], group, v)
        np.maximum.at(high[:, axis], group, v)
    centre = np.stack([np.bincount(group, v, n) / area for v in (ys, xs)], axis=1)
    return area, high - low + 1, centre, group


def spacing(points: np.ndarray) -> float:
    """Median distance of points to their nearest other, looked for in cells about as wide as points are apart."""
    span = points.max(axis=0) - points.min(axis=0) + 1
    side = 2 * float(np.sqrt(span.prod() / len(points)))
    cell = np.floor((points - points.min(axis=0)) / side).astype(np.int64)
    key = cell[:, 0] * (1 << 32) + cell[:, 1]
    order = np.argsort(key, kind="stable")
    key, best = key[order], np.full(len(points), np.inf)
    for i, p in enumerate(points):
        for dy in (-1, 0, 1):
            row = (cell[i, 0] + dy) * (1 << 32) + cell[i, 1]
            near = order[np.searchsorted(key, row - 1) : np.searchsorted(key, row + 1, "right")]
            near = near[near != i]
            if len(near):
                best[i] = min(best[i], float(((points[near] - p) ** 2).sum(axis=1).min()))
    for i in np.flatnonzero(best > side * side):
        far = ((points - points[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        best[i] = far.min()
    return float(np.median(np.sqrt(best)))


def dot_grid(bgr: np.ndarray) -> tuple[int, float]:
    """Number and median spacing of small yellow dots on a bright ground, if they fill all four quarters; else zeros."""
    h, w = bgr.shape[:2]
    b, g, r = (bgr[..., i].astype(np.int16) for i in range(3))
    mask = (r > 150) & (g > 150) & (b < np.minimum(r, g) - 50)
    if not mask.any():
        return 0, 0.0
    mask &= _box_mean(r, 31) > 180
    area, size, centre, _ = blobs(mask)
    good = centre[(area <= 40) & (size <= 8).all(axis=1)]
    if len(good) < 40 or len({(y >= h / 2, x >= w / 2) for y, x in good.tolist()}) < 4:
        return 0, 0.0
    return len(good), spacing(good)


def decode_png(data: bytes) -> np.ndarray | None:
    """BGR samples of a PNG of 8-bit grey, colour or palette, not interlaced; None for others."""
    from .containers import png_chunks

    head, palette, packed = None, None, []
    for name, body in png_chunks(data):
        if name == "IHDR":
            head = body
        elif name == "PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == "IDAT":
            packed.append(body)
    if not head or len(head) < 13 or head[8] != 8 or head[12] or (head[9] == 3 and palette is None) or head[9] not in (0, 2, 3, 4, 6):
        return None
    w, h, depth = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[9]]
    raw = zlib.decompress(b"".join(packed))
    if len(raw) < h * (w * depth + 1):
        return None
    rows = np.frombuffer(raw, np.uint8, h * (w * depth + 1)).reshape(h, -1)
    out = np.zeros((h, w, depth), np.uint8)
    above = np.zeros((w, depth), np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].reshape(w, depth)
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            now = line + above
        else:
            now = _unfiltered(kind, line, above)
        out[y] = above = now
    if head[9] == 3:
        return palette[np.minimum(out[..., 0], len(palette) - 1)][..., ::-1]
    return np.repeat(out[..., :1], 3, axis=2) if depth < 3 else out[..., 2::-1]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A line whose samples were told by their neighbours: the mean, or whichever is nearest to left + above - corner."""
    out = np.zeros_like(line)
    line, up, left, corner = line.tolist(), above.tolist(), [0] * line.shape[1], [0] * line.shape[1]
    for x, (now, over) in enumerate(zip(line, up, strict=True)):
        if kind == 3:
            left = [(n + (a + b) // 2) & 255 for n, a, b in zip(now, left, over, strict=True)]
        else:
            made = []
            for n, a, b, c in zip(now, left, over, corner, strict=True):
                p = a + b - c
                da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                made.append((n + (a if da <= db and da <= dc else b if db <= dc else c)) & 255)
            left, corner = made, over
        out[x] = left
    return out


def decode_bmp(data: bytes) -> np.ndarray | None:
    """BGR samples of an uncompressed BMP of 24 or 32 bits; None for others."""
    if data[:2] != b"BM" or len(data) < 54:
        return None
    start, w, h = int.from_bytes(data[10:14], "little"), int.from_bytes(data[18:22], "little", signed=True), int.from_bytes(data[22:26], "little", signed=True)
    depth, packed = int.from_bytes(data[28:30], "little") // 8, int.from_bytes(data[30:34], "little")
    line = (w * depth + 3) // 4 * 4
    if depth not in (3, 4) or packed not in (0, 3) or w <= 0 or len(data) < start + line * abs(h):
        return None
    a = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * depth].reshape(abs(h), w, depth)[..., :3]
    return a[::-1] if h > 0 else a


def looked_at(bgr: np.ndarray) -> dict[str, float]:
    """What a picture's samples show: peak pairs, the strongest one's place and height, and dots."""
    h, w = bgr.shape[:2]
    pairs = carrier_pairs(luma(bgr))
    dots, apart = dot_grid(bgr) if min(h, w) >= 600 else (0, 0.0)
    y, x, z = pairs[0] if pairs else (h // 2, w // 2, 0.0)
    return {"pairs": len(pairs), "mean_z": float(np.mean([p[2] for p in pairs])) if pairs else 0.0, "fx": abs(x - w // 2) / w, "fy": abs(y - h // 2) / h, "z": z, "dots": dots, "apart": apart}


SEEN = "pairs double, mean_z double, fx double, fy double, z double, dots double, apart double"


def seen_findings(rows: DataFrame, key: str = "path") -> DataFrame:
    """periodic-carrier and printer-dots from rows of key and the columns of SEEN."""
    n = F.col("pairs").cast("int")
    sure = F.round(F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("pairs") / 6) * F.least(F.lit(1.0), F.col("mean_z") / 12) + 0.4), 3)
    # The wording of the evidence.
    peaks = F.format_string("%d symmetric spectral peaks (strongest at fx=%.3f, fy=%.3f cycles/px, z=%.1f)", n, F.col("fx"), F.col("fy"), F.col("z"))
    dots = F.format_string("%d faint yellow dots, median spacing %.0f px, present in all 4 quadrants", F.col("dots").cast("int"), F.col("apart"))
    found = [_finding(13, "periodic-carrier", peaks, n >= 3, sure), _finding(14, "printer-dots", dots, F.col("dots") > 0)]
    return rows.select(key, F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select(key, "f.*")


def picture_findings(pixels: DataFrame, key: str = "origin", height: str = "height", width: str = "width", channels: str = "nChannels", data: str = "data") -> DataFrame:
    """Findings over decoded pictures, as Spark's image source gives them (BGR bytes). Undecoded ones show nothing."""
    fields = [f.split()[0] for f in SEEN.split(", ")]

    def scan(batches):
        for batch in batches:
            out = []
            for h, w, c, d in zip(*(batch.column(x).to_pylist() for x in (height, width, channels, data)), strict=True):
                ok = d is not None and len(d) == h * w * c and c in (1, 3, 4) and h and w
                a = np.frombuffer(d, np.uint8).reshape(h, w, c) if ok else None
                out.append(looked_at(np.repeat(a, 3, axis=2) if c == 1 else a[..., :3]) if ok else dict.fromkeys(fields, 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([float(o[f]) for o in out], pa.float64()) for f in fields)], names=[key, *fields])

    schema = f"`{key}` {pixels.schema[key].dataType.simpleString()}, {SEEN}"
    return seen_findings(pixels.select(key, height, width, channels, data).mapInArrow(scan, schema), key)


def psnr(mean_squared_error: Column) -> Column:
    """Peak signal-to-noise ratio of 8-bit samples in dB; 99 when nothing differs."""
    return F.when(mean_squared_error == 0, 99.0).otherwise(10 * F.log10(F.lit(65025.0) / mean_squared_error))


def snr(signal: Column, noise: Column) -> Column:
    """Signal-to-noise ratio in dB of two mean squares; null where nothing differs."""
    return F.when(noise > 0, 10 * F.log10(signal / noise))
