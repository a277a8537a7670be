"""What the detectors need of files, taken from each file's bytes in one pass: one row per fact, small beside its file."""

from __future__ import annotations

import wave
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import containers, documents, pdf, provenance, signals

FACTS = "kind string, what string, ordinal int, grp string, name string, value string, payload binary, numbers array<double>"
Fact = tuple[str, str, str, str | None, bytes | None, list[float] | None]

#: Members of an office file whose content the rules read; of others the name is enough.
READ = documents.READ

# Fixed value: what the fallback says of a file that no reader knows.
UNREAD = "Unrecognized document container"


def facts(files: DataFrame, key: str = "path") -> DataFrame:
    """key and FACTS of files(key, kind, content): tags, container parts, texts, what samples and pixels show, and notes.

    Bytes are read once, file by file; a null content has no facts, a broken file has those before the damage and a note. A
    task holds the Arrow batch it reads and one file's facts.
    """

    def scan(batches):
        for b in batches:
            for i in range(b.num_rows):
                data, kind = b.column("content")[i].as_py(), b.column("kind")[i].as_py()
                rows: list[Fact] = []
                if data is not None and kind is not None:
                    for reader in READERS[kind]:
                        try:
                            for fact in reader(data):
                                rows.append(fact)  # noqa: PERF402 what came before the damage stays
                        except (*containers.DAMAGED, wave.Error) as e:
                            rows.append(("note", "", reader.__name__, f"{type(e).__name__}: {e}", None, None))
                if rows:
                    n = len(rows)
                    columns = [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.string()), (2, pa.string()), (3, pa.string()), (4, pa.binary()), (5, pa.list_(pa.float64())))]
                    head = [pa.array([b.column(key)[i].as_py()] * n, b.column(key).type), pa.array([kind] * n), pa.array([r[0] for r in rows]), pa.array(range(n), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*head, *columns], names=[key, "kind", "what", "ordinal", "grp", "name", "value", "payload", "numbers"])

    return files.select(key, "kind", "content").mapInArrow(scan, f"`{key}` {files.schema[key].dataType.simpleString()}, {FACTS}")


def _tags(reader):
    def tags(data: bytes) -> Iterator[Fact]:
        for grp, name, value in reader(data):
            yield "tag", grp, name, value, None, None

    tags.__name__ = reader.__name__
    return tags


def manifest(data: bytes) -> Iterator[Fact]:
    """The first part of a picture that may hold a manifest."""
    for name, body in containers.image_parts(data):
        if name in ("caBX", "C2PA") or (name == "EB" and (b"jumb" in body or b"c2pa" in body)):
            yield "part", "", name, None, body, None
            return


def pixels(data: bytes) -> Iterator[Fact]:
    """What the samples show of pictures that can be decoded here; a note for others."""
    bgr = signals.decode_png(data) if data[:4] == b"\x89PNG" else signals.decode_bmp(data)
    if bgr is None:
        yield "note", "", "pixels", "picture not decoded: no pixel checks", None, None
    else:
        yield "seen", "", "", None, None, list(signals.looked_at(bgr).values())


def samples(data: bytes) -> Iterator[Fact]:
    """Tones of each of a recording's first seconds, and its spectrum's own period."""
    if data[:4] != b"RIFF":
        yield "note", "", "samples", "sound not decoded: no checks of its samples", None, None
        return
    rate, x = signals.wav_samples(data)
    for i in range(min(signals.SEGMENTS, len(x) // rate)):
        yield "second", "", str(i), None, None, signals.tones(x[i * rate : (i + 1) * rate], rate)
    if len(x) >= 4 * rate:
        yield "lag", "", "", None, None, [float(v) for v in signals.spectral_lag(x, rate)]


def film_manifest(data: bytes) -> Iterator[Fact]:
    if provenance.in_film(data):
        yield "manifest", "", "", None, None, None


def document(data: bytes) -> Iterator[Fact]:
    """Members of an office file, or what the objects of a PDF tell."""
    if data[:4] == b"%PDF":
        for what, value in pdf.facts(data):
            yield "pdf", "", what, value, None, None
        return
    if data[:2] != b"PK":
        yield "note", "", "document", UNREAD, None, None
        return
    for name, body in containers.zip_parts(data):  # raises what is in DAMAGED where the archive is broken
        yield "part", "", name, None, body if READ.search(name) else b"", None


def text(data: bytes) -> Iterator[Fact]:
    yield "text", "", "", data.decode("utf-8", "replace"), None, None


READERS = {
    "image": (_tags(containers.image_tags), manifest, pixels),
    "audio": (_tags(containers.audio_tags), samples),
    "video": (_tags(containers.mp4_tags), film_manifest),
    "document": (document,),
    "text": (text,),
}


def of(rows: DataFrame, kind: str, what: str) -> DataFrame:
    return rows.where((F.col("kind") == kind) & (F.col("what") == what))


def tags(rows: DataFrame, kind: str, key: str = "path") -> DataFrame:
    """key, ordinal, grp, tag, value."""
    return of(rows, kind, "tag").select(key, "ordinal", "grp", F.col("name").alias("tag"), "value")


def parts(rows: DataFrame, kind: str, key: str = "path") -> DataFrame:
    """key, ordinal, part_type, payload."""
    return of(rows, kind, "part").select(key, "ordinal", F.col("name").alias("part_type"), "payload")


def named(rows: DataFrame, kind: str, what: str, fields: list[str], key: str = "path") -> DataFrame:
    """key and the fact's numbers as columns."""
    return of(rows, kind, what).select(key, *[F.get("numbers", F.lit(i)).alias(f) for i, f in enumerate(fields)])


def notes(rows: DataFrame, key: str = "path") -> DataFrame:
    """key, kind, note: what could not be read or looked at."""
    return rows.where("what = 'note'").select(key, "kind", F.concat_ws(": ", "name", "value").alias("note"))
