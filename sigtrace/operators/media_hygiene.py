"""Personal metadata removed from pictures, sound and media containers without touching what is seen or heard.

Only whole blocks are dropped or, where offsets must hold, blanked in place; samples and pixels stay byte for byte.
Blocks that tell how a work was made (provenance manifests, generator labels) are kept and the file is ``partial``.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from . import containers, documents
from .tags import GENERATORS

HOW_MADE = re.compile(rb"c2pa|jumb|DigitalSourceType|AIGC|\b(?:" + GENERATORS.replace("(?i)", "").encode() + rb")\b", re.IGNORECASE)
# Keywords under which generators write their settings into PNG texts.
LABELS = (b"parameters", b"prompt", b"workflow", b"aigc", b"hf-job-id")


class Unsupported(ValueError):
    """The container is none of those rewritten here, or damaged."""


def _orientation(tiff: bytes) -> int:
    """The picture's orientation in an EXIF structure, 1 where it says none."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 10:
        return 1
    at = struct.unpack(order + "I", tiff[4:8])[0]
    for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0] if at + 2 <= len(tiff) else 0):
        e = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(e) == 12 and struct.unpack(order + "H", e[:2])[0] == 0x0112:
            return struct.unpack(order + "H", e[8:10])[0]
    return 1


def _upright(tiff: bytes) -> bytes:
    """An EXIF structure of the orientation alone; empty where there is nothing to keep."""
    n = _orientation(tiff)
    return b"" if n == 1 else b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHHI", 0x0112, 3, 1, n, 0, 0)


def jpeg(data: bytes) -> tuple[bytes, bool]:
    """Without EXIF (but its orientation), XMP, IPTC, comments, further pictures and bytes after the end."""
    out, at, kept = [b"\xff\xd8"], 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unsupported("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        part, body = data[at:end], data[at + 4 : end]
        if marker == 0xDA:
            # Stuffed bytes and restarts belong to the samples; any other marker ends them.
            after = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, end)
            at = after.start() if after else len(data)
            out.append(data[end - len(part) : at])
            if not after:
                return b"".join(out), kept
            if data[at + 1] == 0xD9:
                return b"".join([*out, b"\xff\xd9"]), kept
            continue
        at = end
        if marker == 0xEB or marker in (0xE1, 0xED, 0xFE) and HOW_MADE.search(body):
            kept = True
        elif marker == 0xE1:
            if body[:6] == b"Exif\0\0" and (small := _upright(body[6:])):
                out.append(b"\xff\xe1" + struct.pack(">H", len(small) + 8) + b"Exif\0\0" + small)
            continue
        elif marker in (0xED, 0xFE) or (marker == 0xE2 and body[:4] == b"MPF\0"):
            continue
        out.append(part)
    raise Unsupported("no end of picture")


def png(data: bytes) -> tuple[bytes, bool]:
    """Without EXIF (but its orientation), texts, time and bytes after the end."""
    out, at, kept = [data[:8]], 8, False
    while at + 12 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part, body = data[at : at + 12 + size], data[at + 8 : at + 8 + size]
        at += 12 + size
        if name in (b"tEXt", b"iTXt", b"zTXt"):
            key = body.split(b"\0")[0].lower()
            if key not in LABELS and not HOW_MADE.search(body):
                continue
            kept = True
        elif name == b"eXIf" and not HOW_MADE.search(body):
            if small := _upright(body):
                out.append(struct.pack(">I", len(small)) + name + small + struct.pack(">I", zlib.crc32(name + small)))
            continue
        elif name == b"tIME":
            continue
        kept |= name in (b"caBX", b"eXIf")
        out.append(part)
        if name == b"IEND":
            return b"".join(out), kept
    raise Unsupported("no end of picture")


def riff(data: bytes) -> tuple[bytes, bool]:
    """WebP without EXIF (but its orientation) and XMP; WAV without information lists, tags and broadcast blocks."""
    out, at, kept, held = [], 12, False, set()
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            raise Unsupported("cut short")
        body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
        personal = name in (b"EXIF", b"XMP ", b"id3 ", b"ID3 ", b"bext", b"iXML", b"_PMX") or (name == b"LIST" and body[:4] == b"INFO")
        if personal and not HOW_MADE.search(body):
            body = _upright(body[6:] if body[:6] == b"Exif\0\0" else body) if name == b"EXIF" else b""
            if not body:
                continue
        else:
            kept |= personal or name == b"C2PA"
        held.add(name)
        out.append([name, body])
    for part in out:
        if part[0] == b"VP8X" and part[1]:
            flags = part[1][0] & ~0x0C | (0x08 if b"EXIF" in held else 0) | (0x04 if b"XMP " in held else 0)
            part[1] = bytes([flags]) + part[1][1:]
    body = data[8:12] + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in out)
    return b"RIFF" + struct.pack("<I", len(body)) + body, kept


def _without_id3(data: bytes) -> tuple[bytes, bool]:
    """Without the tag in front; frames of a manifest stay in a tag of their own."""
    kept = b""
    while data[:3] == b"ID3" and len(data) >= 10:
        size = 10 + containers.whole7(data[6:10]) + (10 if data[5] & 0x10 else 0)
        tag, data = data[:size], data[size:]
        kept += tag if HOW_MADE.search(tag) and (tag[5] or tag[3] < 3) else b""
        if not tag[5] and tag[3] >= 3:
            frames = b"".join(f for f in containers.id3_frames(tag) if HOW_MADE.search(f))
            n = len(frames)
            kept += tag[:6] + bytes([(n >> s) & 127 for s in (21, 14, 7, 0)]) + frames if frames else b""
    return kept + data, bool(kept)


def mp3(data: bytes) -> tuple[bytes, bool]:
    """Without the tags in front and at the end."""
    data, kept = _without_id3(data)
    if data[-128:-125] == b"TAG":
        data = data[:-128]
    if data[-32:-24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[-20:-8])
        data = data[: max(0, len(data) - size - (32 if flags >> 31 else 0))]
    return data, kept


def flac(data: bytes) -> tuple[bytes, bool]:
    """Without comments, pictures and application blocks."""
    out, at, kept, last = [], 4, False, False
    while not last:
        if at + 4 > len(data):
            raise Unsupported("cut short")
        last, kind, size = data[at] >= 128, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind in (2, 4, 6):
            if not HOW_MADE.search(body):
                continue
            kept = True
        out.append((kind, body))
    blocks = b"".join(bytes([k | (128 if i == len(out) - 1 else 0)]) + struct.pack(">I", len(b))[1:] + b for i, (k, b) in enumerate(out))
    return b"fLaC" + blocks + data[at:], kept


XMP_BOX = bytes.fromhex("BE7ACFCB97A942E89C71999491E3AFAC")


def mp4(data: bytes) -> tuple[bytes, bool]:
    """User data, tags and XMP turned into free space, times set to zero, handlers' names blanked: no offset moves.

    Tracks of timed metadata stay, as dropping them would move samples; the file is then partial.
    """
    out, kept, todo = bytearray(data), False, [(0, len(data), b"")]
    while todo:
        at, end, inside = todo.pop()
        while at + 8 <= end:
            size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
            if size == 1:
                size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            size = size or end - at
            if size < head or at + size > end:
                raise Unsupported("cut short")
            body = slice(at + head, at + size)
            if name in (b"moov", b"trak", b"mdia"):
                todo.append((at + head, at + size, name))
            elif (name in (b"udta", b"meta") and inside) or (name == b"uuid" and data[at + head : at + head + 16] == XMP_BOX):
                if HOW_MADE.search(data, body.start, body.stop):
                    kept = True
                else:
                    out[at + 4 : at + 8] = b"free"
                    out[body] = bytes(body.stop - body.start)
            elif name == b"hdlr" and inside == b"mdia":
                kept |= data[at + head + 8 : at + head + 12] in (b"meta", b"tmcd")
                if at + head + 24 < at + size:
                    out[at + head + 24 : at + size] = bytes(size - head - 24)
            elif name in (b"mvhd", b"tkhd", b"mdhd") and inside:
                n = 16 if data[at + head] == 1 else 8
                out[at + head + 4 : at + head + 4 + n] = bytes(n)
            elif name in (b"uuid", b"jumb"):
                kept |= bool(HOW_MADE.search(data, body.start, body.stop)) or data[at + head : at + head + 4] == b"\xd8\xfe\xc3\xd6"
            at += size
    return bytes(out), kept


def cleaned(data: bytes | None) -> tuple[bytes | None, str]:
    """(bytes, status): cleaned, partial (something that tells how it was made is kept) or unsupported (as it was)."""
    data = data or b""
    try:
        if data[:3] == b"\xff\xd8\xff":
            out, kept = jpeg(data)
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            out, kept = png(data)
        elif data[:4] == b"RIFF" and data[8:12] in (b"WEBP", b"WAVE"):
            out, kept = riff(data)
        elif data[:3] == b"ID3" or data[:2] in (b"\xff\xfb", b"\xff\xf3", b"\xff\xfa"):
            out, kept = mp3(data)
            if out[:4] == b"fLaC":
                out, more = flac(out)
                kept |= more
        elif data[:4] == b"fLaC":
            out, kept = flac(data)
        elif data[4:8] == b"ftyp" and data[8:12] not in (b"avif", b"avis", b"heic", b"heix", b"mif1"):
            out, kept = mp4(data)
        else:
            return data, "unsupported"
    except (Unsupported, struct.error, IndexError):
        return data, "unsupported"
    return out, "partial" if kept else "cleaned"


def clean_files(files: DataFrame, strength: str = "standard") -> DataFrame:
    """files(path, kind, content) with their content cleaned, and status: office files and media in one pass over the bytes.

    Texts pass as they are. A null content stays null and is unsupported; a damaged file stays as it is. Files leave one by
    one, so a task holds the Arrow batch it reads and one rewritten file.
    """

    def one(kind: str | None, data: bytes | None) -> tuple[bytes | None, str]:
        if data is None or kind is None or data[:4] == b"%PDF":
            return data, "unsupported"
        if kind == "text":
            return data, "cleaned"
        if kind != "document":
            return cleaned(data)
        try:
            return documents.cleaned(data, strength), "cleaned"
        except containers.DAMAGED:
            return data, "unsupported"

    def scan(batches):
        for b in batches:
            for i in range(b.num_rows):
                body, status = one(b.column("kind")[i].as_py(), b.column("content")[i].as_py())
                head = [b.column(n).slice(i, 1) for n in ("path", "kind")]
                yield pa.RecordBatch.from_arrays([*head, pa.array([body], pa.binary()), pa.array([status], pa.string())], names=["path", "kind", "content", "status"])

    given = f"`path` {files.schema['path'].dataType.simpleString()}, kind string"
    return files.select("path", "kind", "content").mapInArrow(scan, f"{given}, content binary, status string")
