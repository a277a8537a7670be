"""Parts of container files as rows: zip members, JPEG segments, PNG and WebP chunks; tags of EXIF, IPTC, XMP and sound.

Reading bytes needs Python; every reader takes Arrow batches, gives rows of (id, ordinal, part_type, payload) and turns a
broken file into the parts before the damage. All rules over parts are Column expressions.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tags import RAW

PART = "ordinal int, part_type string, payload binary"
#: What readers raise on broken files.
DAMAGED = (zipfile.BadZipFile, zlib.error, struct.error, KeyError, ValueError, IndexError, NotImplementedError, RuntimeError, OverflowError, EOFError)


def zip_parts(data: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            yield name, z.read(name)


def jpeg_segments(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Segments up to the start of the scan, named by marker in hexadecimal."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xDA:
            return
        yield f"{marker:02X}", data[at + 4 : at + 2 + size]
        at += 2 + size


def png_chunks(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 8
    while data[:4] == b"\x89PNG" and at + 8 <= len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1")
        yield name, data[at + 8 : at + 8 + size]
        if name == "IEND":
            return
        at += 12 + size


def riff_chunks(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 12
    while data[:4] == b"RIFF" and at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4].decode("latin-1"), data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def image_parts(data: bytes) -> Iterator[tuple[str, bytes]]:
    for reader in (jpeg_segments, png_chunks, riff_chunks):
        yield from reader(data)


# Numbers of the tags that identify people, places, devices and times.
EXIF = {
    0x000B: "ProcessingSoftware", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0131: "Software", 0x0132: "ModifyDate", 0x013B: "Artist", 0x013C: "HostComputer",
    0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISO", 0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized",
    0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor",
    0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xA420: "ImageUniqueID", 0xA430: "OwnerName", 0xA431: "SerialNumber", 0xA432: "LensInfo", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
    0xC62F: "CameraSerialNumber", 0xC68B: "OriginalRawFileName", 0xC65D: "RawDataUniqueID",
}
GPS = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp", 12: "GPSSpeedRef", 13: "GPSSpeed",
    16: "GPSImgDirectionRef", 17: "GPSImgDirection", 23: "GPSDestBearingRef", 24: "GPSDestBearing", 27: "GPSProcessingMethod", 29: "GPSDateStamp", 31: "GPSHPositioningError",
}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def tiff_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(group, tag, value) of a TIFF structure's directories, following those for camera and place."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return
    todo, seen = [(struct.unpack(order + "I", data[4:8])[0], "EXIF")], set()
    while todo:
        at, group = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        for k in range(n):
            e = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(e) < 12:
                return
            tag, kind, count = struct.unpack(order + "HHI", e[:8])
            size = _SIZES.get(kind, 1) * count
            raw = e[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(order + "I", e[8:12])[0]) : p + size]
            if tag in (0x8769, 0x8825):
                todo.append((struct.unpack(order + "I", e[8:12])[0], "GPS" if tag == 0x8825 else "EXIF"))
                continue
            name = (GPS if group == "GPS" else EXIF).get(tag)
            if not name:
                continue
            if kind == 2:
                value = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                pairs = [struct.unpack(order + ("II" if kind == 5 else "ii"), raw[i : i + 8]) for i in range(0, len(raw) - 7, 8)]
                value = " ".join(f"{a / b:g}" if b else "0" for a, b in pairs)
            elif kind in (3, 4):
                value = " ".join(str(x) for (x,) in struct.iter_unpack(order + ("H" if kind == 3 else "I"), raw[: len(raw) // _SIZES[kind] * _SIZES[kind]]))
            elif name == "MakerNote":
                value = f"{len(raw)} bytes"
            elif name.startswith("XP"):
                value = raw.decode("utf-16-le", "replace").strip("\0 ")
            elif name == "UserComment":
                value = raw[8:].decode("utf-16" if raw[:7] == b"UNICODE" else "latin-1", "replace").strip("\0 ")
            else:
                value = raw.decode("latin-1").strip("\0 ")
            yield group, name, value


def xmp_tags(body: bytes) -> Iterator[tuple[str, str, str]]:
    """Properties of an XMP packet, as attributes or elements, by local name; members of a list are joined."""
    if b"<!" in body or b"<" not in body:  # no document types: nothing to expand
        return
    begin, end = body.find(b"<x:xmpmeta"), body.rfind(b"</x:xmpmeta>")
    try:
        root = ElementTree.fromstring(body[begin : end + 12] if 0 <= begin < end else body.strip(b"\0 \r\n"))
    except ElementTree.ParseError:
        return
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    local = lambda name: name.rpartition("}")[2]
    for about in root.iter(f"{rdf}Description"):
        for name, value in about.attrib.items():
            if not name.startswith((rdf, "{http://www.w3.org/XML")):
                yield "XMP", local(name), value
        for child in about:
            value = "; ".join(t for t in (e.strip() for e in child.itertext()) if t) or child.get(f"{rdf}resource", "")
            if value:
                yield "XMP", local(child.tag), value


# Numbers of the datasets in record 2 of an IPTC block.
IPTC = {25: "Keywords", 55: "DateCreated", 80: "By-line", 85: "By-lineTitle", 90: "City", 110: "Credit", 115: "Source", 116: "Copyright", 120: "Caption-Abstract"}


def iptc_tags(body: bytes) -> Iterator[tuple[str, str, str]]:
    """Datasets of the IPTC resource in a block of image resources."""
    at = 14 if body[:14] == b"Photoshop 3.0\0" else 0
    while body[at : at + 4] == b"8BIM" and at + 7 <= len(body):
        number = int.from_bytes(body[at + 4 : at + 6], "big")
        at += 6 + (body[at + 6] + 2) // 2 * 2
        size = int.from_bytes(body[at : at + 4], "big")
        block, at = body[at + 4 : at + 4 + size], at + 4 + size + size % 2
        i = 0
        while number == 0x0404 and i + 5 <= len(block) and block[i] == 0x1C:
            n = int.from_bytes(block[i + 3 : i + 5], "big")
            if block[i + 1] == 2 and block[i + 2] in IPTC:
                yield "IPTC", IPTC[block[i + 2]], block[i + 5 : i + 5 + n].decode("utf-8", "replace")
            i += 5 + n


#: Bytes of a compressed text that are read; no limit, but a text beyond the limit of a file is none.
INFLATED = 200 << 20
# Fixed value: a generator's label as the TC260 rule writes it.
AIGC = re.compile(rb'"?AIGC"?\s*[:={][^\x00]{0,400}?(Label|ContentProducer|ProduceID)')


def image_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    """Tags of EXIF and IPTC blocks, PNG texts and XMP packets."""
    if data[:2] in (b"II", b"MM"):
        yield from tiff_tags(data)
    if label := AIGC.search(data):
        yield RAW, "AIGC", label[0].decode("utf-8", "replace")
    for kind, body in image_parts(data):
        if kind == "E1" and body[:6] == b"Exif\0\0":
            yield from tiff_tags(body[6:])
        elif kind in ("eXIf", "EXIF"):
            yield from tiff_tags(body[6:] if body[:6] == b"Exif\0\0" else body)
        elif kind == "E1" and body[:28] == b"http://ns.adobe.com/xap/1.0/":
            yield from xmp_tags(body[29:])
        elif kind == "XMP ":
            yield from xmp_tags(body)
        elif kind == "ED":
            yield from iptc_tags(body)
        elif kind == "FE":
            yield "File", "Comment", body.decode("utf-8", "replace")
        elif kind == "tEXt" and b"\0" in body:
            key, value = body.split(b"\0", 1)
            yield "PNG", key.decode("latin-1"), value.decode("latin-1")
        elif kind == "iTXt" and body.count(b"\0") >= 4:
            key, rest = body.split(b"\0", 1)
            text = rest[2:].split(b"\0", 2)[2]
            text = _inflated(text) if rest[:1] == b"\1" else text
            if key == b"XML:com.adobe.xmp":
                yield from xmp_tags(text)
            else:
                yield "PNG", key.decode("latin-1"), text.decode("utf-8", "replace")
        elif kind == "zTXt" and b"\0" in body:
            key, rest = body.split(b"\0", 1)
            yield "PNG", key.decode("latin-1"), _inflated(rest[1:]).decode("latin-1")


def _inflated(body: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(body, INFLATED)
    except zlib.error:
        return b""


def whole7(b: bytes) -> int:
    """A length of four bytes of seven bits."""
    return (b[0] << 21) | (b[1] << 14) | (b[2] << 7) | b[3]


def id3_frames(data: bytes) -> Iterator[bytes]:
    """Frames of an ID3v2 tag, headers included."""
    at, end = 10, 10 + whole7(data[6:10])
    while at + 10 <= min(end, len(data)) and data[at : at + 4].strip(b"\0"):
        size = whole7(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        yield data[at : at + 10 + size]
        at += 10 + size


def id3_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    """Frames of an ID3v2 tag: text frames, owners of private and file identifiers, comments, user texts and links.

    A frame that may occur more than once is named with what tells it apart, after a colon.
    """
    if data[:3] != b"ID3" or len(data) < 10:
        return
    codes = {0: ("latin-1", b"\0"), 1: ("utf-16", b"\0\0"), 2: ("utf-16-be", b"\0\0"), 3: ("utf-8", b"\0")}
    for frame in id3_frames(data):
        name, body = frame[:4].decode("latin-1"), frame[10:]
        if name in ("PRIV", "UFID"):
            owner, _, rest = body.partition(b"\0")
            yield "ID3", f"{name}:{owner.decode('latin-1')}", rest.decode("latin-1")
        elif name[:1] == "W" and name != "WXXX":
            yield "ID3", name, body.decode("latin-1").strip("\0")
        elif name == "APIC":
            yield "ID3", "APIC:", ""
        elif body:
            code, end = codes.get(body[0], codes[0])
            text = body[4 if name == "COMM" else 1 :]
            if name in ("TXXX", "WXXX", "COMM"):
                at = next((i for i in range(0, len(text), len(end)) if text[i : i + len(end)] == end), len(text))
                about, text = text[:at].decode(code, "replace"), text[at + len(end) :]
                name = f"{name}:{about}" + (f":{body[1:4].decode('latin-1')}" if name == "COMM" else "")
                code = "latin-1" if name[:4] == "WXXX" else code
            yield "ID3", name, text.decode(code, "replace").strip("\0").replace("\0", "/")


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the content of each box of a media container."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, name, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield name, at + head, min(end, at + size)
        at += size


def box(data: bytes, *path: bytes, at: int = 0, end: int | None = None) -> tuple[int, int] | None:
    """Where the content of the first box at a path of names lies."""
    for name, a, b in boxes(data, at, end):
        if name == path[0]:
            return (a, b) if len(path) == 1 else box(data, *path[1:], at=a, end=b)
    return None


def _since_1904(data: bytes, at: int) -> str:
    """The time of creation in a header box, as text; empty where it says none."""
    n = int.from_bytes(data[at + 4 : at + 12] if data[at : at + 1] == b"\1" else data[at + 4 : at + 8], "big")
    if not n or n > 1 << 34:
        return ""
    return (datetime(1904, 1, 1) + timedelta(seconds=n)).strftime("%Y-%m-%dT%H:%M:%S.000000Z")


def _items(data: bytes, at: int, end: int) -> Iterator[tuple[int | bytes, str, bytes]]:
    """Number or name, free name and value of each item of a list box."""
    for name, a, b in boxes(data, at, end):
        free = {n: data[x + 4 : y].decode("utf-8", "replace") for n, x, y in boxes(data, a, b) if n in (b"mean", b"name")}
        for n, x, y in boxes(data, a, b):
            if n == b"data":
                yield name, ":".join(free[k] for k in (b"mean", b"name") if k in free), data[x : x + 4] + data[x + 8 : y]


def _value(raw: bytes) -> str:
    """The value of an item as text: a type of four bytes, then UTF-8, a whole number or bytes."""
    kind, body = int.from_bytes(raw[:4], "big") & 0xFFFFFF, raw[4:]
    if kind in (21, 22, 0) and 0 < len(body) <= 8 and not (kind == 0 and len(body) > 4):
        return str(int.from_bytes(body, "big", signed=kind == 21))
    return body.decode("utf-8", "replace").strip("\0")


# User data boxes and the names they go by.
USER_DATA = {b"\xa9xyz": "location", b"\xa9ART": "artist", b"\xa9nam": "title", b"\xa9too": "encoder", b"\xa9swr": "encoder", b"\xa9day": "date", b"\xa9cmt": "comment", b"\xa9mak": "make", b"\xa9mod": "model", b"\xa9cpy": "copyright", b"\xa9aut": "author", b"cprt": "copyright", b"auth": "author", b"loci": "location", b"xid ": "xid"}
# Subtitle codecs by the name of their samples.
SUBTITLES = {b"tx3g": "mov_text", b"text": "mov_text", b"c608": "eia_608"}
# Handlers that say nothing, without blanks.
PLAIN_HANDLERS = ("videohandler", "soundhandler", "datahandler", "subtitlehandler", "coremediavideo", "coremediaaudio")


def mp4_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    """Tags of a media container, each name once, the file's before its tracks'; then tracks of neither sound nor picture.

    The file's tags are user data, item lists and the list of named keys, whose names may be anything (as phones write
    place, make, model and software there).
    """
    seen: set[str] = set()
    moov = box(data, b"moov")
    if not moov:
        return

    def first(grp: str, name: str, value: str) -> Iterator[tuple[str, str, str]]:
        name = name.lower()
        if name == "handler_name" and value.replace(" ", "").lower() in PLAIN_HANDLERS:
            return
        if name not in seen and value:
            seen.add(name)
            yield grp, name, value

    yield from (x for y in _file_tags(data, *moov) for x in first("format", *y))
    tracks = [(a, b) for n, a, b in boxes(data, *moov) if n == b"trak"]
    odd = []
    for i, (a, b) in enumerate(tracks):
        media = box(data, b"mdia", at=a, end=b)
        if not media:
            continue
        header, handler = box(data, b"mdhd", at=media[0], end=media[1]), box(data, b"hdlr", at=media[0], end=media[1])
        if header:
            yield from first("stream", "creation_time", _since_1904(data, header[0]))
        kind = data[handler[0] + 8 : handler[0] + 12] if handler else b""
        if handler:
            name = data[handler[0] + 24 : handler[1]]
            name = name[1:] if name[:1] and name[0] == len(name) - 1 else name  # older files give its length
            yield from first("stream", "handler_name", name.decode("utf-8", "replace").strip("\0"))
        sample = box(data, b"minf", b"stbl", b"stsd", at=media[0], end=media[1])
        codec = data[sample[0] + 12 : sample[0] + 16] if sample else b""
        if kind in (b"meta", b"tmcd", b"data", b"hint", b"sbtl", b"subt", b"text", b"clcp") or codec in (b"tmcd", b"mebx"):
            odd.append(("streams", str(i), f"{SUBTITLES.get(codec, '?')} stream #{i}"))
    yield from odd


def _file_tags(data: bytes, at: int, end: int) -> Iterator[tuple[str, str]]:
    for name, a, b in boxes(data, at, end):
        if name == b"mvhd":
            yield "creation_time", _since_1904(data, a)
        elif name == b"udta":
            for n, x, y in boxes(data, a, b):
                if n == b"meta":
                    yield from _list_tags(data, x, y)
                elif n == b"loci":
                    place = data[x + 6 : y].partition(b"\0")[2]
                    if len(place) >= 13:
                        east, north = (int.from_bytes(place[k : k + 4], "big", signed=True) / 65536 for k in (1, 5))
                        yield "location", f"{north:+08.4f}{east:+09.4f}/"
                elif n in USER_DATA:
                    body = data[x:y]
                    yield USER_DATA[n], (body[4:] if n[:1] == b"\xa9" else body[6:]).decode("utf-8", "replace").strip("\0")
        elif name == b"meta":
            yield from _list_tags(data, a, b)


def _list_tags(data: bytes, at: int, end: int) -> Iterator[tuple[str, str]]:
    """Item list of a meta box, by short names or by the box's own table of keys."""
    at += 0 if data[at + 4 : at + 8] == b"hdlr" else 4
    keys, items = box(data, b"keys", at=at, end=end), box(data, b"ilst", at=at, end=end)
    if not items:
        return
    names = [data[x:y].decode("utf-8", "replace") for _, x, y in boxes(data, keys[0] + 8, keys[1])] if keys else []
    for name, free, raw in _items(data, *items):
        n = int.from_bytes(name, "big")
        if names and 1 <= n <= len(names):
            yield names[n - 1], _value(raw)
        elif free:
            yield free.rpartition(":")[2], _value(raw)
        elif name in USER_DATA:
            yield USER_DATA[name], _value(raw)


def m4a_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    """Items of a sound file's list under their own names, the shop's among them."""
    meta = box(data, b"moov", b"udta", b"meta")
    items = meta and box(data, b"ilst", at=meta[0] + (0 if data[meta[0] + 4 : meta[0] + 8] == b"hdlr" else 4), end=meta[1])
    for name, free, raw in _items(data, *items) if items else ():
        key = f"----:{free}" if free else name.decode("latin-1")
        yield "MP4", key, "" if key == "covr" else _value(raw)


def comment_tags(body: bytes, grp: str) -> Iterator[tuple[str, str, str]]:
    """Name and value of each entry in a comment block: the vendor's name, a count, then entries with their lengths."""
    at = 4 + int.from_bytes(body[:4], "little")
    n, at = int.from_bytes(body[at : at + 4], "little"), at + 4
    for _ in range(n):
        size = int.from_bytes(body[at : at + 4], "little")
        if at + 4 > len(body):
            return
        name, _, value = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        yield grp, name, "" if name.lower() == "metadata_block_picture" else value
        at += 4 + size


def flac_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    at = 4
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 127 == 4:
            yield from comment_tags(data[at + 4 : at + 4 + size], "FLAC")
        at += 4 + size
        if kind >= 128:
            return


def ogg_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    """The comments in the second packet, which may go on over many pages."""
    at, packet, seen = 0, [], 0
    while data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        lengths = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(lengths)
        for n in lengths:
            packet.append(data[at : at + n])
            at += n
            if n < 255:
                whole, packet, seen = b"".join(packet), [], seen + 1
                if whole[:7] == b"\x03vorbis":
                    yield from comment_tags(whole[7:], "Vorbis")
                elif whole[:8] == b"OpusTags":
                    yield from comment_tags(whole[8:], "Opus")
                if seen == 2:
                    return


# Chunks of an information list and the names they go by elsewhere.
INFO = {"IART": "artist", "ICMT": "comment", "ICOP": "copyright", "ICRD": "date", "IENG": "engineer", "INAM": "title", "ISFT": "software", "ITCH": "encoded_by"}


def wav_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    for kind, body in riff_chunks(data):
        if kind == "LIST" and body[:4] == b"INFO":
            for name, value in riff_chunks(b"RIFF\0\0\0\0" + body):
                if name in INFO:
                    yield "RIFF", INFO[name], value.rstrip(b"\0").decode("utf-8", "replace")
        elif kind in ("id3 ", "ID3 "):
            yield from id3_tags(body)


def audio_tags(data: bytes) -> Iterator[tuple[str, str, str]]:
    """Tags of any sound file by its first bytes; a tag may stand before a stream that has comments of its own."""
    if data[:3] == b"ID3" and len(data) >= 10:
        yield from id3_tags(data)
        data = data[10 + whole7(data[6:10]) :]
    if data[:4] == b"fLaC":
        yield from flac_tags(data)
    elif data[:4] == b"OggS":
        yield from ogg_tags(data)
    elif data[:4] == b"RIFF":
        yield from wav_tags(data)
    elif data[4:8] == b"ftyp":
        yield from m4a_tags(data)


def parts(files: DataFrame, reader: Callable[[bytes], Iterator[tuple[str, bytes]]], key: str = "path", content: str = "content") -> DataFrame:
    """key, ordinal, part_type, payload of each file; a null or broken file yields what could be read."""

    def scan(batches):
        for b in batches:
            for k, data in zip(b.column(key), b.column(content).to_pylist(), strict=True):
                rows = []
                try:
                    for row in reader(data or b""):
                        rows.append(row)  # noqa: PERF402 what came before the damage stays
                except DAMAGED:
                    pass
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(rows), k.type), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=[key, "ordinal", "part_type", "payload"])

    return files.select(key, content).mapInArrow(scan, f"{key} {files.schema[key].dataType.simpleString()}, {PART}")


def tags(files: DataFrame, reader: Callable[[bytes], Iterator[tuple[str, str, str]]], key: str = "path", content: str = "content") -> DataFrame:
    """key, ordinal, grp, tag, value of each file."""
    packed = parts(files, lambda data: ((f"{g}\t{t}", v.encode("utf-8", "replace")) for g, t, v in reader(data)), key, content)
    return packed.select(key, "ordinal", F.substring_index("part_type", "\t", 1).alias("grp"), F.substring_index("part_type", "\t", -1).alias("tag"), F.col("payload").cast("string").alias("value"))
