"""Queries over small synthetic files, made here, for what the tables do not hold."""

from __future__ import annotations

import io
import struct
import wave
import zipfile
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import api
from ..operators import containers, kinds, signals


def docx() -> bytes:
    parts = {
        "[Content_Types].xml": '<Types><Override PartName="/docProps/custom.xml" ContentType="x"/></Types>',
        "_rels/.rels": '<Relationships><Relationship Id="r1" Target="http://t.example/p.png?u=1" TargetMode="External"/></Relationships>',
        "word/document.xml": '<w:document><w:p w:rsidR="00A1" w14:paraId="1A2B"><w:ins w:author="Kim" w:date="2024-01-02T03:04:05Z"><w:t>Body text</w:t></w:ins></w:p></w:document>',
        "word/settings.xml": '<w:settings><w:rsids><w:rsid w:val="00A1"/></w:rsids></w:settings>',
        "docProps/core.xml": "<c><dc:title>Plan</dc:title><dc:creator>Kim Doe</dc:creator><dcterms:created>2024-01-02</dcterms:created></c>",
        "docProps/app.xml": "<Properties><Application>Office</Application><Company>Acme</Company></Properties>",
        "docProps/custom.xml": '<Properties><property name="Client"/></Properties>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def png(extra: dict[str, bytes] | None = None) -> bytes:
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    more = b"".join(chunk(t.encode(), d) for t, d in (extra or {}).items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + more + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def wav(hertz: float | None, seconds: int = 4, rate: int = 44100) -> bytes:
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.05, rate * seconds)
    if hertz:
        x += 0.03 * np.sin(2 * np.pi * hertz * np.arange(len(x)) / rate)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def id3() -> bytes:
    frame = lambda n, b: n + struct.pack(">I", len(b)) + b"\0\0" + b
    body = frame(b"PRIV", b"shop\0user-173") + frame(b"UFID", b"http://db.example\0id-9") + frame(b"TPE1", b"\0Kim Doe") + frame(b"TSSE", b"\0enc 1.0")
    n = len(body)
    return b"ID3\x03\0\0" + bytes([(n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127]) + body


def exif() -> bytes:
    """A little TIFF structure with an artist, a camera serial number and a latitude."""
    artist, serial = b"Kim Doe\0", b"SN-12345\0"
    main = 8
    camera = main + 2 + 3 * 12 + 4
    place = camera + 2 + 12 + 4
    data = place + 2 + 2 * 12 + 4
    e = lambda tag, kind, n, v: struct.pack("<HHI", tag, kind, n) + (v if isinstance(v, bytes) else struct.pack("<I", v))
    out = b"II*\0" + struct.pack("<I", main)
    out += struct.pack("<H", 3) + e(0x013B, 2, len(artist), data) + e(0x8769, 4, 1, camera) + e(0x8825, 4, 1, place) + b"\0" * 4
    out += struct.pack("<H", 1) + e(0xA431, 2, len(serial), data + len(artist)) + b"\0" * 4
    out += struct.pack("<H", 2) + e(1, 2, 2, b"N\0\0\0") + e(2, 5, 3, data + len(artist) + len(serial)) + b"\0" * 4
    return out + artist + serial + struct.pack("<6I", 52, 1, 31, 1, 12, 1)


def pdf() -> bytes:
    """One page with hidden text, a tracked link, a script, an attachment, a metadata packet, docinfo and a trailer ID."""
    shown = zlib.compress(b"BT 3 Tr /F1 0.2 Tf (hidden) Tj ET")
    packet = b'<x:xmpmeta><rdf:RDF><rdf:Description xmpMM:DocumentID="uuid:7"><dc:creator><rdf:li>Kim Doe</rdf:li></dc:creator></rdf:Description></rdf:RDF></x:xmpmeta>'
    stream = lambda more, b: b"<<" + more + b"/Length %d>>stream\n" % len(b) + b + b"\nendstream"
    objects = [
        b"<</Type/Catalog/Pages 2 0 R/Metadata 6 0 R/OpenAction<</S/JavaScript/JS(app.alert)>>/Names<</EmbeddedFiles<</Names[(list.csv) 7 0 R]>>>>/PieceInfo<</Tool<<>>>>>>",
        b"<</Type/Pages/Kids[3 0 R]/Count 1>>",
        b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Metadata 6 0 R/Annots[5 0 R]>>",
        stream(b"/Filter/FlateDecode", shown),
        b"<</Type/Annot/A<</S/URI/URI(http://x.example/?utm_source=1)>>>>",
        stream(b"/Type/Metadata/Subtype/XML", packet),
        b"<</Type/Filespec/F(list.csv)>>",
        b"<</Author(Kim \\(K\\) Doe)/Producer<FEFF0054006F006F006C>/CreationDate(D:2024)>>",
    ]
    body = b"".join(b"%d 0 obj%sendobj\n" % (i + 1, o) for i, o in enumerate(objects))
    return b"%PDF-1.4\n" + body + b"trailer<</Root 1 0 R/Info 8 0 R/ID[<01><02>]>>\nstartxref\n0\n%%EOF"


def picture(carrier: bool, size: int = 256) -> bytes:
    """A BGR gradient with noise, with or without three weak waves."""
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:size, :size]
    a = 80 + 60 * x / size + 40 * y / size + rng.normal(0, 4, (size, size))
    if carrier:
        for u, v in ((31, 47), (53, -29), (71, 64)):
            a += 2.5 * np.sin(2 * np.pi * (u * x + v * y) / size)
    return np.repeat(np.clip(a, 0, 255).astype(np.uint8)[..., None], 3, axis=2).tobytes()


def dots(h: int = 600, w: int = 800, step: int = 60) -> bytes:
    a = np.full((h, w, 3), 255, np.uint8)
    for y in range(20, h - 2, step):
        for x in range(20, w - 2, step):
            a[y : y + 2, x : x + 2] = (60, 255, 255)
    return a.tobytes()


def xmp(more: str = "") -> bytes:
    return (
        '<?xpacket begin=""?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" '
        'xmlns:t="http://t.example/"><rdf:Description rdf:about="" t:DocumentID="uuid-7"><dc:creator><rdf:Seq><rdf:li>Kim Doe</rdf:li><rdf:li>Lee</rdf:li></rdf:Seq></dc:creator>'
        + more + '</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
    ).encode()


def jpeg(more: str = "") -> bytes:
    """Marker by marker: EXIF, XMP, IPTC, a comment, a table, samples with stuffing, and bytes after the end."""
    seg = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    line = b"\x1c\x02\x50\x00\x07Kim Doe"
    iptc = b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(line)) + line
    head = seg(0xE1, b"Exif\0\0" + exif()) + seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + xmp(more)) + seg(0xED, iptc) + seg(0xFE, b"by Kim")
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0") + head + seg(0xDB, b"\xff\xd9table") + seg(0xDA, b"scan") + b"ab\xff\x00\xff\xd0cd" + seg(0xC4, b"\xff\xd9more") + seg(0xDA, b"scan") + b"ef\xff\xd9" + b"tail"


def comments(*entries: str) -> bytes:
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    return text("vendor") + struct.pack("<I", len(entries)) + b"".join(map(text, entries))


def flac() -> bytes:
    block = lambda kind, b: bytes([kind]) + struct.pack(">I", len(b))[1:] + b
    return b"fLaC" + block(0, b"i" * 34) + block(3, b"s" * 18) + block(128 | 4, comments("ARTIST=Kim Doe", "ENCODER=enc 1")) + b"\xff\xf8samples"


def ogg() -> bytes:
    page = lambda lengths, b: b"OggS" + b"\0" * 22 + bytes([len(lengths)]) + bytes(lengths) + b
    tags = b"OpusTags" + comments("ARTIST=" + "Kim" * 100)
    return page([8], b"OpusHead") + page([255], tags[:255]) + page([len(tags) - 255], tags[255:]) + page([4], b"data")


def tagged_wav() -> bytes:
    plain, tag = wav(None, 1), b"INFOIART\x07\0\0\0Kim Doe\0"
    body = plain[8:] + b"LIST" + struct.pack("<I", len(tag)) + tag
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _box(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + name + body


def mp4() -> bytes:
    place = _box(b"\xa9xyz", b"\0\x10\0\0+52.5+013.4/")
    moov = _box(b"moov", _box(b"mvhd", b"\0\0\0\0" + b"\x11" * 8 + b"\0\0\3\xe8") + _box(b"udta", place))
    return _box(b"ftyp", b"isom\0\0\0\0") + moov + _box(b"mdat", b"samples")


def phone_film() -> bytes:
    """A film as phones write it: named keys, and tracks of which one holds timed metadata."""
    keys = {"com.apple.quicktime.location.ISO6709": "+52.5+013.4/", "com.apple.quicktime.make": "Maker", "com.apple.quicktime.artist": "Kim Doe", "com.apple.quicktime.content.identifier": "0A1B2C3D-0000-1111-2222-333344445555"}
    item = lambda i, v: _box(struct.pack(">I", i), _box(b"data", b"\0\0\0\1\0\0\0\0" + v.encode()))
    table = _box(b"keys", b"\0" * 4 + struct.pack(">I", len(keys)) + b"".join(_box(b"mdta", k.encode()) for k in keys))
    listed = _box(b"ilst", b"".join(item(i + 1, v) for i, v in enumerate(keys.values())))
    meta = _box(b"meta", _box(b"hdlr", b"\0" * 8 + b"mdta" + b"\0" * 13) + table + listed)
    handler = lambda kind, name: _box(b"hdlr", b"\0" * 8 + kind + b"\0" * 12 + name + b"\0")
    samples = lambda codec: _box(b"minf", _box(b"stbl", _box(b"stsd", b"\0" * 4 + struct.pack(">I", 1) + _box(codec, b"\0" * 8))))
    track = lambda kind, name, codec: _box(b"trak", _box(b"mdia", handler(kind, name) + samples(codec)))
    tracks = track(b"vide", b"VideoHandler", b"avc1") + track(b"meta", b"Lens 7", b"mebx")
    return _box(b"ftyp", b"qt  \0\0\0\0") + _box(b"moov", _box(b"mvhd", b"\0" * 4 + struct.pack(">II", 3_786_912_000, 0)) + meta + tracks) + _box(b"mdat", b"s")


def bought_song() -> bytes:
    item = lambda n, kind, v: _box(n, _box(b"data", struct.pack(">II", kind, 0) + v))
    free = _box(b"----", _box(b"mean", b"\0" * 4 + b"com.shop") + _box(b"name", b"\0" * 4 + b"UUID") + _box(b"data", struct.pack(">II", 1, 0) + b"u-7"))
    listed = item(b"apID", 1, b"kim@mail.example") + item(b"cnID", 21, struct.pack(">I", 173)) + item(b"purd", 1, b"2024-01-02") + item(b"\xa9nam", 1, b"Song") + item(b"covr", 13, b"\xff\xd8") + free
    meta = _box(b"meta", b"\0" * 4 + _box(b"hdlr", b"\0" * 8 + b"mdir" + b"\0" * 13) + _box(b"ilst", listed))
    return _box(b"ftyp", b"M4A \0\0\0\0") + _box(b"moov", _box(b"udta", meta)) + _box(b"mdat", b"s")


def media(spark: SparkSession) -> DataFrame:
    rows = [
        ("m/photo.jpg", jpeg()), ("m/made.jpg", jpeg("<t:DigitalSourceType>trainedAlgorithmicMedia</t:DigitalSourceType>")), ("m/place.png", png({"eXIf": exif(), "tIME": b"\0" * 7, "iTXt": b"XML:com.adobe.xmp\0\0\0\0\0" + xmp()})),
        ("m/packed.png", png({"zTXt": b"Author\0\0" + zlib.compress(b"Kim Doe")})), ("m/remote.png", png({"iTXt": b"XML:com.adobe.xmp\0\0\0\0\0" + xmp("<t:provenance>https://x.example/c2pa/1</t:provenance>")})),
        ("m/song.mp3", id3() + b"\xff\xfbframes" + b"TAG" + b"\0" * 125), ("m/song.flac", flac()), ("m/song.ogg", ogg()), ("m/song.wav", tagged_wav()), ("m/film.mp4", mp4()), ("m/phone.mov", phone_film()), ("m/bought.m4a", bought_song()), ("m/cut.png", png({"eXIf": exif()})[:60]), ("m/none.jpg", None),
    ]
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary")


def files(spark: SparkSession) -> DataFrame:
    rows = [
        ("a/plan.docx", docx()), ("a/plain.png", png()), ("a/signed.png", png({"caBX": b"jumbc2pa by Digimarc"})), ("a/place.png", png({"eXIf": exif()})),
        ("a/made.png", png({"tEXt": b"parameters\0steps 20, Stable Diffusion"})), ("a/tone.wav", wav(18500)), ("a/noise.wav", wav(None)), ("a/song.mp3", id3()), ("a/note.pdf", pdf()),
        ("a/hello.txt", "he​llo pаssword  x".encode()), ("a/bm.txt", b"BM is not always a picture"), ("a/movie.mp4", b"\0\0\0\x10ftypisom\0\0\0\0"), ("a/still.avif", b"\0\0\0\x10ftypavif\0\0\0\0"), ("a/odd.bin", b"\xff\xfe\x00\x81"),
    ]
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def pictures(spark: SparkSession) -> DataFrame:
    rows = [("plain", 256, 256, 3, picture(False)), ("carrier", 256, 256, 3, picture(True)), ("dots", 600, 800, 3, dots())]
    return spark.createDataFrame([(a, h, w, c, bytearray(d)) for a, h, w, c, d in rows], "origin string, height int, width int, nChannels int, data binary")


_FOUND = ("path", "kind", "id", "severity")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kind_dispatch": lambda s, d: kinds.with_kind(files(s)).select("path", "kind"),
    "file_findings": lambda s, d: api.analyze(files(s)).select(*_FOUND),
    "file_cleaning": lambda s, d: api.clean(files(s)).select("path", "kind", "status"),
    "media_findings": lambda s, d: api.analyze(media(s)).select(*_FOUND),
    "media_hygiene": lambda s, d: api.clean(media(s)).select("path", "kind", "status"),
    "png_chunks": lambda s, d: containers.parts(files(s), containers.png_chunks).select("path", "ordinal", "part_type"),
    "picture_findings": lambda s, d: signals.picture_findings(pictures(s)).select("origin", "id", "severity"),
}

#: Severity of each finding that the synthetic files have.
_SEVERITY = {
    "high": "exif-gps device-serial owner-identity purchase-identity location-gps c2pa-manifest remote-content pdf-javascript zero-width homoglyphs printer-dots",
    "medium": "unique-ids custom-properties tracked-changes ai-generator-label c2pa-remote-manifest device-tags ultrasonic-tone periodic-carrier pdf-xmp pdf-embedded-files pdf-remote-links pdf-hidden-text",
    "low": "software-tags timestamps embedded-picture unknown-streams whitespace-pattern pdf-trailer-id pdf-pieceinfo pdf-page-metadata",
    "info": "c2pa-soft-binding other-metadata",
}
#: What was put into each synthetic file, by hand: its kind, what cleaning makes of it, and what is to be found in it.
_HELD = {
    "a/plan.docx": ("document", "cleaned", "owner-identity timestamps software-tags custom-properties tracked-changes unique-ids remote-content"),
    "a/plain.png": ("image", "cleaned", ""),
    "a/signed.png": ("image", "partial", "c2pa-manifest c2pa-soft-binding"),
    "a/place.png": ("image", "cleaned", "exif-gps device-serial owner-identity"),
    "a/made.png": ("image", "partial", "ai-generator-label other-metadata"),
    "a/tone.wav": ("audio", "cleaned", "ultrasonic-tone"),
    "a/noise.wav": ("audio", "cleaned", ""),
    "a/song.mp3": ("audio", "cleaned", "purchase-identity owner-identity software-tags"),
    "a/note.pdf": ("document", "unsupported", "owner-identity software-tags timestamps pdf-xmp pdf-trailer-id pdf-embedded-files pdf-javascript pdf-remote-links pdf-hidden-text pdf-pieceinfo pdf-page-metadata"),
    "a/hello.txt": ("text", "cleaned", "zero-width homoglyphs whitespace-pattern"),
    "a/bm.txt": ("text", "cleaned", ""),
    "a/movie.mp4": ("video", "cleaned", ""),
    "a/still.avif": ("image", "unsupported", ""),
    "a/odd.bin": (None, "unsupported", ""),
    "m/photo.jpg": ("image", "cleaned", "exif-gps device-serial owner-identity unique-ids"),
    "m/made.jpg": ("image", "partial", "exif-gps device-serial owner-identity unique-ids ai-generator-label other-metadata"),
    "m/place.png": ("image", "cleaned", "exif-gps device-serial owner-identity unique-ids"),
    "m/packed.png": ("image", "cleaned", "owner-identity"),
    "m/remote.png": ("image", "partial", "owner-identity unique-ids other-metadata c2pa-remote-manifest"),
    "m/song.mp3": ("audio", "cleaned", "purchase-identity owner-identity software-tags"),
    "m/song.flac": ("audio", "cleaned", "owner-identity software-tags"),
    "m/song.ogg": ("audio", "unsupported", "owner-identity"),
    "m/song.wav": ("audio", "cleaned", "owner-identity"),
    "m/film.mp4": ("video", "cleaned", "location-gps timestamps"),
    "m/phone.mov": ("video", "partial", "location-gps owner-identity device-tags timestamps unique-ids unknown-streams"),
    "m/bought.m4a": ("audio", "cleaned", "purchase-identity embedded-picture unique-ids other-metadata"),
    "m/cut.png": ("image", "unsupported", ""),
    "m/none.jpg": (None, "unsupported", ""),
}
#: Chunks of the synthetic pictures between the first and the last two.
_CHUNKS = {"a/plain.png": [], "a/signed.png": ["caBX"], "a/place.png": ["eXIf"], "a/made.png": ["tEXt"]}
_SEEN = (("carrier", "periodic-carrier"), ("dots", "periodic-carrier"), ("dots", "printer-dots"))


def expected(name: str) -> str | None:
    """The rows that a query over synthetic files must give, stated by hand, as SQL."""
    rank = {id: severity for severity, ids in _SEVERITY.items() for id in ids.split()}
    folder = "m/" if name.startswith("media") else "a/"
    held = {p: v for p, v in _HELD.items() if p.startswith(folder)}
    if name == "kind_dispatch":
        rows = [{"path": p, "kind": kind} for p, (kind, _, _) in held.items()]
    elif name in ("file_findings", "media_findings"):
        rows = [{"path": p, "kind": kind, "id": i, "severity": rank[i]} for p, (kind, _, ids) in held.items() for i in ids.split()]
    elif name in ("file_cleaning", "media_hygiene"):
        rows = [{"path": p, "kind": kind, "status": status} for p, (kind, status, _) in held.items()]
    elif name == "png_chunks":
        rows = [{"path": p, "ordinal": i, "part_type": t} for p, more in _CHUNKS.items() for i, t in enumerate(["IHDR", *more, "IDAT", "IEND"])]
    else:
        rows = [{"origin": o, "id": i, "severity": rank[i]} for o, i in _SEEN]
    value = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"CAST({x} AS INTEGER)" if isinstance(x, int) else f"'{x}'"
    lines = ", ".join("(" + ", ".join(map(value, r.values())) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {lines}) AS t({', '.join(rows[0])})"
