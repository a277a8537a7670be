import io
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest

from sigtrace import api
from sigtrace.operators import containers, documents, facts, kinds, pdf, signals
from sigtrace.plans import fixtures
from sigtrace.sources import files as sources


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(r["path"], set()).add(r["id"])
    return out


def test_findings_of_files(spark):
    found = by_file(api.analyze(fixtures.files(spark)).collect())
    assert {"owner-identity", "timestamps", "software-tags", "custom-properties", "tracked-changes", "unique-ids", "remote-content"} <= found["a/plan.docx"]
    assert found["a/signed.png"] >= {"c2pa-manifest", "c2pa-soft-binding"} and "a/plain.png" not in found
    assert found["a/place.png"] >= {"exif-gps", "device-serial", "owner-identity"}
    assert "ai-generator-label" in found["a/made.png"]
    assert "ultrasonic-tone" in found["a/tone.wav"] and "a/noise.wav" not in found
    assert {"purchase-identity", "owner-identity", "software-tags"} <= found["a/song.mp3"]
    assert {"owner-identity", "software-tags", "timestamps", "pdf-xmp", "pdf-trailer-id", "pdf-embedded-files", "pdf-javascript", "pdf-remote-links", "pdf-hidden-text", "pdf-pieceinfo", "pdf-page-metadata"} == found["a/note.pdf"]
    assert {"zero-width", "homoglyphs", "whitespace-pattern"} <= found["a/hello.txt"]


def test_office_hygiene_round_trip(spark):
    docs = fixtures.files(spark).where("path = 'a/plan.docx'")
    out = api.clean(docs)
    left = by_file(api.analyze(out.select("path", "content")).collect()).get("a/plan.docx", set())
    assert left == set()
    parts = {r["part_type"]: bytes(r["payload"]) for r in containers.parts(out, containers.zip_parts).collect()}
    assert b"Body text" in parts["word/document.xml"] and b"<dc:title>Plan" in parts["docProps/core.xml"] and "docProps/custom.xml" not in parts


def test_kinds(spark):
    got = {r["path"]: r["kind"] for r in kinds.with_kind(fixtures.files(spark)).collect()}
    assert got["a/bm.txt"] == "text" and got["a/still.avif"] == "image" and got["a/movie.mp4"] == "video" and got["a/odd.bin"] is None


def test_long_text_cut_in_a_character(spark):
    body = ("a" * 999_999 + "\u00e9" * 5).encode()
    assert kinds.with_kind(spark.createDataFrame([("x", bytearray(body)), (None, None)], "path string, content binary")).orderBy("path").collect()[1]["kind"] == "text"


def test_broken_containers_give_what_can_be_read(spark):
    rows = [("z", fixtures.docx()[:200]), ("p", fixtures.png()[:40]), ("n", None), ("e", b"")]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in rows], "path string, content binary")
    assert containers.parts(df, containers.zip_parts).count() == 0
    assert {r["path"] for r in containers.parts(df, containers.png_chunks).collect()} == {"p"}


def test_pictures(spark):
    got = {}
    for r in signals.picture_findings(fixtures.pictures(spark)).collect():
        got.setdefault(r["origin"], set()).add(r["id"])
    assert "plain" not in got and got["carrier"] == {"periodic-carrier"} and "printer-dots" in got["dots"]


def test_spectral_lag_of_a_comb():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, 44100 * 4)
    x = x + 0.9 * np.roll(x, 200)
    lag, height, _ = signals.spectral_lag(x, 44100)
    assert 8 <= lag < 408 and height > 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x" * 100)
    assert [r["length"] for r in sources.read_files(spark, str(tmp_path), most=50).select("length").collect()] == [3]
    sources.write_results(spark.range(3), str(tmp_path / "out"), "r1")
    assert sources.read_results(spark, str(tmp_path / "out"), "r1").count() == 3
    assert spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary").select(sources.decoded("b").alias("t")).first()["t"] == "a\ufffdb"


def test_docx_parts_keep_order():
    assert [n for n, _ in containers.zip_parts(fixtures.docx())][0] == "[Content_Types].xml"
    assert [n for n, _ in containers.zip_parts(documents.cleaned(fixtures.docx()))] == [n for n, _ in containers.zip_parts(fixtures.docx()) if n != "docProps/custom.xml"]


def bmp(bgr: np.ndarray) -> bytes:
    h, w = bgr.shape[:2]
    lines = b"".join(r.tobytes() + b"\0" * (-3 * w % 4) for r in bgr[::-1])
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(lines), 0, 0, 54, 40, w, h, 1, 24, 0, len(lines), 0, 0, 0, 0) + lines


def filtered_png(bgr: np.ndarray, kind: int) -> bytes:
    """A PNG whose lines all use one filter, written by the format's own rule."""
    h, w = bgr.shape[:2]
    rgb = bgr[..., ::-1].astype(int)
    lines = []
    for y in range(h):
        left = np.vstack([np.zeros((1, 3), int), rgb[y, :-1]])
        up = rgb[y - 1] if y else np.zeros((w, 3), int)
        corner = np.vstack([np.zeros((1, 3), int), up[:-1]])
        p = left + up - corner
        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0, left, up, (left + up) // 2, np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))][kind]
        lines.append(bytes([kind]) + ((rgb[y] - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_pictures_decode_to_their_samples():
    a = np.random.default_rng(1).integers(0, 256, (9, 14, 3), dtype=np.uint8)
    assert (signals.decode_bmp(bmp(a)) == a).all()
    for kind in range(5):
        assert (signals.decode_png(filtered_png(a, kind)) == a).all()
    assert signals.decode_png(fixtures.png()).shape == (1, 1, 3) and signals.decode_bmp(b"BM") is None


def test_pixel_findings_from_files(spark):
    carrier = np.frombuffer(fixtures.picture(True), np.uint8).reshape(256, 256, 3)
    plain = np.frombuffer(fixtures.picture(False), np.uint8).reshape(256, 256, 3)
    dots = np.frombuffer(fixtures.dots(), np.uint8).reshape(600, 800, 3)
    rows = [("carrier.bmp", bmp(carrier)), ("plain.png", filtered_png(plain, 2)), ("dots.bmp", bmp(dots)), ("photo.jpg", fixtures.jpeg())]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "path string, content binary")
    found = by_file(api.analyze(df).collect())
    assert "periodic-carrier" in found["carrier.bmp"] and "plain.png" not in found and "printer-dots" in found["dots.bmp"]
    assert {r["path"] for r in api.notes(df).collect()} == {"photo.jpg"}


def test_large_spectra_show_the_same_peaks():
    small, large = signals.BACKGROUND, 4096
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:192, :256]
    a = 100 + rng.normal(0, 4, (192, 256)) + sum(2.5 * np.sin(2 * np.pi * (u * x / 256 + v * y / 192)) for u, v in ((31, 47), (53, -29), (71, 64)))
    a = np.clip(np.round(a), 0, 255)
    signals.BACKGROUND = large
    try:
        got = {p[:2] for p in signals.carrier_pairs(a)}
    finally:
        signals.BACKGROUND = small
    assert got >= {p[:2] for p in signals.carrier_pairs(a)[:3]} and len(got) >= 3


def test_blobs_and_spacing_against_plain_loops():
    rng = np.random.default_rng(3)
    mask = rng.random((40, 50)) < 0.3
    area, size, centre, _ = signals.blobs(mask)
    left, want = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    while left:
        todo, cells = [left.pop()], []
        while todo:
            a, b = todo.pop()
            cells.append((a, b))
            for q in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        c = np.array(cells)
        want.append((len(c), *(c.max(axis=0) - c.min(axis=0) + 1).tolist(), *c.mean(axis=0).round(6).tolist()))
    assert sorted(zip(area.tolist(), *size.T.tolist(), *centre.T.round(6).tolist(), strict=True)) == sorted(want)
    p = rng.random((300, 2)) * [500, 900]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert signals.spacing(p) == pytest.approx(np.median(d.min(axis=1)))


def test_content_is_read_once(spark, tmp_path):
    for name, data in (("a.png", fixtures.png({"eXIf": fixtures.exif()})), ("b.wav", fixtures.wav(18500)), ("c.pdf", fixtures.pdf())):
        (tmp_path / name).write_bytes(data)
    files = sources.read_files(spark, str(tmp_path))
    rows = facts.facts(kinds.with_kind(files.select("path", "content")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan binaryFile") == 1 and plan.count("MapInArrow") == 1
    plan = api.findings(api.read(files))._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "MapInArrow" not in plan and "Python" not in plan


def test_24_bit_sound_is_read():
    x = (np.sin(np.arange(48000) / 5) * 8_000_000).astype("<i4")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(3)
        w.setframerate(48000)
        w.writeframes(b"".join(v.tobytes()[:3] + b"\1\2\3" for v in x))
    rate, got = signals.wav_samples(out.getvalue())
    assert rate == 48000 and np.allclose(got, x / (1 << 23), atol=1e-6)


def test_archives_by_their_members(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("password/list.txt", "word/ xl/ ppt/")
    rows = [("a.zip", out.getvalue()), ("b", fixtures.docx()), ("c.txt", b"\xff\xfe\0\x81")]
    got = {r["path"]: r["kind"] for r in kinds.with_kind(spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "path string, content binary")).collect()}
    assert got == {"a.zip": None, "b": "document", "c.txt": None}


def test_pdf_strings_objects_and_damage():
    assert pdf.string(b"(a\\(b\\)\\101)") == "a(b)A" and pdf.string(b"<FEFF00E9>") == "\u00e9" and pdf.string(b"<4>") == "@"
    packed = zlib.compress(b"7 0 8 12 <</Type/Page>><</Author(Lee)>>")
    data = b"%PDF-1.5\n3 0 obj<</Type/ObjStm/N 2/First 9/Filter/FlateDecode>>stream\n" + packed + b"\nendstream\nendobj\n1 0 obj<</Type/Catalog>>endobj\n9 0 obj<</Type/XRef/Root 1 0 R/Info 8 0 R>>stream\n\nendstream endobj"
    assert ("info", "/Author=Lee") in list(pdf.facts(data))
    whole = fixtures.pdf()
    for n in range(0, len(whole), 7):
        list(pdf.facts(whole[:n]))


def test_verification_of_files(spark):
    rows = {(r["path"], r["id"]): r["status"] for r in api.verify(fixtures.files(spark)).collect()}
    assert rows["a/plan.docx", "owner-identity"] == "removed" and rows["a/signed.png", "c2pa-manifest"] == "remained" and rows["a/hello.txt", "zero-width"] == "removed"
    assert {r["path"]: r["out_bytes"] < r["in_bytes"] for r in api.sizes(fixtures.files(spark)).collect()}["a/place.png"]
