import zlib

import pytest

from sigtrace import api
from sigtrace.operators import containers, media_hygiene
from sigtrace.plans import fixtures


def found(df):
    out = {}
    for r in api.analyze(df).collect():
        out.setdefault(r["path"], {})[r["id"]] = r["evidence"]
    return out


@pytest.fixture(scope="module")
def before(spark):
    return found(fixtures.media(spark))


@pytest.fixture(scope="module")
def cleaned(spark):
    return api.clean(fixtures.media(spark)).collect()


def test_tags_of_every_container(before):
    assert before["m/photo.jpg"].keys() >= {"exif-gps", "device-serial", "owner-identity", "unique-ids"}
    assert "creator=Kim Doe; Lee" in before["m/photo.jpg"]["owner-identity"] and "By-line=Kim Doe" in before["m/photo.jpg"]["owner-identity"]
    assert "ai-generator-label" in before["m/made.jpg"] and "c2pa-remote-manifest" in before["m/remote.png"]
    assert before["m/packed.png"]["owner-identity"] == "Author=Kim Doe"
    for path in ("m/song.mp3", "m/song.flac", "m/song.ogg", "m/song.wav"):
        assert "Kim" in before[path]["owner-identity"]
    assert "location-gps" in before["m/film.mp4"]
    phone = before["m/phone.mov"]
    assert phone.keys() == {"location-gps", "owner-identity", "device-tags", "timestamps", "unique-ids", "unknown-streams"}
    assert phone["device-tags"] == "com.apple.quicktime.make=Maker; handler_name=Lens 7" and phone["timestamps"].startswith("creation_time=2024-01-01T00:00:00.000000Z; ")  # every quicktime key has "time" in it
    assert phone["unknown-streams"] == "? stream #1 (mebx/tmcd tracks can carry per-frame metadata)"
    song = before["m/bought.m4a"]
    assert song["purchase-identity"] == "apID=kim@mail.example; cnID=173; purd=2024-01-02" and "embedded-picture" in song
    assert song["unique-ids"] == "----:com.shop:UUID=u-7" and song["other-metadata"] == "\u00a9nam:1 (6 tags total)"


def test_hygiene_leaves_no_personal_finding(spark, cleaned):
    status = {r["path"]: r["status"] for r in cleaned}
    assert len(cleaned) == 14 and {p for p, s in status.items() if s == "unsupported"} == {"m/song.ogg", "m/cut.png", "m/none.jpg"}
    assert {p for p, s in status.items() if s == "partial"} == {"m/made.jpg", "m/remote.png", "m/phone.mov"}
    after = found(spark.createDataFrame([(r["path"], r["content"]) for r in cleaned if r["status"] == "cleaned"], "path string, content binary"))
    assert after == {}


def test_labels_and_manifests_stay(spark, cleaned):
    kept = found(spark.createDataFrame([(r["path"], r["content"]) for r in cleaned if r["status"] == "partial"], "path string, content binary"))
    assert kept["m/phone.mov"].keys() == {"unknown-streams"}
    assert "ai-generator-label" in kept["m/made.jpg"] and "exif-gps" not in kept["m/made.jpg"] and "c2pa-remote-manifest" in kept["m/remote.png"]
    for data in (fixtures.png({"caBX": b"jumbc2pa"}), fixtures.png({"tEXt": b"parameters\0steps 20"})):
        assert media_hygiene.cleaned(data) == (data, "partial")


def test_samples_stay_byte_for_byte():
    jpeg = media_hygiene.cleaned(fixtures.jpeg())[0]
    assert jpeg.endswith(fixtures.jpeg()[fixtures.jpeg().index(b"\xff\xdb") : -4]) and b"Kim" not in jpeg
    assert media_hygiene.cleaned(fixtures.png({"eXIf": fixtures.exif()}))[0] == fixtures.png()
    assert media_hygiene.cleaned(fixtures.id3() + b"\xff\xfbframes")[0] == b"\xff\xfbframes"
    assert media_hygiene.cleaned(fixtures.tagged_wav())[0] == fixtures.wav(None, 1)
    flac = media_hygiene.cleaned(fixtures.flac())[0]
    assert flac.endswith(b"\xff\xf8samples") and flac[4 + 4 + 34] == 128 | 3
    film = media_hygiene.cleaned(fixtures.mp4())[0]
    assert len(film) == len(fixtures.mp4()) and film.endswith(b"samples") and b"52.5" not in film and b"\x11" not in film and b"\0\0\3\xe8" in film


def test_manifest_frames_of_a_tag_stay():
    frame = b"GEOB" + (20).to_bytes(4, "big") + b"\0\0" + b"\0application/c2pa\0\0x"
    song = fixtures.id3()
    size = containers.whole7(song[6:10]) + len(frame)
    song = song[:6] + bytes([0, 0, size >> 7, size & 127]) + song[10:] + frame + b"\xff\xfbframes"
    out, status = media_hygiene.cleaned(song)
    assert status == "partial" and frame in out and b"Kim" not in out and out.endswith(b"\xff\xfbframes")


def test_orientation_stays():
    tiff = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    out, status = media_hygiene.cleaned(fixtures.png({"eXIf": tiff}))
    assert status == "cleaned" and dict(containers.png_chunks(out))["eXIf"] == tiff
    part = dict(containers.png_chunks(out))["eXIf"]
    assert (b"eXIf" + part + zlib.crc32(b"eXIf" + part).to_bytes(4, "big")) in out


def test_cleaning_twice_changes_nothing():
    for data in (fixtures.jpeg(), fixtures.png({"eXIf": fixtures.exif()}), fixtures.flac(), fixtures.tagged_wav(), fixtures.mp4()):
        once = media_hygiene.cleaned(data)[0]
        assert media_hygiene.cleaned(once) == (once, "cleaned")


def test_damage_never_fails():
    for whole in (fixtures.jpeg(), fixtures.png({"eXIf": fixtures.exif()}), fixtures.flac(), fixtures.tagged_wav()[:300], fixtures.mp4(), fixtures.id3(), fixtures.ogg()):
        for n in range(0, len(whole), 3):
            body, status = media_hygiene.cleaned(whole[:n])
            assert status in ("cleaned", "partial", "unsupported")
            if status == "unsupported":
                assert body == whole[:n]
            for reader in (containers.image_tags, containers.audio_tags):
                try:
                    list(reader(whole[:n]))
                except (ValueError, IndexError, containers.struct.error):
                    pass  # parts() keeps what came before


def test_packets_with_document_types_are_not_read():
    assert list(containers.xmp_tags(b'<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>')) == []
