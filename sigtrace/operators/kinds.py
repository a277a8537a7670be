"""Kind of a file from its first bytes, then from its name. First match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File name endings of each kind.
ENDINGS = {
    "image": ("png", "jpg", "jpeg", "webp", "tiff", "tif", "bmp", "gif", "avif", "heic"),
    "audio": ("wav", "flac", "mp3", "ogg", "opus", "m4a", "aac", "aiff", "aif"),
    "video": ("mp4", "mov", "m4v", "mkv", "webm", "avi"),
    "document": ("pdf", "docx", "xlsx", "pptx"),
}
#: An entry of a zip archive's directory whose name lies in one of the folders of an office file.
OFFICE = r"(?s)PK\x01\x02.{42}(?:word|xl|ppt)/"
KNOWN_BYTES = 1_000_000


def kind(content: str | Column, path: str | Column) -> Column:
    """image, audio, video, document, text or null. A text that merely begins with BM is not an image, and still-image
    brands of the shared media container are images. A character cut by the end of the sample does not spoil a text."""
    c = F.col(content) if isinstance(content, str) else content
    p = F.col(path) if isinstance(path, str) else path
    begins = lambda hexa: F.startswith(c, F.unhex(F.lit(hexa)))
    part = lambda at, n: F.hex(F.substring(c, at, n))
    ascii_hex = lambda s: s.encode().hex().upper()
    ending = F.lower(F.regexp_extract(F.coalesce(p, F.lit("")), r"\.([^./]+)$", 1))
    brand = F.lower(F.substring(c, 9, 4).cast("string"))
    riff = part(9, 4)
    head = F.substring(c, 1, KNOWN_BYTES)
    is_text = F.lit(False)
    for cut in range(4):
        is_text = is_text | F.is_valid_utf8(F.substring(head, F.lit(1), F.length(head) - cut).cast("string")) & ((F.length(c) > KNOWN_BYTES) | F.lit(cut == 0))
    is_office = F.decode(c, "ISO-8859-1").rlike(OFFICE)
    out = (
        F.when(c.isNull(), None)
        .when(begins("89504E470D0A1A0A") | begins("FFD8FF"), "image")
        .when(begins(ascii_hex("RIFF")) & (riff == ascii_hex("WEBP")), "image")
        .when(begins(ascii_hex("RIFF")) & (riff == ascii_hex("WAVE")), "audio")
        .when(begins(ascii_hex("RIFF")) & (riff == ascii_hex("AVI ")), "video")
        .when(begins(ascii_hex("GIF8")) | begins("49492A00") | begins("4D4D002A"), "image")
        .when(begins(ascii_hex("BM")) & (part(7, 4) == "00000000"), "image")
        .when(begins(ascii_hex("fLaC")) | begins(ascii_hex("ID3")) | begins("FFFB") | begins(ascii_hex("OggS")), "audio")
        .when(begins(ascii_hex("FORM")) & riff.isin(ascii_hex("AIFF"), ascii_hex("AIFC")), "audio")
        .when(begins("1A45DFA3"), "video")
        .when(begins(ascii_hex("%PDF")), "document")
        .when(begins("504B0304") & is_office, "document")
        .when((part(5, 4) == ascii_hex("ftyp")) & brand.isin("avif", "avis", "heic", "heix", "mif1"), "image")
        .when((part(5, 4) == ascii_hex("ftyp")) & (F.startswith(brand, F.lit("m4a")) | (ending == "m4a")), "audio")
        .when(part(5, 4) == ascii_hex("ftyp"), "video")
    )
    for name, ends in ENDINGS.items():
        out = out.when(ending.isin(*ends), name)
    return out.when(is_text, "text")


def with_kind(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    return files.withColumn("kind", kind(content, path))
