"""Provenance manifests in image and video containers: detection only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finding
from .tags import cut

# What a manifest's bytes may name, the makers of watermarks it may point to, and a film's manifest box.
NAMED = r"""c2pa\.[a-z_.]+|urn:uuid:[0-9a-f-]+|"?issuer"?\s*[:=][^,}"']*|CN=[^,\x00]+|O=[^,\x00]+|(?:Adobe|Google|OpenAI|Microsoft|Truepic|Leica|Samsung|Stability|Black Forest|ByteDance|Volcano)[A-Za-z ]*"""
VENDORS = r"(?i)TrustMark|Digimarc|Imatag|Steg\.?AI"
REMOTE = "(?i)c2pa|contentcredentials"
BOX = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
FIRST_BYTES = 4 << 20
# Name, severity, confidence, whether it can be removed, and remedy of each finding.
MANIFESTS = {
    "c2pa-manifest": ("C2PA Content Credentials", "high", 1.0, True, "Dropped on re-encode (manifest segment not copied)"),
    "c2pa-soft-binding": ("C2PA soft-binding watermark pointer", "info", 0.9, False, "Pixel transforms degrade soft-binding watermarks but cannot be verified"),
    "c2pa-remote-manifest": ("Remote C2PA manifest reference", "medium", 0.9, True, "Stripped with XMP metadata"),
}
POINTER = "Manifest references a soft-binding vendor (TrustMark/Digimarc/Imatag/Steg.AI) — an invisible watermark may be present"
FILM = ("C2PA manifest box", "high", 0.9, "C2PA uuid box / manifest bytes found in container", "Remux drops uuid boxes")


def _finding(place: int, id: str, evidence: Column, present: Column) -> Column:
    name, severity, sure, removable, removal = MANIFESTS[id]
    return finding(place, id, name, severity, sure, evidence, present, category="provenance", removable=removable, removal=removal)


def manifest_findings(parts: DataFrame, key: str = "path", tags: DataFrame | None = None) -> DataFrame:
    """Manifests among the parts of images, or tags of their boxes, and watermark vendors that a manifest names."""
    hit = ((F.col("part_type") == "EB") & (F.contains("payload", F.lit(b"jumb")) | F.contains("payload", F.lit(b"c2pa")))) | F.col("part_type").isin("caBX", "C2PA")
    body = F.decode("payload", "ISO-8859-1")
    strings = F.slice(F.regexp_extract_all(body, F.lit(f"({NAMED})"), F.lit(1)), 1, 5)
    rows = parts.where(hit).select(key, "ordinal", F.length("payload").alias("size"), strings.alias("strings"), body.rlike(VENDORS).alias("vendor"))
    one = rows.groupBy(key).agg(F.min_by(F.struct("size", "strings", "vendor"), "ordinal").alias("m"), F.lit(0).alias("boxes"))
    if tags is not None:
        boxes = tags.where(F.upper("grp").startswith("JUMBF")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("tag").rlike(VENDORS)).alias("named"))
        one = one.drop("boxes").join(boxes, key, "full_outer").withColumn("boxes", F.coalesce("n", F.lit(0)))
    vendor = F.coalesce("m.vendor", F.col("named") if tags is not None else F.lit(False), F.lit(False))
    size = F.when(F.col("m").isNotNull(), F.array(F.format_string("manifest %.1f KB", F.col("m.size") / 1024)))
    none = F.array().cast("array<string>")
    more = F.when(F.col("boxes") > 0, F.array(F.format_string("%d JUMBF tags", F.col("boxes"))))
    shown = F.concat(F.coalesce(size, none), F.coalesce("m.strings", none), F.coalesce(more, none))
    found = [_finding(8, "c2pa-manifest", cut(F.array_join(shown, "; ")), F.lit(True)), _finding(9, "c2pa-soft-binding", F.lit(POINTER), vendor)]
    return one.select(key, F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select(key, "f.*")


def remote_findings(tags: DataFrame, key: str = "path") -> DataFrame:
    """Pictures whose tags point to a manifest kept elsewhere; the first three such tags are shown."""
    hit = (F.lower("tag") == "provenance") | F.col("value").rlike(REMOTE)
    shown = F.concat(F.col("tag"), F.lit("="), cut(F.coalesce("value", F.lit("")), 80))
    one = tags.where(hit).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", shown.alias("e")))).alias("all"))
    found = _finding(10, "c2pa-remote-manifest", cut(F.array_join(F.slice("all.e", 1, 3), "; ")), F.lit(True))
    return one.select(key, F.explode(F.array(found)).alias("f")).select(key, "f.*")


def in_film(data: bytes) -> bool:
    """Whether a video holds the manifest's box identifier anywhere, or its name in the first 4 MiB."""
    return BOX in data or re.search(rb"c2pa", data[:FIRST_BYTES]) is not None


def film_findings(rows: DataFrame, key: str = "path") -> DataFrame:
    """A finding for each row of a film with a manifest."""
    name, severity, sure, evidence, removal = FILM
    found = finding(7, "c2pa-manifest", name, severity, sure, F.lit(evidence), F.lit(True), category="provenance", removal=removal)
    return rows.select(key, F.explode(F.array(found)).alias("f")).select(key, "f.*")


def video_manifest(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Findings of the videos themselves, in the JVM."""
    c = F.col(content)
    return film_findings(files.where(F.contains(c, F.lit(BOX)) | F.contains(F.substring(c, 1, FIRST_BYTES), F.lit(b"c2pa"))), key)
