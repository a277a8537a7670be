"""Findings over tag tables (key, ordinal, grp, tag, value) of images, audio and video."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finding

# Names of picture tags by what they tell.
SERIALS = ("bodyserialnumber", "serialnumber", "lensserialnumber", "internalserialnumber", "cameraserialnumber", "lensid")
PEOPLE = ("ownername", "artist", "creator", "by-line", "copyright", "cameraownername", "author", "creatorcontactinfo", "personinimage")
UNIQUE = ("imageuniqueid", "documentid", "instanceid", "originaldocumentid", "preservedfilename", "originalrawfilename")
SOFTWARE = ("software", "creatortool", "processingsoftware", "historysoftwareagent")
# Groups and tags that describe the file or its layout, not its making.
LAYOUT_GROUPS = ("File", "Composite", "ExifTool")
LAYOUT = (
    "imagewidth", "imageheight", "bitdepth", "colortype", "compression", "filter", "interlace", "imagesize", "megapixels", "pixelsperunitx", "pixelsperunity", "pixelunits",
    "xresolution", "yresolution", "resolutionunit", "ycbcrpositioning", "ycbcrsubsampling", "bitspersample", "colorcomponents", "encodingprocess", "exifbyteorder",
    "backgroundcolor", "significantbits", "imagedata",
)
# Names of generators, and the tags in which they are looked for.
GENERATORS = r"(?i)Google AI|Made with Google AI|Gemini|DALL|OpenAI|Midjourney|Firefly|Stable Diffusion|ComfyUI|FLUX|Imagen|Grok"
GENERATOR_TAGS = ("credit", "description", "software", "creatortool", "title", "subject", "comment", "parameters", "prompt", "workflow", "usercomment", "imagedescription", "signature", "artist", "make", "model", "historysoftwareagent")
SETTINGS_TAGS = ("parameters", "prompt", "workflow", "comment")
#: Group of the tag that a reader makes of a label found in a picture's raw bytes.
RAW = "RAW"
# Names of sound tags by what they tell.
PURCHASE = ("apid", "ownr", "purd", "cprt", "xid ", "atid", "plid", "cnid", "sfid", "akid", "geid", "ufid", "priv")
ENCODERS = ("tenc", "tsse", "encoder", "encodedby", "software", "encoded_by", "lavf", "itunsmpb", "encoding_tool")
AUDIO_PEOPLE = ("artist", "author", "albumartist", "composer", "copyright", "tcop", "tpe1", "tpe2", "owner")
COVERS = ("apic", "covr", "metadata_block_picture")
# Names of video tags by what they tell.
VIDEO_PEOPLE = ("artist", "author", "copyright", "com.apple.quicktime.author", "com.apple.quicktime.artist", "com.apple.quicktime.copyright")
PLACES = ("com.apple.quicktime.location.iso6709", "location", "location-eng", "com.apple.quicktime.location")
DEVICES = ("com.apple.quicktime.make", "com.apple.quicktime.model", "com.apple.quicktime.software", "encoder", "handler_name", "com.android.version", "com.android.capture.fps", "com.apple.quicktime.hardware")
VIDEO_IDS = ("com.apple.quicktime.content.identifier", "uuid", "xid")
# Forms of identifiers.
WHOLE_UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SOME_UUID = r"[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{8,}"
HEX_ID = r"^(?:[0-9a-fA-F]{8}-){1,3}[0-9a-fA-F]{4,}$|^[0-9a-fA-F]{16,}$"
COMMENT_ID = r"(?i)^(PURCHASE|TRANSACTION|USER|ACCOUNT|.*UUID|ID$|CUSTOMER|ORDER)"

_DROPPED = "Dropped by -map_metadata -1"
_ON_ENCODE = "Stripped with all metadata on re-encode"
_ON_AUDIO = "Stripped via -map_metadata -1 re-encode"
# Name, severity, confidence, evidence rows (0: all) and remedy of each finding, in order of report.
IMAGE = {
    "exif-gps": ("GPS location metadata", "high", 1.0, 0, _ON_ENCODE),
    "device-serial": ("Device serial number", "high", 1.0, 0, _ON_ENCODE),
    "owner-identity": ("Owner/creator identity", "high", 1.0, 0, _ON_ENCODE),
    "unique-ids": ("Unique document/image IDs", "medium", 1.0, 0, _ON_ENCODE),
    "software-tags": ("Generator software tags", "low", 1.0, 0, _ON_ENCODE),
    "timestamps": ("Creation timestamps", "low", 1.0, 8, _ON_ENCODE),
    "ai-generator-label": ("AI generator label", "medium", 1.0, 0, _ON_ENCODE),
    "other-metadata": ("Other metadata", "info", 1.0, 0, _ON_ENCODE),
}
AUDIO = {
    "purchase-identity": ("Purchase/account identity atoms", "high", 1.0, 5, _ON_AUDIO),
    "owner-identity": ("Artist/author tags", "high", 1.0, 5, _ON_AUDIO),
    "unique-ids": ("IDs / custom frames", "medium", 0.9, 6, _ON_AUDIO),
    "software-tags": ("Encoder software tags", "low", 1.0, 5, _ON_AUDIO),
    "embedded-picture": ("Embedded cover art", "low", 1.0, 1, "Dropped via -vn -map_metadata -1"),
    "other-metadata": ("Other tags", "info", 1.0, 0, _ON_AUDIO),
}
VIDEO = {
    "location-gps": ("Location tags", "high", 1.0, 0, _DROPPED),
    "owner-identity": ("Author/artist tags", "high", 1.0, 0, _DROPPED),
    "device-tags": ("Device/encoder tags", "medium", 1.0, 0, _DROPPED),
    "timestamps": ("Creation timestamps", "low", 1.0, 0, _DROPPED),
    "unique-ids": ("Content/UUID tags", "medium", 1.0, 0, _DROPPED),
    "xmp-tags": ("XMP tags", "low", 1.0, 5, _DROPPED),
    "unknown-streams": ("Data/metadata tracks", "low", 1.0, 6, "Only audio+video mapped on clean"),
}
TABLES = {"image": IMAGE, "audio": AUDIO, "video": VIDEO}


def cut(c: Column, most: int = 200) -> Column:
    """At most so many characters, the last an ellipsis where something is cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def _case(when: Column, id: str | Column, e: Column) -> Column:
    return F.when(when, F.struct((F.lit(id) if isinstance(id, str) else id).alias("id"), e.alias("e")))


def _first(cases: list[tuple[Column, str, Column]], other: Column) -> Column:
    """The first case that holds, else other-metadata with the group that is counted."""
    out = None
    for when, id, e in cases:
        value = F.struct(F.lit(id).alias("id"), e.alias("e"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit("other-metadata").alias("id"), other.alias("e")))


def image_cases(grp: Column, tag: Column, value: Column) -> Column:
    """Bucket of a picture's tag and what it says of a generator, as an array of (id, evidence).

    Generators are looked for in every tag; a tag of the group RAW is nothing but a label's bytes.
    """
    t, v = F.lower(tag), F.lower(value)
    pair = lambda most: F.concat(tag, F.lit("="), cut(value, most))
    history = F.startswith(t, F.lit("history")) & ~F.contains(t, F.lit("software"))
    bucket = _first(
        [
            (F.startswith(t, F.lit("gps")), "exif-gps", pair(40)),
            (t.isin(*SERIALS), "device-serial", pair(40)),
            (t.isin(*PEOPLE), "owner-identity", pair(40)),
            (t.isin(*UNIQUE) | F.contains(t, F.lit("derivedfrom")) | history, "unique-ids", pair(40)),
            (t.isin(*SOFTWARE), "software-tags", pair(40)),
            (F.contains(t, F.lit("date")) | F.endswith(t, F.lit("time")), "timestamps", pair(40)),
        ],
        F.when(grp == "", "?").otherwise(grp),
    )
    label = "ai-generator-label"
    steps = F.contains(value, F.lit("Steps:")) | F.contains(value, F.lit("Sampler")) | (F.contains(value, F.lit("steps")) & F.contains(value, F.lit("seed")))
    job = F.lit("hf-job-id")
    said = F.array(
        F.when(grp != RAW, bucket),
        _case(F.contains(t, F.lit("digitalsourcetype")) & F.contains(v, F.lit("trainedalgorithmicmedia")), label, pair(80)),
        _case((t == "aisystemused") & (value != ""), label, F.concat(F.lit("AISystemUsed="), cut(value, 80))),
        _case(value.rlike(GENERATORS) & t.isin(*GENERATOR_TAGS), label, pair(80)),
        _case(t.isin(*SETTINGS_TAGS) & steps, label, F.concat(tag, F.lit(": "), cut(value, 100))),
        _case(F.contains(t, job) | F.contains(v, job), label, pair(80)),
        _case(t == "signature", label, F.concat(F.lit("Signature="), cut(value, 60))),
        _case((t == "artist") & F.trim(value).rlike(WHOLE_UUID), label, F.concat(F.lit("Artist (UUID-like)="), F.trim(value))),
        _case((t == "aigc") & (grp != RAW), label, F.lit("TC260 AIGC label: AIGC tag present")),
        _case(grp == RAW, label, F.concat(F.lit("TC260 AIGC label: "), cut(value, 120))),
    )
    return F.filter(said, lambda x: x.isNotNull())


def audio_cases(grp: Column, tag: Column, value: Column) -> Column:
    """Bucket of a sound file's tag; the first rule that holds counts."""
    t, short = F.lower(tag), F.substring(value, 1, 200)
    head, pair = F.substring_index(t, ":", 1), F.concat(tag, F.lit("="), short)
    user, remark = F.startswith(t, F.lit("txxx")) | F.startswith(t, F.lit("w")), F.startswith(t, F.lit("comm")) | (t == "comment")
    other = F.when(user, "tags").when(remark, "comments").otherwise(F.substring(F.substring_index(tag, ":", 1), 1, 20))
    found = _first(
        [
            (head.isin(*PURCHASE) | t.isin(*PURCHASE) | F.startswith(t, F.lit("priv")), "purchase-identity", pair),
            (user & (F.contains(short, F.lit("http")) | F.contains(short, F.lit("="))), "unique-ids", pair),
            (user, "other-metadata", other),
            (t.isin(*ENCODERS), "software-tags", pair),
            (remark & short.rlike("(?i)http|id[=:]|uuid"), "unique-ids", pair),
            (remark, "other-metadata", other),
            (F.substring_index(tag, "=", 1).rlike(COMMENT_ID), "unique-ids", pair),
            (short.rlike(SOME_UUID), "unique-ids", pair),
            (t.isin(*AUDIO_PEOPLE), "owner-identity", pair),
            (t.isin(*COVERS) | F.contains(t, F.lit("apic")), "embedded-picture", F.lit("Cover art carries its own metadata")),
        ],
        other,
    )
    return F.array(found)


def video_cases(grp: Column, tag: Column, value: Column) -> Column:
    """Buckets of a video's tag, which may be several; streams that are neither sound nor picture come as tags too."""
    t = F.lower(tag)
    pair = lambda most: F.concat(t, F.lit("="), F.substring(value, 1, most))
    is_tag = grp != "streams"
    said = F.array(
        _case(is_tag & t.isin(*PLACES), "location-gps", pair(60)),
        _case(is_tag & t.isin(*VIDEO_PEOPLE), "owner-identity", pair(60)),
        _case(is_tag & t.isin(*DEVICES), "device-tags", pair(60)),
        _case(is_tag & F.contains(t, F.lit("time")), "timestamps", pair(40)),
        _case(is_tag & (t.isin(*VIDEO_IDS) | F.trim(value).rlike(HEX_ID)), "unique-ids", pair(60)),
        _case(is_tag & F.contains(t, F.lit("xmp")), "xmp-tags", t),
        _case(~is_tag, "unknown-streams", value),
    )
    return F.filter(said, lambda x: x.isNotNull())


CASES: dict[str, Callable[[Column, Column, Column], Column]] = {"image": image_cases, "audio": audio_cases, "video": video_cases}


def _shown(id: str) -> Column:
    """The evidence of a bucket's tags, in their order."""
    return F.transform(F.filter("all", lambda x: x["id"] == id), lambda x: x["e"])


def _counts(groups: Column) -> Column:
    """Each group with how often it occurs, sorted."""
    return F.transform(F.array_sort(F.array_distinct(groups)), lambda g: F.concat(g, F.lit(":"), F.size(F.filter(groups, lambda x: x == g)).cast("string")))


def tag_findings(tags: DataFrame, kind: str, key: str = "path") -> DataFrame:
    """Findings of a tag table. One shuffle by file, of its few tags; a null value is an empty one.

    Evidence of a bucket lists its tags in their order, a picture's each once; other tags are counted by group.
    """
    tags = tags.where(~F.col("grp").isin(*LAYOUT_GROUPS) & ~F.lower("tag").isin(*LAYOUT)) if kind == "image" else tags
    cases = CASES[kind](F.coalesce("grp", F.lit("")), F.col("tag"), F.coalesce("value", F.lit("")))
    rows = tags.select(key, "ordinal", F.posexplode(cases).alias("pos", "c")).select(key, "ordinal", "pos", "c.id", "c.e")
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "pos", "id", "e"))).alias("all"))
    found = []
    for place, (id, (name, severity, confidence, most, removal)) in enumerate(TABLES[kind].items()):
        mine = _shown(id)
        shown = F.array_distinct(mine) if kind == "image" else mine
        shown = F.slice(shown, 1, most) if most else shown
        text = F.array_join(shown, ", " if id == "xmp-tags" else "; ")
        if id == "unknown-streams":
            text = F.concat(text, F.lit(" (mebx/tmcd tracks can carry per-frame metadata)"))
        if id == "other-metadata":
            counted = _counts(mine)
            total = F.size(F.filter("all", lambda x: x["id"] != "ai-generator-label"))
            text = F.concat(F.array_join(counted, ", "), F.lit(" ("), total.cast("string"), F.lit(" tags total)"))
        text = cut(text) if kind == "image" else F.substring(text, 1, 200)
        found.append(finding(place, id, name, severity, confidence, text, F.size(mine) > 0, category="metadata", removal=removal))
    return one.select(key, F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select(key, "f.*")
