"""Findings and metadata hygiene of office documents, by the members of their archives."""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import decoded
from .findings import finding

_APP = "Application|AppVersion|Company|Manager|Template|HyperlinkBase|TotalTime"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: Members whose content the rules and the cleaner read.
READ = re.compile(r"^docProps/(core|app|custom)\.xml$|^word/(document|settings|people|comments[^/]*)\.xml$|\.rels$")

# Name, category, severity, confidence, entries shown (0: their number), separator, whether it can be removed,
# and remedy of each finding.
OFFICE = {
    "owner-identity": ("Document author props", "metadata", "high", 1.0, 5, "; ", True, "core.xml cleared (dc:title kept if present)"),
    "timestamps": ("Document timestamps", "metadata", "low", 1.0, 4, "; ", True, "created/modified/lastPrinted cleared"),
    "software-tags": ("App/company props", "metadata", "low", 1.0, 6, "; ", True, "app.xml fields removed"),
    "custom-properties": ("Custom properties", "metadata", "medium", 1.0, 8, ", ", True, "docProps/custom.xml deleted"),
    "thumbnail": ("Document thumbnail", "metadata", "low", 1.0, 1, "; ", True, "Thumbnail deleted"),
    "people": ("People list (comment authors)", "metadata", "high", 1.0, 6, ", ", True, "word/people.xml deleted"),
    "comments": ("Comments with authors/dates", "metadata", "medium", 1.0, 5, ", ", True, "Author names neutralized, dates dropped"),
    "tracked-changes": ("Tracked changes", "metadata", "medium", 1.0, 0, "", True, "Author names neutralized, dates dropped"),
    "unique-ids": ("Session/doc IDs", "metadata", "medium", 1.0, 8, "; ", True, "rsid/docId values stripped"),
    "remote-content": ("External/remote content", "tracking", "high", 0.95, 6, "; ", True, "External relationships removed (placeholder may remain)"),
    "macros": ("Embedded macros", "metadata", "medium", 1.0, 1, "; ", False, "Report only — macros not auto-removed"),
    "embedded-fonts": ("Embedded fonts", "metadata", "low", 1.0, 0, "", False, "Report only"),
}
# What stands where a member holds nothing to show, and after a number of entries.
PRESENT = {"custom-properties": "custom.xml present", "people": "people.xml present", "comments": "comments.xml present"}
COUNTED = {"tracked-changes": " w:ins/w:del elements with author/date", "embedded-fonts": " obfuscated font parts"}
# The forms in which members hold what is looked for.
AUTHORS = r"<(?:dc:creator|cp:lastModifiedBy|dc:description)>([^<]{0,120})"
TIMES = r"<(?:dcterms:created|dcterms:modified|cp:lastPrinted)[^>]*>([^<]{0,40})"
APP = r"<((?:Application|AppVersion|Template|Company|Manager|TotalTime|HyperlinkBase)>[^<]{0,80})"
CHANGES = r"(<w:(?:ins|del)\b[^>]*>)"
EXTERNAL = r'(Target="[^"]+"[^>]*TargetMode="External"|TargetMode="External"[^>]*Target="[^"]+")'


def ooxml_findings(parts: DataFrame, key: str = "path") -> DataFrame:
    """Findings over the members of office files (key, part_type: member name, payload).

    Each member is reduced to a few strings where it lies; one shuffle by file then gathers those few. An empty string
    tells only that a member is there.
    """
    name, t = F.col("part_type"), F.coalesce(decoded("payload"), F.lit(""))
    none = F.array().cast("array<string>")
    only = lambda cond, c: F.when(cond, c).otherwise(none)
    core, app, in_doc, in_set = (name == x for x in ("docProps/core.xml", "docProps/app.xml", "word/document.xml", "word/settings.xml"))
    there = lambda c: F.concat(F.array(F.lit("")), c)
    text = lambda x: F.trim(x) != ""
    authors = F.filter(_all(t, r'w:author="([^"]{0,60})"'), text)
    dated = F.size(_all(t, r'(w:date="[^"]+")')) > 0
    app_pairs = F.transform(F.filter(_all(t, APP), lambda x: F.trim(F.substring_index(x, ">", -1)) != ""), lambda x: F.replace(x, F.lit(">"), F.lit("=")))
    changed = F.filter(_all(t, CHANGES), lambda x: x.rlike(r'\sw:date="') | ((F.trim(F.regexp_extract(x, r'\sw:author="([^"]*)"', 1)) != "") & (F.regexp_extract(x, r'\sw:author="([^"]*)"', 1) != "Author")))
    number = lambda pattern, what: F.filter(F.array(F.concat(F.regexp_count(t, F.lit(pattern)).cast("string"), F.lit(what))), lambda x: ~F.startswith(x, F.lit("0 ")))
    own = F.transform(_all(t, r'w1[45]:((?:docId|paraId|textId)="[^"]{4,20})"'), lambda x: F.replace(x, F.lit('"'), F.lit("")))
    targets = F.transform(_all(t, EXTERNAL), lambda x: F.regexp_extract(x, r'Target="([^"]+)"', 1))
    marks = {
        "owner-identity": only(core, _all(t, AUTHORS)),
        "timestamps": only(core, _all(t, TIMES)),
        "software-tags": only(app, app_pairs),
        "custom-properties": only(name == "docProps/custom.xml", there(_all(t, r'name="([^"]{0,60})"'))),
        "thumbnail": only(F.startswith(name, F.lit("docProps/thumbnail")), F.array(F.lit("docProps/thumbnail present"))),
        "people": only(name == "word/people.xml", there(_all(t, r'w:author="([^"]{0,60})"'))),
        "comments": only((name == "word/comments.xml") & ((F.size(authors) > 0) | dated), there(F.array_sort(F.array_distinct(authors)))),
        "tracked-changes": only(in_doc, changed),
        "unique-ids": F.concat(only(in_set, F.concat(own, number(r"<w:rsid\b", " w:rsid entries"))), only(in_doc, number(r'\sw:rsid[A-Za-z]*="[^"]*"', " rsid attributes in document.xml"))),
        "remote-content": F.concat(only(F.endswith(name, F.lit(".rels")), targets), only(in_doc, _all(t, r"(INCLUDEPICTURE[^<]{0,120})"))),
        "macros": only(F.contains(name, F.lit("vbaProject")), F.array(F.lit("vbaProject.bin present"))),
        "embedded-fonts": only(name.rlike(r"fonts?/.*\.(odttf|fntdata)"), F.array(name)),
    }
    hits = F.array(*[F.when(F.size(v) > 0, F.struct(F.lit(i).alias("id"), v.alias("e"))) for i, v in marks.items()])
    rows = parts.select(key, "ordinal", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select(key, "ordinal", "h.id", "h.e")
    grouped = rows.groupBy(key, "id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "e"))), lambda x: x["e"])).alias("e"))
    cases = []
    for place, (i, (label, category, severity, sure, most, sep, removable, removal)) in enumerate(OFFICE.items()):
        shown = F.array_join(F.slice(F.filter("e", lambda x: x != "") if i in PRESENT else F.col("e"), 1, most), sep) if most else F.concat(F.size("e").cast("string"), F.lit(COUNTED[i]))
        shown = F.when(shown == "", PRESENT[i]).otherwise(shown) if i in PRESENT else shown
        cases.append(finding(place, i, label, severity, sure, F.substring(shown, 1, 200), F.col("id") == i, category=category, removable=removable, removal=removal))
    return grouped.select(key, F.explode(F.filter(F.array(*cases), lambda f: f.isNotNull())).alias("f")).select(key, "f.*")


#: Members that hygiene drops, and rewrites of the others: (member pattern, pattern, replacement).
DROPPED = re.compile(r"^docProps/(custom\.xml|thumbnail.*)$|^word/people\.xml$")
REWRITES = (
    (r"^docProps/app\.xml$", r"<(Application|AppVersion|Template|Company|Manager|TotalTime|HyperlinkBase)>[^<]*</\1>", ""),
    (r"^word/settings\.xml$", r"(?s)<w:rsids>.*?</w:rsids>|<w1[45]:docId[^>]*/>|\sw1[45]:(?:docId|paraId|textId)=\"[^\"]*\"", ""),
    (r"^word/(document|comments[^/]*)\.xml$", r'\s(?:w:rsid\w*|w14:paraId|w14:textId|w:date|w:initials)="[^"]*"', ""),
    (r"^word/(document|comments[^/]*)\.xml$", r'w:author="[^"]*"', 'w:author="Author"'),
    (r"^\[Content_Types\]\.xml$|\.rels$", r'<(?:Override|Relationship)\b[^>]*(?:docProps/custom\.xml|docProps/thumbnail[^"]*|people\.xml)[^>]*/>', ""),
)
#: Rewrites that only the strengths above light make.
STRONGER = ((r"\.rels$", r'<Relationship\b[^>]*TargetMode="External"[^>]*/>', ""),)
CORE = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/">'


def cleaned_member(name: str, body: bytes, strength: str = "standard") -> bytes:
    """A member without author, revision and remote data; the title stays. Members of no rule pass byte for byte."""
    if name == "docProps/core.xml":
        title = re.search(rb"<dc:title>[^<]*</dc:title>", body)
        return CORE.encode() + (title[0] if title else b"") + b"</cp:coreProperties>"
    rules = [(p, to) for where, p, to in (*REWRITES, *(STRONGER if strength != "light" else ())) if re.search(where, name)]
    if not rules:
        return body
    text = body.decode("utf-8", "replace")
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    return text.encode()


def cleaned(data: bytes, strength: str = "standard") -> bytes:
    """An office file packed again, its members in their order; raises what zipfile raises on a broken one."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            if not DROPPED.search(name):
                new.writestr(zipfile.ZipInfo(name), cleaned_member(name, old.read(name), strength), zipfile.ZIP_DEFLATED)
    return out.getvalue()
