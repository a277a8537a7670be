"""Objects of PDF files: a reader of what the rules need, and no more, and findings over what it reads."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finding
from .links import TRACKERS

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)endobj\b", re.DOTALL)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_SCRIPT = re.compile(rb"/JavaScript|/JS\b")
_KEY = re.compile(rb"\s*/([^\s/<>\[\]()]+)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def unescaped(raw: bytes) -> bytes:
    """The bytes of a string in parentheses."""
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw, flags=re.DOTALL)


def string(raw: bytes) -> str:
    """Text of a string as it stands in a file, in parentheses or in hexadecimal digits; names and numbers as they are."""
    if raw[:1] == b"(":
        body = unescaped(raw[1:-1])
    elif raw[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        body = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        return raw.decode("latin-1")
    return body[2:].decode("utf-16-be", "replace") if body[:2] == b"\xfe\xff" else body.decode("latin-1")


def value_at(body: bytes, at: int) -> bytes:
    """The value that begins at a place: a string, dictionary, array, reference, name or number, as it stands."""
    while at < len(body) and body[at : at + 1].isspace():
        at += 1
    begin = at
    if body[at : at + 2] == b"<<" or body[at : at + 1] in (b"[", b"("):
        deep, text = 0, 0
        while at < len(body):
            c, two = body[at : at + 1], body[at : at + 2]
            if text:
                text += (c == b"(") - (c == b")")
                at += 2 if c == b"\\" else 1
                if not text and not deep:
                    return body[begin:at]
                continue
            if two in (b"<<", b">>"):
                deep += 1 if two == b"<<" else -1
                at += 2
            else:
                text += c == b"("
                deep += (c == b"[") - (c == b"]")
                at += 1
            if not deep and not text:
                return body[begin:at]
        return body[begin:]
    m = re.compile(rb"<[0-9A-Fa-f\s]*>|\d+\s+\d+\s+R\b|/[^\s/<>\[\]()]*|[^\s/<>\[\]()]+").match(body, at)
    return m[0] if m else b""


class File:
    """Objects of a PDF file by number, those in object streams too; the last of a number counts. Encrypted strings stay so."""

    def __init__(self, data: bytes):
        self.data, self.objects, self.trailer = data, {}, b""
        for m in _OBJECT.finditer(data):
            self.objects[int(m[1])] = m[3]
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body)
            if re.search(rb"/Type\s*/XRef\b", body) and b"/Root" in body:
                self.trailer = body
        for m in re.finditer(rb"\btrailer\b(.*?)(?=startxref|\Z)", data, re.DOTALL):
            self.trailer = m[1]

    def _unpack(self, body: bytes) -> None:
        raw, first = self.stream(body), re.search(rb"/First\s+(\d+)", body)
        if raw is None or not first:
            return
        head = [int(x) for x in raw[: int(first[1])].split()]
        starts = [int(first[1]) + x for x in head[1::2]] + [len(raw)]
        for number, a, b in zip(head[::2], starts, starts[1:], strict=False):
            self.objects.setdefault(number, raw[a:b])

    def stream(self, body: bytes) -> bytes | None:
        """A stream's bytes, inflated if they are deflated; None where there is none or its filter is another."""
        m = _STREAM.search(body)
        if not m:
            return None
        if b"/Filter" not in body[: m.start()]:
            return m[1]
        if b"/FlateDecode" not in body[: m.start()]:
            return None
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return None

    def get(self, body: bytes, name: bytes) -> bytes:
        """The value of a name in an object's own dictionary, a reference followed; empty where it is missing."""
        at = body.find(b"<<") + 2
        while at > 1:
            key = _KEY.match(body, at)
            if not key:
                break
            value = value_at(body, key.end())
            if key[1] == name:
                return self.follow(value)
            at = body.index(value, key.end()) + len(value)
        return b""

    def follow(self, value: bytes) -> bytes:
        for _ in range(20):
            m = _REFERENCE.fullmatch(value.strip())
            if not m:
                return value
            value = self.objects.get(int(m[1]), b"")
        return value

    def items(self, array: bytes) -> list[bytes]:
        """Members of an array as they stand."""
        out, at = [], 1
        while at < len(array) - 1:
            while at < len(array) and array[at : at + 1].isspace():
                at += 1
            v = value_at(array, at)
            if not v or array[at : at + 1] == b"]":
                break
            out.append(v)
            at += len(v)
        return out

    def pages(self) -> list[bytes]:
        return [b for b in self.objects.values() if re.search(rb"/Type\s*/Page(?![A-Za-z])", b)]


def facts(data: bytes) -> Iterator[tuple[str, str]]:
    """(what, value) of everything in a PDF file that a rule asks for."""
    f = File(data)
    root = f.get(f.trailer, b"Root")
    info = f.get(f.trailer, b"Info")
    for m in re.finditer(rb"/([A-Za-z0-9]+)\s*(?=[(<])", info):
        raw = value_at(info, m.end())
        if raw[:2] != b"<<":
            yield "info", f"/{m[1].decode()}={string(raw)}"
    xmp = f.stream(f.get(root, b"Metadata"))
    if xmp:
        yield "xmp", xmp.decode("latin-1")
    if tid := f.get(f.trailer, b"ID"):
        yield "id", tid.decode("latin-1")
    names = f.get(root, b"Names")
    if embedded := f.get(names, b"EmbeddedFiles"):
        listed = [string(x) for x in f.items(f.get(embedded, b"Names")) if x[:1] in (b"(", b"<") and x[:2] != b"<<"]
        yield "files", "\n".join(listed)
    pages = f.pages()
    actions = [names, f.get(root, b"OpenAction"), f.get(root, b"AA"), *(f.follow(r[0]) for v in (names, f.get(root, b"OpenAction")) for r in _REFERENCE.finditer(v))]
    if any(_SCRIPT.search(a) for a in actions) or any(b"/AA" in f.get(p, b"Annots") or _SCRIPT.search(p) for p in pages):
        yield "script", ""
    for page in pages:
        for note in f.items(f.get(page, b"Annots")):
            note = f.follow(note)
            action = f.get(note, b"A")
            if uri := f.get(action, b"URI") or f.get(note, b"URI"):
                yield "link", string(uri)
            if kind := f.get(action, b"S"):
                yield "action", kind.decode("latin-1")
        content = f.get(page, b"Contents")
        streams = [f.follow(x) for x in f.items(content)] if content[:1] == b"[" else [content]
        for shown in filter(None, map(f.stream, streams)):
            tiny = sum(float(x) < 0.5 for x in re.findall(rb"/F\S+\s+(\d+\.?\d*|\.\d+)\s+Tf", shown))
            yield "hidden", str(len(re.findall(rb"\b3\s+Tr\b", shown)) + tiny)
        if f.get(page, b"Metadata"):
            yield "page-metadata", ""
    if piece := f.get(root, b"PieceInfo"):
        yield "piece", ", ".join(x.decode("latin-1") for x in re.findall(rb"/[^\s/<>\[\]()]+(?=\s*(?:<<|\d))", piece[2:]))


# Name, category, severity, confidence, whether it can be removed, and remedy of each finding.
PDF = {
    "owner-identity": ("PDF identity (docinfo)", "metadata", "high", 1.0, True, "docinfo cleared"),
    "software-tags": ("PDF producer software", "metadata", "low", 1.0, True, "docinfo cleared"),
    "timestamps": ("PDF timestamps", "metadata", "low", 1.0, True, "docinfo cleared"),
    "pdf-xmp": ("PDF XMP metadata", "metadata", "medium", 1.0, True, "/Metadata stream deleted"),
    "pdf-trailer-id": ("PDF trailer /ID", "metadata", "low", 1.0, True, "Fresh random /ID on save (standard+)"),
    "pdf-embedded-files": ("Embedded files", "metadata", "medium", 1.0, True, "EmbeddedFiles name tree removed"),
    "pdf-javascript": ("JavaScript actions", "tracking", "high", 0.9, True, "OpenAction/AA JavaScript entries removed"),
    "pdf-remote-links": ("Remote/tracked links", "tracking", "medium", 0.9, True, "Heavy: query strings stripped; annotation fields cleared"),
    "pdf-hidden-text": ("Invisible text runs", "tracking", "medium", 0.8, False, "Report only — removing text runs risks altering the document"),
    "pdf-pieceinfo": ("Private /PieceInfo data", "metadata", "low", 1.0, True, "/PieceInfo deleted"),
    "pdf-page-metadata": ("Per-page /Metadata", "metadata", "low", 1.0, True, "Per-page /Metadata deleted"),
}
# What of a metadata packet is shown, and actions that lead elsewhere.
XMP = r'((?:Document|Instance|OriginalDocument)ID[^<"]{0,60}|dc:creator[^<]{0,120}|<dc:creator[^>]*>|<rdf:li>[^<]{0,120})'
ELSEWHERE = ("/Launch", "/GoToR", "/SubmitForm", "/ImportData")


def pdf_findings(rows: DataFrame, key: str = "path") -> DataFrame:
    """Findings over rows(key, ordinal, what, value) of facts(). One shuffle by file, of its few facts."""
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", "what", "value"))).alias("all"))
    of = lambda what: F.transform(F.filter("all", lambda x: x["what"] == what), lambda x: x["value"])
    some = lambda a: F.size(a) > 0
    join = lambda a, sep="; ": F.array_join(a, sep)
    # An entry without a value tells nothing.
    info = lambda pattern: F.filter(of("info"), lambda x: x.rlike(pattern) & ~F.endswith(x, F.lit("=")))
    owner, software, times = info("^/(Author|Creator)="), info("^/(Producer|CreatorTool)="), info("^/[^=]*Date[^=]*=")
    packet = F.slice(F.regexp_extract_all(F.get(of("xmp"), F.lit(0)), F.lit(XMP), F.lit(1)), 1, 5)
    shown = join(F.transform(packet, lambda x: F.substring(x, 1, 80)))
    tracked = lambda u: F.contains(u, F.lit("?")) | u.rlike(f"(?i){TRACKERS}")
    led = F.filter("all", lambda x: ((x["what"] == "link") & tracked(x["value"])) | ((x["what"] == "action") & x["value"].isin(*ELSEWHERE)))
    links = F.transform(led, lambda x: F.when(x["what"] == "link", F.substring(x["value"], 1, 100)).otherwise(F.concat(x["value"], F.lit(" action"))))
    hidden = F.aggregate(of("hidden"), F.lit(0), lambda a, x: a + x.cast("int"))
    names = join(F.slice(F.split(F.get(of("files"), F.lit(0)), "\n"), 1, 6), ", ")
    pages = F.size(of("page-metadata"))
    # The wording of the evidence.
    evidence: dict[str, tuple[Column, Column]] = {
        "owner-identity": (join(owner), some(owner)),
        "software-tags": (join(software), some(software)),
        "timestamps": (join(times), some(times)),
        "pdf-xmp": (F.when(shown == "", "XMP packet present").otherwise(shown), some(of("xmp"))),
        "pdf-trailer-id": (F.substring(F.get(of("id"), F.lit(0)), 1, 120), some(of("id"))),
        "pdf-embedded-files": (F.when(names == "", "EmbeddedFiles present").otherwise(names), some(of("files"))),
        "pdf-javascript": (F.lit("/JS or /JavaScript entries in catalog/page actions"), some(of("script"))),
        "pdf-remote-links": (join(F.slice(links, 1, 5)), some(links)),
        "pdf-hidden-text": (F.concat(hidden.cast("string"), F.lit(" invisible/near-zero-size text operators in content streams")), hidden > 0),
        "pdf-pieceinfo": (F.substring(F.get(of("piece"), F.lit(0)), 1, 120), some(of("piece"))),
        "pdf-page-metadata": (F.concat(pages.cast("string"), F.lit(" pages carry /Metadata streams")), pages > 0),
    }
    found = []
    for place, (id, (name, category, severity, sure, removable, removal)) in enumerate(PDF.items()):
        text, present = evidence[id]
        found.append(finding(place, id, name, severity, sure, F.substring(text, 1, 200), present, category=category, removable=removable, removal=removal))
    return one.select(key, F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select(key, "f.*")
