"""The engine: analyse and clean texts and files, each a DataFrame in and a DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import containers, documents, facts, kinds, media_hygiene, pdf, provenance, signals, tags, text
from .operators.findings import compare
from .sources.files import decoded
from .sources.shared import written


def analyze_text(df: DataFrame, keys: list[str], text_col: str = "text", detectors: tuple[str, ...] = text.DETECTORS) -> DataFrame:
    return text.detect_text(df, keys, text_col, detectors)


def clean_text(df: DataFrame, text_col: str = "text", **options: bool) -> DataFrame:
    return text.clean_text(df, text_col, options)


def verify_text(df: DataFrame, keys: list[str], text_col: str = "text", **options: bool) -> DataFrame:
    """Findings before and after cleaning, compared."""
    return text.verify_cleaning(df, keys, text_col, options)


def read(files: DataFrame) -> DataFrame:
    """The facts of files(path, content) that all rules work on, taken from the bytes in one pass and written once."""
    known = kinds.with_kind(files.select("path", "content")).where(F.col("kind").isNotNull())
    return written(facts.facts(known), "facts")


def findings(rows: DataFrame) -> DataFrame:
    """Findings of the facts of files, whatever their kinds: path, kind and the finding's columns."""
    tagged = {k: facts.tags(rows, k) for k in ("image", "audio", "video")}
    seconds = facts.of(rows, "audio", "second").select("path", F.col("name").cast("int").alias("second"), F.col("numbers").alias("freqs"))
    pdf_rows = facts.of(rows, "document", "pdf").select("path", "ordinal", F.col("name").alias("what"), "value")
    branches = {
        "text": [text.detect_text(facts.of(rows, "text", "text").select("path", F.col("value").alias("text")), ["path"])],
        "image": [
            tags.tag_findings(tagged["image"], "image"),
            provenance.manifest_findings(facts.parts(rows, "image"), tags=tagged["image"]),
            provenance.remote_findings(tagged["image"]),
            signals.seen_findings(facts.named(rows, "image", "seen", [f.split()[0] for f in signals.SEEN.split(", ")])),
        ],
        "audio": [tags.tag_findings(tagged["audio"], "audio"), signals.tone_findings(seconds), signals.lag_findings(facts.named(rows, "audio", "lag", ["lag", "height", "hertz"]).withColumn("lag", F.col("lag").cast("int")))],
        "video": [tags.tag_findings(tagged["video"], "video"), provenance.film_findings(facts.of(rows, "video", "manifest"))],
        "document": [documents.ooxml_findings(facts.parts(rows, "document")), pdf.pdf_findings(pdf_rows)],
    }
    each = [f.withColumn("kind", F.lit(kind)) for kind, frames in branches.items() for f in frames]
    out = each[0]
    for f in each[1:]:
        out = out.unionByName(f)
    return out


def analyze(files: DataFrame) -> DataFrame:
    """Findings of files(path, content): path, kind and the finding's columns. Every file is read once."""
    return findings(read(files))


def notes(files: DataFrame) -> DataFrame:
    """path, kind, note: what of files(path, content) could not be read or looked at, and files of no known kind."""
    known = kinds.with_kind(files.select("path", "content"))
    unknown = known.where("kind is null").select("path", "kind", F.lit("unsupported file type").alias("note"))
    return facts.notes(facts.facts(known.where("kind is not null"))).unionByName(unknown)


#: How much cleaning does; an unknown strength counts as standard.
STRENGTHS = ("light", "standard", "heavy")


def verify(files: DataFrame, strength: str = "standard") -> DataFrame:
    """Findings of files(path, content) before and after cleaning, compared: path, id, in_before, in_after, status."""
    done = written(clean(files, strength), "cleaned")
    return compare(analyze(files), analyze(done), ["path"])


def sizes(files: DataFrame, strength: str = "standard") -> DataFrame:
    """path, kind, status, in_bytes, out_bytes: what cleaning takes away."""
    before = files.select("path", F.length("content").alias("in_bytes"))
    return clean(files, strength).select("path", "kind", "status", F.length("content").alias("out_bytes")).join(before, "path")


def clean(files: DataFrame, strength: str = "standard") -> DataFrame:
    """path, kind, content, status of each file: texts normalised, office files and media without identifying metadata.

    A media file of status ``partial`` keeps what tells how it was made: manifests and generator labels are detected, not
    removed, and samples and pixels stay as they are. Damaged files, PDF files and other containers come back untouched,
    with status ``unsupported``. Strengths above light also drop an office file's links to outside content.
    """
    strength = strength if strength in STRENGTHS else "standard"
    done = media_hygiene.clean_files(kinds.with_kind(files.select("path", "content")), strength)
    done = done.withColumn("t", F.when(F.col("kind") == "text", decoded("content")))
    done = text.clean_text(done, "t", actions=False)
    body = F.when(F.col("kind") == "text", F.col("t").cast("binary")).otherwise(F.col("content"))
    return done.select("path", "kind", body.alias("content"), "status")
