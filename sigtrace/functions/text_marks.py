"""Marks of a text as Column expressions: counts, evidence, positions. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import marks as M

# Ways in which markup hides what it holds.
HIDDEN = r"<span[^>]*display\s*:\s*none[^>]*>|font-size\s*:\s*0|color\s*:\s*transparent|<div[^>]*hidden"


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def times(text: Column, piece: str) -> Column:
    """How often a fixed string occurs: by the length that its removal takes, without a regex."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def odd(text: Column) -> Column:
    """The characters of a text that are not plain, in their order: all marks of single characters are among them.

    A text whose bytes are as many as its characters is ASCII and is not looked at.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lit("")).otherwise(F.regexp_replace(text, f"[{M.PLAIN}]+", ""))


def mixed_words(text: Column, odd_chars: Column | None = None) -> Column:
    """Words that hold an ASCII letter and a confusable one; the split into words is skipped without a confusable."""
    has = (odd(text) if odd_chars is None else odd_chars).rlike(f"[{M.confusable_class()}]")
    words = F.filter(F.regexp_extract_all(text, F.lit(f"([{M.LETTERS}]+)"), F.lit(1)), lambda w: F.octet_length(w) != F.length(w))
    words = F.filter(words, lambda w: w.rlike("[A-Za-z]") & w.rlike(f"[{M.confusable_class()}]"))
    return F.when(has, words).otherwise(F.array().cast("array<string>"))


def hidden_html(text: Column) -> Column:
    """Constructs that hide content; looked for only where a tag opens or closes."""
    pattern = f"(?i)({HIDDEN})"
    gate = F.contains(text, F.lit("<")) & text.rlike("(?i)</?[a-z]")
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))


def ends_in_space(text: Column) -> Column:
    """Whether some line ends in a space or tab."""
    inside = F.contains(text, F.lit(" \n")) | F.contains(text, F.lit("\t\n"))
    return inside | F.endswith(text, F.lit(" ")) | F.endswith(text, F.lit("\t"))


def counts(text: Column, o: Column) -> dict[str, Column]:
    """Named counts of a text whose odd characters are o; a null text counts as null, so it yields no finding.

    Counts of single characters look at the odd ones alone. What takes a regex over the whole text stands behind a test for
    a fixed string that any hit must contain.
    """
    on = lambda gate, n: F.when(text.isNull(), None).when(gate, n).otherwise(0)
    crlf = on(F.contains(text, F.lit("\r")), times(text, "\r\n"))
    selector = count(text, rf"(?<=[\x00-\x7F])[{M.SELECTORS}]")
    return {
        "zero_width": count(o, f"[{M.ZERO_WIDTH}]"),
        "bidi": count(o, f"[{M.BIDI}]"),
        "selectors": count(o, f"[{M.SELECTORS_MORE}]") + on(o.rlike(f"[{M.SELECTORS}]"), selector),
        "tags": count(o, f"[{M.TAGS}]"),
        "spaces": count(o, f"[{M.UNUSUAL_SPACES}]"),
        "nbsp": times(o, "\u00a0"),
        "soft_hyphens": times(o, "\u00ad"),
        "homoglyphs": on(F.lit(True), F.size(mixed_words(text, o))),
        "private_use": count(o, f"[{M.PRIVATE_USE}]"),
        "trailing": on(ends_in_space(text), count(text, r"(?md)[ \t]+$")),
        "doubles": on(F.contains(text, F.lit("  ")), count(text, f"(?<=[^{M.SPACES}])  (?=[^{M.SPACES}])")),
        "crlf": crlf,
        "lf": times(text, "\n") - crlf,
        "tab_mix": F.contains(text, F.lit(" \t")).cast("int"),
        "quotes": count(o, r"[\x{201C}\x{201D}\x{2018}\x{2019}]"),
        "dashes": count(o, r"[\x{2013}\x{2014}]"),
        "ellipses": times(o, "\u2026"),
        "hidden_html": on(F.contains(text, F.lit("<")), F.size(hidden_html(text))),
    }


def position(text: Column, index: Column) -> Column:
    """1-based line:column of a 0-based code-point index."""
    prefix = F.substring(text, F.lit(1), index.cast("int"))
    line = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1
    return F.concat(line.cast("string"), F.lit(":"), (F.length(F.substring_index(prefix, "\n", -1)) + 1).cast("string"))


def label(char: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(char))


def examples(text: Column, points: str, most: int = 5) -> Column:
    """The first marks in text order as line:column, code point and name."""
    names = F.create_map(*[F.lit(x) for pair in M.names(points).items() for x in pair])
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    found = F.slice(F.filter(chars, lambda x: x["c"].rlike(f"[{points}]")), 1, most)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(" ", position(text, x["i"]), label(x["c"]), F.element_at(names, x["c"]))), "; ")


def kinds(text: Column, points: str) -> Column:
    """Distinct code points of a class, as a sorted list of labels."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"([{points}])"), F.lit(1)), label))), ", ")


def tag_payload(text: Column) -> Column:
    """The ASCII text that tag characters spell."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"([\x{E0001}-\x{E007F}])"), F.lit(1)), lambda c: F.chr(F.ascii(c) - F.lit(0xE0000))), "")


def mixed_word_examples(text: Column, most: int = 5) -> Column:
    """First mixed words with position and number of confusables. Words are the odd parts of a lossless split."""
    parts = F.regexp_extract_all(text, F.lit(f"([{M.LETTERS}]+|[^{M.LETTERS}]+)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,w:string>>").alias("out"))
    mixed = lambda w: w.rlike("[A-Za-z]") & w.rlike(f"[{M.confusable_class()}]") & w.rlike(f"^[{M.LETTERS}]")
    grow = lambda acc, w: F.struct(
        (acc["at"] + F.length(w)).alias("at"),
        F.when(mixed(w) & (F.size(acc["out"]) < most), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), w.alias("w"))))).otherwise(acc["out"]).alias("out"),
    )
    found = F.aggregate(parts, start, grow)["out"]
    return F.array_join(F.transform(found, lambda x: F.concat(position(text, x["at"]), F.lit(' "'), x["w"], F.lit('" ('), F.regexp_count(x["w"], F.lit(f"[{M.confusable_class()}]")).cast("string"), F.lit(" confusable)"))), "; ")
