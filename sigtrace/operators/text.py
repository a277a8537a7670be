"""Detection and cleaning of marks in a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, text_marks as X
from ..functions import marks as M
from .findings import finding, to_long

# Name, severity, confidence and remedy of each finding, in the order in which they are reported.
TEXT = {
    "zero-width": ("Zero-width / invisible characters", "high", 1.0, "Removed by strip_invisible"),
    "bidi-controls": ("Bidirectional control characters", "medium", 1.0, "Removed by strip_bidi"),
    "variation-selectors": ("Variation selectors (steganographic)", "high", 0.95, "Removed by strip_invisible (emoji VS16 preserved)"),
    "tag-characters": ("Unicode tag characters (ASCII smuggling)", "high", 1.0, "Removed by strip_invisible"),
    "unusual-spaces": ("Unusual space characters", "medium", 0.9, "Normalized to U+0020"),
    "soft-hyphen": ("Soft hyphens", "medium", 1.0, "Removed"),
    "homoglyphs": ("Mixed-script homoglyphs", "high", 0.95, "Confusables mapped to Latin in mixed-script words"),
    "private-use": ("Private-use characters", "medium", 1.0, "Removed by strip_private_use"),
    "whitespace-pattern": ("Whitespace pattern anomalies", "low", 0.8, "Normalized by normalize_whitespace"),
    "typographic-variants": ("Typographic variants", "info", 1.0, "Optional: normalize_typography"),
    "invisible-html": ("Invisible HTML content", "low", 0.9, "Manual review; not auto-removed"),
}
# What the evidence of each finding says, around its counts and examples.
SAYS = {
    "zero-width": (" invisible chars (", "); e.g. "),
    "bidi-controls": (" bidi controls; e.g. ",),
    "variation-selectors": (" variation selectors on non-emoji bases",),
    "tag-characters": (" tag characters", '; hidden ASCII: "', '"'),
    "unusual-spaces": (" unusual spaces (", ")"),
    "soft-hyphen": (" soft hyphens (U+00AD)",),
    "homoglyphs": (" words mix Latin with confusable lookalikes; e.g. ",),
    "private-use": (" private-use codepoints",),
    "whitespace-pattern": (" lines with trailing whitespace", " double spaces", "mixed line endings (", " CRLF, ", " LF)", "mixed tab/space indentation", " — possible whitespace steganography (SNOW) carrier"),
    "typographic-variants": (" curly quotes", " dashes", " ellipses", " NBSP", " — style fingerprint, not a mark itself"),
    "invisible-html": (" hidden-content constructs; e.g. ",),
}
DETECTORS = tuple(TEXT)
_NEEDS = {
    "zero-width": ["zero_width"],
    "bidi-controls": ["bidi"],
    "variation-selectors": ["selectors"],
    "tag-characters": ["tags"],
    "unusual-spaces": ["spaces", "nbsp"],
    "soft-hyphen": ["soft_hyphens"],
    "homoglyphs": ["homoglyphs"],
    "private-use": ["private_use"],
    "whitespace-pattern": ["trailing", "doubles", "crlf", "lf", "tab_mix"],
    "typographic-variants": ["quotes", "dashes", "ellipses", "nbsp"],
    "invisible-html": ["hidden_html"],
}


def _counted(df: DataFrame, text: Column, detectors: tuple[str, ...], prefix: str = "n_") -> DataFrame:
    """df with the counts that the chosen detectors need; others never enter the plan.

    The odd characters are a column of their own below the counts, so that they are taken from a text once.
    """
    needed = dict.fromkeys(n for d in DETECTORS if d in detectors for n in _NEEDS[d])
    names = df.columns
    df = df.withColumn("__of", text).withColumn("__odd", X.odd(F.col("__of")))
    every = X.counts(F.col("__of"), F.col("__odd"))
    return df.select(*names, *[every[n].alias(f"{prefix}{n}") for n in needed])


def mark_counts(df: DataFrame, keys: list[str], text: str = "text", detectors: tuple[str, ...] = DETECTORS) -> DataFrame:
    """keys, text and the counts that the chosen detectors need."""
    return _counted(df.select(*keys, F.col(text).alias("__text")), F.col("__text"), detectors)


def _present(d: str, prefix: str = "n_") -> Column:
    """Whether a finding is there, by the counts."""
    n = lambda name: F.col(f"{prefix}{name}") > 0
    if d == "whitespace-pattern":
        return n("trailing") | n("doubles") | (n("crlf") & n("lf")) | n("tab_mix")
    if d == "typographic-variants":
        return n("quotes") | n("dashes") | n("ellipses") | n("nbsp")
    return n(_NEEDS[d][0])


def _evidence(d: str, t: Column) -> Column:
    n = lambda name: F.col(f"n_{name}").cast("string")
    join = lambda *cs: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in cs])
    some = lambda name, *cs: F.when(F.col(f"n_{name}") > 0, join(*cs))
    says = SAYS[d]
    if d == "zero-width":
        return join(n("zero_width"), says[0], X.kinds(t, M.ZERO_WIDTH), says[1], X.examples(t, M.ZERO_WIDTH))
    if d == "bidi-controls":
        return join(n("bidi"), says[0], X.examples(t, M.BIDI))
    if d == "tag-characters":
        payload = X.tag_payload(t)
        return join(n("tags"), says[0], F.when(F.trim(payload) != "", join(says[1], F.substring(payload, 1, 120), says[2])).otherwise(""))
    if d == "unusual-spaces":
        return join(n("spaces"), says[0], X.kinds(t, M.UNUSUAL_SPACES), says[1])
    if d == "homoglyphs":
        return join(n("homoglyphs"), says[0], X.mixed_word_examples(t))
    if d == "whitespace-pattern":
        ends = F.when((F.col("n_crlf") > 0) & (F.col("n_lf") > 0), join(says[2], n("crlf"), says[3], n("lf"), says[4]))
        parts = (some("trailing", n("trailing"), says[0]), some("doubles", n("doubles"), says[1]), ends, some("tab_mix", says[5]))
        return join(F.concat_ws("; ", *parts), says[6])
    if d == "typographic-variants":
        parts = [some(c, n(c), what) for c, what in zip(("quotes", "dashes", "ellipses", "nbsp"), says, strict=False)]
        return join(F.concat_ws(", ", *parts), says[4])
    if d == "invisible-html":
        return join(n("hidden_html"), says[0], F.substring(F.get(X.hidden_html(t), F.lit(0)), 1, 100))
    return join(n(_NEEDS[d][0]), says[0])


def detect_text(df: DataFrame, keys: list[str], text: str = "text", detectors: tuple[str, ...] = DETECTORS, evidence: bool = True) -> DataFrame:
    """Findings of the text column. Null texts have none. evidence=False leaves the evidence strings out (null)."""
    t = F.col("__text")
    found = []
    for i, (d, (name, severity, confidence, removal)) in enumerate(TEXT.items()):
        if d in detectors:
            if d == "unusual-spaces":
                severity = F.when((F.col("n_nbsp") == F.col("n_spaces")) & (F.col("n_spaces") < 4), "low").otherwise(severity)
            shown = F.when(_present(d), _evidence(d, t)) if evidence else F.lit(None)
            found.append(finding(i, d, name, severity, confidence, shown, _present(d), removal=removal))
    return to_long(mark_counts(df, keys, text, detectors), keys, found)


def _ids(prefix: str) -> Column:
    """The findings that the counts show, as an array of their ids."""
    return F.filter(F.array(*[F.when(_present(d, prefix), F.lit(d)) for d in DETECTORS]), lambda x: x.isNotNull())


def verify_cleaning(df: DataFrame, keys: list[str], text: str = "text", options: dict[str, bool] | None = None) -> DataFrame:
    """keys, id, in_before, in_after, status (removed, remained, introduced) of findings before and after cleaning.

    Detection, cleaning and detection again are projections of one row: nothing is joined or shuffled, and a text that
    cleaning leaves as it was is not looked at again. A null text has no row.
    """
    rows = _counted(df.select(*keys, F.col(text).alias("__text")), F.col("__text"), DETECTORS, "b_")
    rows = rows.select(*keys, "__text", _ids("b_").alias("__before"))
    rows = clean_text(rows, "__text", options, actions=False, out="__after_text")
    changed = F.when(F.col("__after_text") != F.col("__text"), F.col("__after_text"))
    rows = _counted(rows.select(*keys, "__before", changed.alias("__changed")), F.col("__changed"), DETECTORS, "a_")
    after = F.when(F.col("__changed").isNull(), F.col("__before")).otherwise(_ids("a_"))
    rows = rows.select(*keys, "__before", after.alias("__after"))
    each = rows.select(*keys, "__before", "__after", F.explode(F.array_union("__before", "__after")).alias("id"))
    each = each.select(*keys, "id", F.array_contains("__before", F.col("id")).alias("in_before"), F.array_contains("__after", F.col("id")).alias("in_after"))
    status = F.when(F.col("in_before") & F.col("in_after"), "remained").when(F.col("in_before"), "removed").otherwise("introduced")
    return each.withColumn("status", status)


def clean_text(df: DataFrame, text: str = "text", options: dict[str, bool] | None = None, actions: bool = True, out: str | None = None) -> DataFrame:
    """df with the text column (or ``out``) cleaned and, unless switched off, ``actions``: what was done, in order.

    One expression of the row, no shuffle; a step runs only on texts whose odd characters call for it. A null text stays
    null with no actions.
    """
    names = [c for c in df.columns if not (actions and c == "actions")]
    names += [] if (out or text) in names else [out or text]
    steps, was = cleaning.chosen(options), F.col(text)
    early = "nfkc" in steps
    first = cleaning.RUN["nfkc"](was) if early else was
    if not actions:
        new = cleaning.cleaned(first, steps)
        return df.withColumn("__new", new).select(*[F.col("__new").alias(c) if c == (out or text) else F.col(c) for c in names])
    df = df.withColumn("__did", cleaning.cleaned_with_actions(first, steps, [cleaning.SAID["nfkc"]] if early else []))
    did = F.when(was.isNull(), F.array().cast("array<string>")).otherwise(F.col("__did.actions"))
    return df.select(*[F.col("__did.text").alias(c) if c == (out or text) else F.col(c) for c in names], did.alias("actions"))
