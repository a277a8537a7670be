"""Text normalisation as Column expressions, in a fixed order; switched-off steps never enter the plan."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import marks as M
from .text_marks import ends_in_space, odd, times

#: Steps in order, and whether they run by default.
STEPS = {
    "nfkc": False,
    "strip_invisible": True,
    "strip_bidi": True,
    "remove_soft_hyphen": True,
    "normalize_spaces": True,
    "fix_homoglyphs": True,
    "strip_private_use": True,
    "normalize_whitespace": True,
    "normalize_typography": False,
}

_JOINERS = r"[\x{200D}\x{FE0F}]"
_DROP = rf"[{M.TAGS}{M.SELECTORS_MORE}\x{{FE00}}-\x{{FE0E}}{M.ZERO_WIDTH_BUT_JOINER}]"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which has no built-in function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it.

    A chain of steps that each name the text several times would double at each step when the optimizer moves a filter on
    the result below the projections that make it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_invisible(t: Column) -> Column:
    """Drops tag characters, selectors and zero-width characters; a joiner or selector beside an emoji stays.

    An emoji and the joiner after it are kept as one match. A lookbehind would be wrong here: on classes of
    supplementary ranges the regex engine looks at half a character.
    """
    return F.regexp_replace(t, rf"([{M.EMOJI}]{_JOINERS})|{_DROP}|{_JOINERS}(?![{M.EMOJI}])", "$1")


def fix_homoglyphs(t: Column) -> Column:
    """Maps confusables in words that hold an ASCII letter."""
    parts = F.regexp_extract_all(t, F.lit(f"([{M.LETTERS}]+|[^{M.LETTERS}]+)"), F.lit(1))
    mapped = lambda w: F.when(w.rlike("[A-Za-z]") & w.rlike(f"^[{M.LETTERS}]"), F.translate(w, *M.confusables())).otherwise(w)
    return F.array_join(F.transform(parts, lambda w: F.when(F.octet_length(w) == F.length(w), w).otherwise(mapped(w))), "")


def normalize_whitespace(t: Column) -> Column:
    """One kind of line end, no white space at line ends, one space for two or more between other characters."""
    t = let(t, lambda x: F.when(F.contains(x, F.lit("\r")), F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))).otherwise(x))
    t = let(t, lambda x: F.when(ends_in_space(x), F.regexp_replace(x, r"(?md)[ \t]+$", "")).otherwise(x))
    return let(t, lambda x: F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, f"(?<=[^{M.SPACES}]) {{2,}}(?=[^{M.SPACES}])", " ")).otherwise(x))


def normalize_typography(t: Column) -> Column:
    t = F.translate(t, "\u201c\u201d\u2018\u2019\u2013\u2014\u00a0", "\"\"''-- ")
    return F.replace(t, F.lit("\u2026"), F.lit("..."))


RUN: dict[str, Callable[[Column], Column]] = {
    "nfkc": nfkc,
    "strip_invisible": strip_invisible,
    "strip_bidi": lambda t: F.regexp_replace(t, f"[{M.BIDI}]", ""),
    "remove_soft_hyphen": lambda t: F.replace(t, F.lit("\u00ad"), F.lit("")),
    "normalize_spaces": lambda t: F.regexp_replace(t, f"[{M.UNUSUAL_SPACES}]", " "),
    "fix_homoglyphs": fix_homoglyphs,
    "strip_private_use": lambda t: F.regexp_replace(t, f"[{M.PRIVATE_USE}]", ""),
    "normalize_whitespace": normalize_whitespace,
    "normalize_typography": normalize_typography,
}

#: Class of the odd characters without which a step changes nothing. Only the step nfkc makes new ones.
NEEDS: dict[str, str] = {
    "strip_invisible": f"{M.TAGS}{M.SELECTORS_MORE}{M.SELECTORS}{M.ZERO_WIDTH}",
    "strip_bidi": M.BIDI,
    "remove_soft_hyphen": r"\x{00AD}",
    "normalize_spaces": M.UNUSUAL_SPACES,
    "fix_homoglyphs": M.confusable_class(),
    "strip_private_use": M.PRIVATE_USE,
    "normalize_typography": r"\x{201C}\x{201D}\x{2018}\x{2019}\x{2013}\x{2014}\x{2026}\x{00A0}",
}


def needed(step: str, odd_chars: Column) -> Column | None:
    """Whether a text with these odd characters needs the step; None for the steps that look for themselves."""
    return odd_chars.rlike(f"[{NEEDS[step]}]") if step in NEEDS else None


def run(step: str, t: Column, odd_chars: Column) -> Column:
    """The text after a step, itself where its odd characters show that nothing is to be done."""
    gate = needed(step, odd_chars)
    return RUN[step](t) if gate is None else F.when(gate, RUN[step](t)).otherwise(t)


def chosen(options: dict[str, bool] | None) -> list[str]:
    """The steps to run, in order; unknown options are ignored."""
    return [s for s, on in STEPS.items() if (options or {}).get(s, on)]


def _n(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


# What each step says it did, with its count.
SAID = {
    "nfkc": "Applied NFKC normalization",
    "strip_invisible": "Removed %d invisible/tag/variation-selector characters",
    "strip_bidi": "Removed %d bidi control characters",
    "remove_soft_hyphen": "Removed %d soft hyphens",
    "normalize_spaces": "Normalized %d unusual space characters to U+0020",
    "fix_homoglyphs": "Mapped %d confusable characters to Latin",
    "strip_private_use": "Removed %d private-use characters",
    "normalize_whitespace": ("Normalized whitespace: ", "%d CRLF→LF", "trailing whitespace on %d lines", "%d double spaces collapsed"),
    "normalize_typography": "Normalized %d typographic variants",
}


def action(step: str, before: Column, after: Column) -> Column:
    """What a step did, as a sentence, or null where it did nothing."""
    say = lambda n, text: F.when(n > 0, F.format_string(text, n))
    if step == "nfkc":
        return F.lit(SAID[step])
    if step == "normalize_whitespace":
        head, *texts = SAID[step]
        crlf = F.when(F.contains(before, F.lit("\r")), times(before, "\r\n")).otherwise(0)
        unix = F.replace(F.replace(before, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
        ends = F.when(ends_in_space(unix), _n(unix, r"(?md)[ \t]+$")).otherwise(0)
        doubles = _n(F.regexp_replace(unix, r"(?md)[ \t]+$", ""), f"(?<=[^{M.SPACES}])  (?=[^{M.SPACES}])")
        doubles = F.when(F.contains(unix, F.lit("  ")), doubles).otherwise(0)
        parts = F.concat_ws(", ", *[say(n, text) for n, text in zip((crlf, ends, doubles), texts, strict=True)])
        return F.when(parts != "", F.concat(F.lit(head), parts))
    if step in ("normalize_spaces", "normalize_typography"):
        n = _n(before, f"[{NEEDS[step]}]")
    elif step == "fix_homoglyphs":
        words = F.filter(F.regexp_extract_all(before, F.lit(f"([{M.LETTERS}]+)"), F.lit(1)), lambda w: F.octet_length(w) != F.length(w))
        n = F.aggregate(F.filter(words, lambda w: w.rlike("[A-Za-z]")), F.lit(0), lambda a, w: a + F.regexp_count(w, F.lit(f"[{M.confusable_class()}]")))
    else:
        n = F.length(before) - F.length(after)
    return say(n, SAID[step])


def cleaned(t: Column, steps: list[str]) -> Column:
    """The text after the steps but nfkc, which has to come before."""

    def on(x: Column, o: Column, left: list[str]) -> Column:
        return let(run(left[0], x, o), lambda y: on(y, o, left[1:])) if left else x

    steps = [s for s in steps if s != "nfkc"]
    return let(t, lambda x: let(odd(x), lambda o: on(x, o, steps)))


def cleaned_with_actions(t: Column, steps: list[str], said: list[str]) -> Column:
    """A struct of the text after the steps but nfkc and of what they did, after what was said before."""

    def on(x: Column, o: Column, left: list[str], did: Column) -> Column:
        if not left:
            return F.struct(x.alias("text"), did.alias("actions"))

        def after(y: Column) -> Column:
            gate, what = needed(left[0], o), action(left[0], x, y)
            more = F.filter(F.array(what if gate is None else F.when(gate, what)), lambda a: a.isNotNull())
            return on(y, o, left[1:], F.concat(did, more))

        return let(run(left[0], x, o), after)

    steps = [s for s in steps if s != "nfkc"]
    first = F.array(*[F.lit(s) for s in said]) if said else F.array().cast("array<string>")
    return let(t, lambda x: let(odd(x), lambda o: on(x, o, steps, first)))
