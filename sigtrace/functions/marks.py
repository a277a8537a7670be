"""Code points that mark text, as regex classes valid for Spark (Java) and for RE2, and the confusable letters."""

from __future__ import annotations

import unicodedata
from functools import cache

# The code points that detection and cleaning must agree on.
ZERO_WIDTH = r"\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{2028}\x{2029}\x{2060}-\x{2064}\x{3164}\x{FEFF}\x{FFA0}"
ZERO_WIDTH_BUT_JOINER = r"\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{2028}\x{2029}\x{2060}-\x{2064}\x{3164}\x{FEFF}\x{FFA0}"
BIDI = r"\x{202A}-\x{202E}\x{2066}-\x{2069}"
UNUSUAL_SPACES = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
PRIVATE_USE = r"\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}"
SELECTORS = r"\x{FE00}-\x{FE0F}"
SELECTORS_MORE = r"\x{E0100}-\x{E01EF}"
TAGS = r"\x{E0000}-\x{E007F}"
EMOJI = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2300}-\x{23FF}"
LETTERS = r"\p{L}\p{Nl}\p{No}"
#: What counts as white space: the 29 code points, not the narrower default of either regex engine.
SPACES = r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: Code points that are neither a mark nor a lookalike nor unusual white space: ASCII and the letters of Latin scripts. A text
#: of these alone needs no further look, and what is left without them is short.
PLAIN = r"\x00-\x7F\x{C0}-\x{260}\x{262}-\x{34E}\x{1E00}-\x{1EFF}"

# Letters of other scripts that look Latin, and what they look like.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
}


@cache
def confusables() -> tuple[str, str]:
    """Two strings of equal length for translate(): lookalikes, full-width forms, and the mathematical alphanumerics
    whose compatibility form is one letter."""
    pairs = dict(LOOKALIKES)
    pairs.update({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)})
    for c in range(0x1D400, 0x1D800):
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain.isalpha():
            pairs[chr(c)] = plain
    return "".join(pairs), "".join(pairs.values())


@cache
def confusable_class() -> str:
    """The confusables as a regex class body, in ranges."""
    points = sorted(map(ord, confusables()[0]))
    out, first, last = [], points[0], points[0]
    for p in [*points[1:], -1]:
        if p != last + 1:
            out.append(rf"\x{{{first:X}}}" + (rf"-\x{{{last:X}}}" if last > first else ""))
            first = p
        last = p
    return "".join(out)


@cache
def names(points: str) -> dict[str, str]:
    """Unicode names of the code points of a class body made of single points and ranges."""
    out: dict[str, str] = {}
    left = points
    while left:
        low = int(left[3 : left.index("}")], 16)
        left, high = left[left.index("}") + 1 :], low
        if left.startswith("-"):
            high, left = int(left[4 : left.index("}")], 16), left[left.index("}") + 1 :]
        out.update({chr(c): unicodedata.name(chr(c), "<unnamed>") for c in range(low, high + 1)})
    return out
