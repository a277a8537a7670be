"""The registered queries over whole tables, each with the same question in SQL for DuckDB where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions import text_marks as X
from ..functions.cleaning import SAID
from ..operators import links
from ..operators.text import SAYS, clean_text, detect_text, mark_counts
from . import fixtures, reports
from .marked import MARKED, marked

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The oracle's regex engine has no lookaround: each rule is asked in another way there.
def _n(cls: str, t: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({t}, '{cls}')) AS INTEGER)"


_FROM, _TO = M.confusables()
_Q = lambda s: s.replace("'", "''")
_CONF = M.confusable_class()
_MIXED = f"len(list_filter(regexp_extract_all(text, '[{M.LETTERS}]+'), lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[{_CONF}]')))"
_HTML = r"(?i)(<span[^>]*display\s*:\s*none[^>]*>|font-size\s*:\s*0|color\s*:\s*transparent|<div[^>]*hidden)"
_DOUBLES = rf"""(len(list_filter(regexp_extract_all(text, '[{M.SPACES}]+'), lambda w: w = '  '))
    - CAST(regexp_matches(text, '^  ([^{M.SPACES}]|$)') AS INTEGER) - CAST(regexp_matches(text, '[^{M.SPACES}]  $') AS INTEGER))"""
_COUNTS = {
    "zero_width": _n(f"[{M.ZERO_WIDTH}]"),
    "bidi": _n(f"[{M.BIDI}]"),
    "selectors": f"{_n(f'[{M.SELECTORS_MORE}]')} + {_n(rf'[\x00-\x7F][{M.SELECTORS}]'.replace(chr(0), r'\x00').replace(chr(127), r'\x7F'))}",
    "tags": _n(f"[{M.TAGS}]"),
    "spaces": _n(f"[{M.UNUSUAL_SPACES}]"),
    "nbsp": _n(r"\x{00A0}"),
    "soft_hyphens": _n(r"\x{00AD}"),
    "homoglyphs": f"CAST({_MIXED} AS INTEGER)",
    "private_use": _n(f"[{M.PRIVATE_USE}]"),
    "trailing": _n(r"(?m)[ \t]+$"),
    "doubles": f"CAST({_DOUBLES} AS INTEGER)",
    "crlf": _n(r"\r\n"),
    "lf": rf"{_n(r'\n')} - {_n(r'\r\n')}",
    "tab_mix": "CAST(contains(text, concat(' ', chr(9))) AS INTEGER)",
    "quotes": _n(r"[\x{201C}\x{201D}\x{2018}\x{2019}]"),
    "dashes": _n(r"[\x{2013}\x{2014}]"),
    "ellipses": _n(r"\x{2026}"),
    "hidden_html": f"CASE WHEN regexp_matches(text, '(?i)</?[a-z]') THEN {_n(_HTML)} ELSE 0 END",
}
_COUNTED = f"SELECT doc_id, lang, source, {', '.join(f'{v} AS n_{k}' for k, v in _COUNTS.items())} FROM ({MARKED})"
_FINDINGS = f"""
WITH c AS ({_COUNTED}), f AS (
    SELECT doc_id, lang, source, unnest([
        {{'ordinal': 0, 'id': 'zero-width', 'severity': 'high', 'confidence': 1.0, 'p': n_zero_width > 0}},
        {{'ordinal': 1, 'id': 'bidi-controls', 'severity': 'medium', 'confidence': 1.0, 'p': n_bidi > 0}},
        {{'ordinal': 2, 'id': 'variation-selectors', 'severity': 'high', 'confidence': 0.95, 'p': n_selectors > 0}},
        {{'ordinal': 3, 'id': 'tag-characters', 'severity': 'high', 'confidence': 1.0, 'p': n_tags > 0}},
        {{'ordinal': 4, 'id': 'unusual-spaces', 'severity': CASE WHEN n_nbsp = n_spaces AND n_spaces < 4 THEN 'low' ELSE 'medium' END, 'confidence': 0.9, 'p': n_spaces > 0}},
        {{'ordinal': 5, 'id': 'soft-hyphen', 'severity': 'medium', 'confidence': 1.0, 'p': n_soft_hyphens > 0}},
        {{'ordinal': 6, 'id': 'homoglyphs', 'severity': 'high', 'confidence': 0.95, 'p': n_homoglyphs > 0}},
        {{'ordinal': 7, 'id': 'private-use', 'severity': 'medium', 'confidence': 1.0, 'p': n_private_use > 0}},
        {{'ordinal': 8, 'id': 'whitespace-pattern', 'severity': 'low', 'confidence': 0.8, 'p': n_trailing > 0 OR n_doubles > 0 OR (n_crlf > 0 AND n_lf > 0) OR n_tab_mix > 0}},
        {{'ordinal': 9, 'id': 'typographic-variants', 'severity': 'info', 'confidence': 1.0, 'p': n_quotes > 0 OR n_dashes > 0 OR n_ellipses > 0 OR n_nbsp > 0}},
        {{'ordinal': 10, 'id': 'invisible-html', 'severity': 'low', 'confidence': 0.9, 'p': n_hidden_html > 0}}
    ], recursive := true) FROM c
)"""


def _counts(names: list[str]) -> str:
    return f"SELECT doc_id, {', '.join(f'n_{n}' for n in names)} FROM ({_COUNTED})"


def _register_counts(name: str, detectors: tuple[str, ...], names: list[str]) -> None:
    @query(name, _counts(names))
    def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
        return mark_counts(marked(spark, sf_dir), ["doc_id"], detectors=detectors).select("doc_id", *[f"n_{n}" for n in names])


_register_counts("mark_counts", ("zero-width", "bidi-controls", "variation-selectors", "tag-characters", "unusual-spaces", "soft-hyphen", "private-use"), ["zero_width", "bidi", "selectors", "tags", "spaces", "nbsp", "soft_hyphens", "private_use"])
_register_counts("homoglyph_words", ("homoglyphs",), ["homoglyphs"])
_register_counts("whitespace_anomalies", ("whitespace-pattern",), ["trailing", "doubles", "crlf", "lf", "tab_mix"])
_register_counts("typographic_counts", ("typographic-variants",), ["quotes", "dashes", "ellipses", "nbsp"])


@query("zero_width_by_lang", f"SELECT lang, CAST(sum(n_zero_width) AS BIGINT) AS n_marks, count(*) AS n_docs FROM ({_COUNTED}) GROUP BY lang")
def zero_width_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir).select("lang", X.count(F.col("text"), f"[{M.ZERO_WIDTH}]").alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("n_marks"), F.count(F.lit(1)).alias("n_docs"))


_PAGES = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat(html, '<span style=\"DISPLAY : none\">x</span><p style=\"font-size:0\">') WHEN 1 THEN concat(html, '<div class=a hidden>', '<i style=\"color: transparent\">') ELSE html END AS text FROM pages"


@query("hidden_html", f"SELECT page_id, {_COUNTS['hidden_html']} AS n_hidden_html FROM ({_PAGES})")
def hidden_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.sql(_PAGES.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))
    return pages.select("page_id", F.size(X.hidden_html(F.col("text"))).alias("n_hidden_html"))


@query("tag_payload_decode", rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\x{{E0001}}-\x{{E007F}}]'), lambda c: chr(unicode(c) - 917504)), '') AS payload FROM ({MARKED}) WHERE regexp_matches(text, '[{M.TAGS}]')")
def tag_payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(spark, sf_dir).where(F.col("text").rlike(f"[{M.TAGS}]")).select("doc_id", X.tag_payload(F.col("text")).alias("payload"))


@query("findings_long", f"{_FINDINGS} SELECT doc_id, ordinal, id, severity, confidence FROM f WHERE p")
def findings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_text(marked(spark, sf_dir), ["doc_id"], evidence=False).select("doc_id", "ordinal", "id", "severity", "confidence")


def _position(i: str) -> str:
    before = f"substring(text, 1, CAST({i} AS BIGINT))"
    return f"concat(length({before}) - length(replace({before}, chr(10), '')) + 1, ':', length(string_split({before}, chr(10))[-1]) + 1)"


def _examples(points: str) -> str:
    names = "MAP {" + ", ".join(f"'{c}': '{n}'" for c, n in M.names(points).items()) + "}"
    found = f"list_filter(list_transform(string_split(text, ''), lambda c, i: {{'c': c, 'i': i - 1}}), lambda x: regexp_matches(x.c, '[{points}]'))"
    return f"array_to_string(list_transform(({found})[1:5], lambda x: concat({_position('x.i')}, ' ', printf('U+%04X', unicode(x.c)), ' ', ({names})[x.c])), '; ')"


def _kinds(points: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[{points}]'), lambda c: printf('U+%04X', unicode(c))))), ', ')"


def _evidence() -> str:
    """The evidence of every finding, by another way than the plan's: words are found by their place in a list of parts."""
    parts = f"regexp_extract_all(text, '[{M.LETTERS}]+|[^{M.LETTERS}]+')"
    mixed = f"regexp_matches(x.w, '^[{M.LETTERS}]') AND regexp_matches(x.w, '[A-Za-z]') AND regexp_matches(x.w, '[{_CONF}]')"
    placed = f"list_transform({parts}, lambda w, i: {{'w': w, 'i': i}})"
    at = f"length(array_to_string(({parts})[1:x.i - 1], ''))"
    words = f"array_to_string(list_transform(list_filter({placed}, lambda x: {mixed})[1:5], lambda x: concat({_position(at)}, ' \"', x.w, '\" (', len(regexp_extract_all(x.w, '[{_CONF}]')), ' confusable)')), '; ')"
    payload = rf"array_to_string(list_transform(regexp_extract_all(text, '[\x{{E0001}}-\x{{E007F}}]'), lambda c: chr(unicode(c) - 917504)), '')"
    some = lambda n, *what: f"CASE WHEN n_{n} > 0 THEN concat({', '.join(what)}) END"
    says = {k: [f"'{x}'" for x in v] for k, v in SAYS.items()}
    white, typo, tag, space = (says[k] for k in ("whitespace-pattern", "typographic-variants", "tag-characters", "unusual-spaces"))
    ends = f"CASE WHEN n_crlf > 0 AND n_lf > 0 THEN concat({white[2]}, n_crlf, {white[3]}, n_lf, {white[4]}) END"
    each = {
        "zero-width": f"concat(n_zero_width, {says['zero-width'][0]}, {_kinds(M.ZERO_WIDTH)}, {says['zero-width'][1]}, {_examples(M.ZERO_WIDTH)})",
        "bidi-controls": f"concat(n_bidi, {says['bidi-controls'][0]}, {_examples(M.BIDI)})",
        "variation-selectors": f"concat(n_selectors, {says['variation-selectors'][0]})",
        "tag-characters": f"concat(n_tags, {tag[0]}, CASE WHEN trim({payload}) <> '' THEN concat({tag[1]}, substring({payload}, 1, 120), {tag[2]}) ELSE '' END)",
        "unusual-spaces": f"concat(n_spaces, {space[0]}, {_kinds(M.UNUSUAL_SPACES)}, {space[1]})",
        "soft-hyphen": f"concat(n_soft_hyphens, {says['soft-hyphen'][0]})",
        "homoglyphs": f"concat(n_homoglyphs, {says['homoglyphs'][0]}, {words})",
        "private-use": f"concat(n_private_use, {says['private-use'][0]})",
        "whitespace-pattern": f"concat(concat_ws('; ', {some('trailing', 'n_trailing', white[0])}, {some('doubles', 'n_doubles', white[1])}, {ends}, {some('tab_mix', white[5])}), {white[6]})",
        "typographic-variants": f"concat(concat_ws(', ', {', '.join(some(c, f'n_{c}', w) for c, w in zip(('quotes', 'dashes', 'ellipses', 'nbsp'), typo, strict=False))}), {typo[4]})",
        "invisible-html": "''",
    }
    case = " ".join(f"WHEN '{k}' THEN {v}" for k, v in each.items())
    counted = _COUNTED.replace("SELECT doc_id, lang, source,", "SELECT doc_id, lang, source, text,", 1)
    found = _FINDINGS.replace(_COUNTED, counted).replace("SELECT doc_id, lang, source, unnest", "SELECT c.*, unnest", 1)
    return f"{found} SELECT doc_id, ordinal, id, severity, confidence, CASE id {case} END AS evidence FROM f WHERE p"


@query("findings_evidence", _evidence())
def findings_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_text(marked(spark, sf_dir), ["doc_id"]).select("doc_id", "ordinal", "id", "severity", "confidence", "evidence")


@query(
    "findings_by_lang_severity",
    f"{_FINDINGS} SELECT lang, severity, CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM f WHERE p GROUP BY lang, severity",
)
def findings_by_lang_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = marked(spark, sf_dir)
    found = detect_text(docs, ["doc_id", "lang"], evidence=False)
    joined = found.join(F.broadcast(reports.severity_ranks(docs)), "severity")
    return joined.groupBy("lang", "severity", F.col("rank").cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"))


@query("findings_cube", f"{_FINDINGS} SELECT lang, id, count(*) AS n FROM f WHERE p GROUP BY CUBE (lang, id)")
def findings_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cube(detect_text(marked(spark, sf_dir), ["doc_id", "lang"], evidence=False), "lang")


@query("top_sources", f"{_FINDINGS}, n AS (SELECT id, source, count(*) AS n FROM f WHERE p GROUP BY id, source) SELECT * FROM (SELECT id, source, n, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, source) AS INTEGER) AS place FROM n) WHERE place <= 3")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_sources(detect_text(marked(spark, sf_dir), ["doc_id", "source"], evidence=False), "source", 3)


@query(
    "first_mark_position",
    rf"""WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?s)^([^{M.ZERO_WIDTH}]*)[{M.ZERO_WIDTH}]', 1) AS prefix FROM ({MARKED}) WHERE regexp_matches(text, '[{M.ZERO_WIDTH}]'))
    SELECT doc_id, concat(length(prefix) - length(replace(prefix, chr(10), '')) + 1, ':', length(string_split(prefix, chr(10))[-1]) + 1) AS position FROM m""",
)
def first_mark_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marked(spark, sf_dir).where(F.col("text").rlike(f"[{M.ZERO_WIDTH}]"))
    before = F.length(F.regexp_extract("text", f"(?s)^([^{M.ZERO_WIDTH}]*)", 1))
    return rows.select("doc_id", X.position(F.col("text"), before).alias("position"))


_HOLD, _HOLD_VS = "\ufdd0", "\ufdd1"


def _strip(t: str) -> str:
    for mark, hold in ((r"\x{200D}", _HOLD), (r"\x{FE0F}", _HOLD_VS)):
        t = rf"regexp_replace(regexp_replace({t}, '([{M.EMOJI}]){mark}', '\1{hold}', 'g'), '{mark}([{M.EMOJI}])', '{hold}\1', 'g')"
    t = f"regexp_replace({t}, '[{M.TAGS}{M.SELECTORS_MORE}{M.SELECTORS}{M.ZERO_WIDTH}]', '', 'g')"
    return f"replace(replace({t}, '{_HOLD}', '\u200d'), '{_HOLD_VS}', '\ufe0f')"


def _fix(t: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({t}, '[{M.LETTERS}]+|[^{M.LETTERS}]+'), lambda w: CASE WHEN regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '^[{M.LETTERS}]') AND regexp_matches(w, '[{_CONF}]') THEN translate(w, '{_Q(_FROM)}', '{_Q(_TO)}') ELSE w END), '')"


def _white(t: str) -> str:
    t = f"replace(replace({t}, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10))"
    t = rf"regexp_replace({t}, '(?m)[ \t]+$', '', 'g')"
    for _ in range(2):  # a single character between two gaps is seen by the second pass
        t = rf"regexp_replace({t}, '([^{M.SPACES}]) {{2,}}([^{M.SPACES}])', '\1 \2', 'g')"
    return t


def _typography(t: str) -> str:
    return f"replace(translate({t}, '\u201c\u201d\u2018\u2019\u2013\u2014\u00a0', '\"\"''''-- '), '\u2026', '...')"


_STEPS: dict[str, Callable[[str], str]] = {
    "strip_invisible": _strip,
    "strip_bidi": lambda t: f"regexp_replace({t}, '[{M.BIDI}]', '', 'g')",
    "remove_soft_hyphen": lambda t: f"replace({t}, '\u00ad', '')",
    "normalize_spaces": lambda t: f"regexp_replace({t}, '[{M.UNUSUAL_SPACES}]', ' ', 'g')",
    "fix_homoglyphs": _fix,
    "strip_private_use": lambda t: f"regexp_replace({t}, '[{M.PRIVATE_USE}]', '', 'g')",
    "normalize_whitespace": _white,
    "normalize_typography": _typography,
}


def _cleaned(steps: list[str]) -> str:
    """Nested selects, a step each, so that no step's text is written out more than once or twice."""
    rows = MARKED
    for s in steps:
        rows = f"SELECT doc_id, lang, source, {_STEPS[s]('text')} AS text FROM ({rows})"
    return rows


_DEFAULT = [s for s in _STEPS if s != "normalize_typography"]


def _register_cleaner(name: str, steps: list[str]) -> None:
    from ..functions.cleaning import STEPS

    @query(name, f"SELECT doc_id, md5(text) AS digest, CAST(length(text) AS INTEGER) AS n_chars FROM ({_cleaned(steps)})")
    def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = clean_text(marked(spark, sf_dir), options={s: s in steps for s in STEPS}, actions=False)
        return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").alias("n_chars"))


for _name, _steps in {
    "clean_invisible": ["strip_invisible"],
    "clean_bidi": ["strip_bidi"],
    "clean_soft_hyphens": ["remove_soft_hyphen"],
    "clean_spaces": ["normalize_spaces"],
    "clean_homoglyphs": ["fix_homoglyphs"],
    "clean_private_use": ["strip_private_use"],
    "clean_whitespace": ["normalize_whitespace"],
    "clean_typography": ["normalize_typography"],
    "clean_all_default": _DEFAULT,
}.items():
    _register_cleaner(_name, _steps)


#: What compatibility composition changes among the characters of the tables and the marks.
_COMPAT = {"\u00a0": " ", "\u2026": "...", "\u00aa": "a", "\u00ba": "o", "\u00b2": "2", "\u00b3": "3", "\u00b9": "1"}


def _compat(t: str) -> str:
    for old, new in _COMPAT.items():
        t = f"replace({t}, '{old}', '{new}')"
    return t


@query("clean_nfkc", f"SELECT doc_id, md5(text) AS digest FROM ({_cleaned(_DEFAULT).replace(MARKED, f'SELECT doc_id, lang, source, {_compat("text")} AS text FROM ({MARKED})')})")
def clean_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_text(marked(spark, sf_dir), options={"nfkc": True}, actions=False)
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _acted(step: str, b: str, a: str) -> str:
    """The sentence of a step that made the text a of the text b, or null."""
    say = lambda n, text: f"CASE WHEN {n} > 0 THEN printf('{text}', {n}) END"
    if step == "normalize_whitespace":
        head, crlf, ends, doubles = SAID[step]
        unix = f"replace(replace({b}, concat(chr(13), chr(10)), chr(10)), chr(13), chr(10))"
        bare = rf"regexp_replace({unix}, '(?m)[ \t]+$', '', 'g')"
        said = [say(rf"len(regexp_extract_all({b}, '\r\n'))", crlf), say(rf"len(regexp_extract_all({unix}, '(?m)[ \t]+$'))", ends), say(_DOUBLES.replace("text", bare), doubles)]
        parts = f"concat_ws(', ', {', '.join(said)})"
        return f"CASE WHEN {parts} <> '' THEN concat('{head}', {parts}) END"
    if step == "normalize_spaces":
        return say(f"len(regexp_extract_all({b}, '[{M.UNUSUAL_SPACES}]'))", SAID[step])
    if step == "fix_homoglyphs":
        words = f"list_filter(regexp_extract_all({b}, '[{M.LETTERS}]+'), lambda w: regexp_matches(w, '[A-Za-z]'))"
        return say(f"CAST(coalesce(list_sum(list_transform({words}, lambda w: len(regexp_extract_all(w, '[{_CONF}]')))), 0) AS BIGINT)", SAID[step])
    return say(f"(length({b}) - length({a}))", SAID[step])


def _actions() -> str:
    rows = f"SELECT doc_id, text AS t0 FROM ({MARKED})"
    for i, step in enumerate(_DEFAULT):
        rows = f"SELECT *, {_STEPS[step](f't{i}')} AS t{i + 1} FROM ({rows})"
    said = ", ".join(_acted(step, f"t{i}", f"t{i + 1}") for i, step in enumerate(_DEFAULT))
    return f"SELECT doc_id, action FROM (SELECT doc_id, unnest([{said}]) AS action FROM ({rows})) WHERE action IS NOT NULL"


@query("clean_actions", _actions())
def clean_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_text(marked(spark, sf_dir)).select("doc_id", F.explode("actions").alias("action"))


_AFTER = _FINDINGS.replace(f"FROM ({MARKED})", f"FROM ({_cleaned(_DEFAULT)})")


@query(
    "before_after",
    f"""WITH b AS ({_FINDINGS} SELECT DISTINCT doc_id, id FROM f WHERE p), a AS ({_AFTER} SELECT DISTINCT doc_id, id FROM f WHERE p)
    SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.id, a.id) AS id, b.id IS NOT NULL AS in_before, a.id IS NOT NULL AS in_after,
        CASE WHEN a.id IS NULL THEN 'removed' WHEN b.id IS NULL THEN 'introduced' ELSE 'remained' END AS status
    FROM b FULL OUTER JOIN a ON a.doc_id = b.doc_id AND a.id = b.id""",
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.verify_cleaning(marked(spark, sf_dir), ["doc_id"])


@query("marked_docs", f"{_FINDINGS} SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM f WHERE p)")
def marked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_text(marked(spark, sf_dir), ["doc_id"], evidence=False)
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(found, "doc_id", "left_semi")


@query("unmarked_docs", f"{_FINDINGS} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f WHERE p)")
def unmarked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_text(marked(spark, sf_dir), ["doc_id"], evidence=False)
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(found, "doc_id", "left_anti")


@query("raw_documents_findings", f"{_FINDINGS.replace(MARKED, 'SELECT doc_id, lang, source, text FROM documents')} SELECT doc_id, id FROM f WHERE p")
def raw_documents_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_text(table(spark, sf_dir, "documents"), ["doc_id"], evidence=False).select("doc_id", "id")


@query("quality_vs_marks", f"{_FINDINGS} SELECT quality, id, count(*) AS n FROM f JOIN labels USING (doc_id) WHERE p GROUP BY quality, id")
def quality_vs_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_text(marked(spark, sf_dir), ["doc_id"], evidence=False)
    return found.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "id").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_duplicates", f"SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM ({_cleaned(_DEFAULT)}) GROUP BY 1 HAVING count(*) > 1")
def canonical_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.canonical_duplicates(marked(spark, sf_dir), "doc_id")


_TRACKED = f"contains(url, '?') OR regexp_matches(url, '(?i)({links.TRACKERS})')"


@query("tracked_links", f"SELECT page_id, url FROM pages WHERE {_TRACKED}")
def tracked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.tracked_links(table(spark, sf_dir, "pages")).select("page_id", "url")


@query("strip_link_query", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
def strip_link_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", links.strip_query(F.col("url")).alias("url"))


@query(
    "events_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def events_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import windowed

    return windowed(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "events_sliding",
    """SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2024-01-01') - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n
    FROM events, (VALUES (0), (1)) AS w(k) GROUP BY 1, 2""",
)
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import windowed

    return windowed(table(spark, sf_dir, "events"), "1 hour", slide="30 minutes").select("start", "event_type", "n")


@query(
    "events_sessions",
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM (
        SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events))
    GROUP BY user_id, s""",
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("events_props", "SELECT event_type, CAST(props->>'$.k' AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return rows.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("docs_by_marks", f"""{_FINDINGS}, m AS (SELECT DISTINCT doc_id FROM f WHERE p)
    SELECT doc_id, 'marked and labelled' AS part FROM (SELECT doc_id FROM m INTERSECT SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'marked only' FROM (SELECT doc_id FROM m EXCEPT SELECT doc_id FROM labels)""")
def docs_by_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect_text(marked(spark, sf_dir), ["doc_id"], evidence=False).select("doc_id").distinct()
    known = table(spark, sf_dir, "labels").select("doc_id")
    both, alone = found.intersect(known), found.subtract(known)
    return both.withColumn("part", F.lit("marked and labelled")).unionByName(alone.withColumn("part", F.lit("marked only")))


@query("worst_documents", f"""{_FINDINGS} SELECT doc_id, n, rank FROM (SELECT doc_id, count(*) AS n, CAST(sum(CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS BIGINT) AS rank
    FROM f WHERE p GROUP BY doc_id) ORDER BY rank DESC, n DESC, doc_id LIMIT 20""")
def worst_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = marked(spark, sf_dir)
    return reports.worst(detect_text(docs, ["doc_id"], evidence=False), "doc_id", 20)


for _name, _fixture in fixtures.QUERIES.items():
    query(_name, fixtures.expected(_name))(_fixture)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
