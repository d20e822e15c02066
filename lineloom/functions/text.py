"""Text normalizers and identifier parsing as Column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as ECMAScript sees it, as a character class body for Java patterns.
WS = r"\t-\r    -     　﻿"
#: Characters without a glyph.
INVISIBLE = "​‌‍﻿­‎‏⁠⁡⁢⁣⁤"
#: Typographic quotes and dashes, and their ASCII forms.
TYPOGRAPHIC = "‘’‚‛“”„‟–—―"
ASCII_FORMS = "''''\"\"\"\"---"
#: Ligatures, and confusions of optical recognition, applied in this order.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))
CONFUSIONS = (("rn", "m"), ("cl", "d"), ("cI", "d"), ("vv", "w"), ("li", "h"))
#: Line numbers printed between columns.
GUTTER = "5|10|15|20|25|30|35|40|45|50|55|60|65"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: within lambda functions Spark computes an expression each time it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no function for it, so rows with other than ASCII go through Arrow and the rest
    as nulls, which cost nothing."""
    udf = F.pandas_udf(_composed, StringType())
    return F.coalesce(udf(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{WS}]+", " "))


def normalize_text(text: Column) -> Column:
    out = F.translate(nfc(text), TYPOGRAPHIC + INVISIBLE, ASCII_FORMS)
    for ligature, letters in LIGATURES:
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return collapse(out)


def normalize_ocr(text: Column) -> Column:
    for seen, meant in CONFUSIONS:
        text = F.replace(text, F.lit(seen), F.lit(meant))
    return text


def dehyphenate_selection(text: Column) -> Column:
    return F.regexp_replace(text, "- ([a-z])", "$1")


def ws_strip(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+", "")


def aggressive_norm(text: Column) -> Column:
    joined = F.regexp_replace(text, rf"(\w)[-‐–][{WS}]+(\w)", "$1$2")
    return F.lower(F.trim(F.regexp_replace(joined, "[^a-zA-Z0-9]+", " ")))


def tight_norm(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]+", ""))


def alpha_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9]+", "")


def normalize_selection(text: Column) -> Column:
    out = F.regexp_replace(text, f"[{WS}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, " *- *", "-"), " +([,;:])", "$1"))


def normalize_deep(text: Column) -> Column:
    return F.regexp_replace(normalize_selection(text), "(?<=[a-zA-Z])([a-zA-Z]) ([a-zA-Z]{4,}-[a-z])", "$1$2")


def strip_gutter(text: Column) -> Column:
    """Drop line numbers that stand alone between spaces, then collapse spaces."""
    out = F.regexp_replace(text, f"(?<= |^)(?:{GUTTER})(?= |$)", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def fingerprint_selection(text: Column) -> Column:
    return F.substring(collapse(F.lower(F.coalesce(text, F.lit("")))), 1, 64)


#: What a claims section opens with.
PREAMBLES = ("What is claimed is", "What is claimed", "The invention claimed is", "I claim", "We claim")
#: Markers that a text may not close, and what breaks them.
MARKERS, SPLICE = ("</issue_body_untrusted>", "<issue_body_untrusted>"), "-DELIMITER-ESCAPED-PHASE-42"


def strip_preamble(text: Column) -> Column:
    """Drop the opening words of a claims section, then a leading claim number."""
    for words in PREAMBLES:
        text = F.regexp_replace(text, rf"(?i)^{words}\s*:\s*", "")
    return F.trim(F.regexp_replace(text, r"^\d+\.\s+", ""))


def escape_delimiters(text: Column, markers: tuple[str, ...] = MARKERS, splice: str = SPLICE) -> Column:
    """Break reserved markers before their last character; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for m in markers:
        out = F.replace(out, F.lit(m), F.lit(m[:-1] + splice + m[-1]))
    return out


def truncate_budget(text: Column, budget: int, suffix: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > budget, F.concat(F.substring(text, 1, budget - len(suffix)), F.lit(suffix))).otherwise(text)


def pad_cut(text: Column, width: int) -> Column:
    return F.rpad(F.coalesce(text, F.lit("")), width, " ")


def normalize_patent(raw: Column) -> Column:
    bare = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), rf"[{WS},\-]", ""))
    return F.when(bare == "", "").when(bare.startswith("US"), bare).otherwise(F.concat(F.lit("US"), bare))


def clean_patent(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, "(?i)^US", ""), "(?i)[A-Z][0-9]*$", "")


def valid_patent(digits: Column) -> Column:
    return digits.rlike("^[0-9]{6,8}$")


def is_published_application(raw: Column) -> Column:
    return F.coalesce(raw.rlike("[Aa][129]$") | F.regexp_replace(raw, "(?i)^US", "").rlike("^20[0-9]{9}"), F.lit(False))


def parse_patent_path(path: Column) -> Column:
    """A struct of patent_id, kind_code and patent_type from a URL path; null if it names no patent."""
    found = F.regexp_extract(path, "/patent/(US[0-9A-Z]+)", 1)
    kind = F.nullif(F.regexp_extract(found, "([A-Z][0-9]?)$", 1), F.lit(""))
    return F.when(found != "", F.struct(found.alias("patent_id"), kind.alias("kind_code"), F.when(kind.isin("A1", "A2", "A9"), "application").otherwise("grant").alias("patent_type")))


def short_patent_prefix(patent_id: Column, patent_type: Column) -> Column:
    """The opening of a citation: the last three digits with Pat. or App.; null without a number."""
    digits = F.regexp_extract(patent_id, "US([0-9]+)", 1)
    return F.when(digits != "", F.concat(F.lit("'"), F.when(F.length(digits) > 3, F.right(digits, F.lit(3))).otherwise(digits), F.when(patent_type == "application", " App., ").otherwise(" Pat., ")))


def apply_prefix(citation: Column, patent_id: Column, wanted: Column) -> Column:
    return F.when(wanted, F.concat_ws(" ", patent_id, citation)).otherwise(citation)


def semver_step(old: Column, new: Column) -> Column:
    """major, minor or patch; missing or odd parts are 0, a step back is a patch."""

    def part(v: Column, i: int) -> Column:
        digits = F.regexp_extract(F.try_element_at(F.split(v, r"\."), F.lit(i)), r"^\s*([+-]?[0-9]+)", 1)
        return F.coalesce(digits.try_cast("int"), F.lit(0))

    major, minor = part(new, 1) - part(old, 1), part(new, 2) - part(old, 2)
    return F.when(major > 0, "major").when((major == 0) & (minor > 0), "minor").otherwise("patch")


def browser_of(agent: Column) -> Column:
    chrome, firefox = (F.nullif(F.regexp_extract(agent, rf"({n}/[0-9.]+)", 1), F.lit("")) for n in ("Chrome", "Firefox"))
    return F.coalesce(chrome, firefox)


def os_of(agent: Column) -> Column:
    has = agent.contains
    return F.when(has("Windows NT 10.0"), "Windows 10/11").when(has("Windows"), "Windows").when(has("Mac OS X") | has("macOS"), "macOS").when(has("Linux"), "Linux").when(has("Android"), "Android").when(has("iPhone") | has("iPad"), "iOS")


def count_overlapping(text: Column, needle: Column) -> Column:
    """Occurrences at every start, overlapping ones too."""
    return F.when(needle == "", F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.length(needle)) == needle)))


def chars_around(text: Column, start: Column, stop: Column, n: int = 100) -> tuple[Column, Column]:
    """Up to n characters before and after the half-open 0-based span."""
    low = F.greatest(start - n, F.lit(0))
    return F.substr(text, low + 1, start - low), F.substr(text, stop + 1, F.lit(n))
