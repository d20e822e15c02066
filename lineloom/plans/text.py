"""Normalizers, identifiers and citations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.functions import citation as C
from lineloom.functions import text as T
from lineloom.plans.base import Plans, spread, table

plans = Plans()

_WS = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _texts(name: str, function, sql: str, out: str = "out") -> None:
    """A query that maps every document's whole text, with the SQL expression over `text`."""

    @plans.add(name, f"SELECT doc_id, {sql} AS {out} FROM documents" if sql else None)
    def query(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", function(F.col("text")).alias(out))


def _sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'), ' ')"


def _sql_chain(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_LIG = list(T.LIGATURES)
_typo = _sql_chain("nfc_normalize(text)", [(a, b.replace("'", "''")) for a, b in zip(T.TYPOGRAPHIC, T.ASCII_FORMS, strict=True)])
_typo = _sql_chain(_typo, [(c, "") for c in T.INVISIBLE])
_OCR = _sql_chain("text", T.CONFUSIONS)
_texts("normalize_text", T.normalize_text, _sql_collapse(_sql_chain(_typo, _LIG)))
_texts("normalize_ocr", T.normalize_ocr, _OCR)
_texts("dehyphenate_selection", T.dehyphenate_selection, r"regexp_replace(text, '- ([a-z])', '\1', 'g')")
_texts("ws_strip", T.ws_strip, f"regexp_replace(text, '{_WS}+', '', 'g')")
_texts("ws_norm", lambda t: F.struct(T.collapse(t).alias("plain"), T.collapse(F.lower(t)).alias("lowered")).getField("lowered"), _sql_collapse("lower(text)"))
_texts("ws_norm_verifier", T.collapse, _sql_collapse("text"))
_texts("aggressive_norm", T.aggressive_norm, rf"lower(trim(regexp_replace(regexp_replace(text, '(\w)[-\x{{2010}}\x{{2013}}]{_WS}+(\w)', '\1\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')))")
_texts("tight_norm", T.tight_norm, "lower(regexp_replace(text, '[^a-zA-Z0-9]+', '', 'g'))")
_texts("normalize_sel", T.normalize_selection, rf"trim(regexp_replace(regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), ' *- *', '-', 'g'), ' +([,;:])', '\1', 'g'), ' ')")
_texts("normalize_deep", T.normalize_deep, "")
_texts("strip_gutter_numbers", lambda t: T.strip_gutter(T.collapse(t)), rf"trim(regexp_replace(regexp_replace(' ' || replace({_sql_collapse('text')}, ' ', '  ') || ' ', ' ({T.GUTTER}) ', ' ', 'g'), ' +', ' ', 'g'), ' ')")
_texts("fingerprint_selection", T.fingerprint_selection, f"substr({_sql_collapse('lower(coalesce(text, chr(32)))')}, 1, 64)")
_texts("strip_preamble", lambda t: T.strip_preamble(F.concat(F.lit("What is claimed is:  1. "), t)), "trim(regexp_replace(text, '^[0-9]+\\.\\s+', ''), ' ')")
_texts("escape_delimiters", lambda t: T.escape_delimiters(F.concat(F.lit("<issue_body_untrusted>"), t, F.lit("</issue_body_untrusted>"))), "'<issue_body_untrusted-DELIMITER-ESCAPED-PHASE-42>' || text || '</issue_body_untrusted-DELIMITER-ESCAPED-PHASE-42>'")
_texts("truncate_budget", lambda t: T.truncate_budget(t, 800), "CASE WHEN length(text) > 800 THEN substr(text, 1, 785) || '... [truncated]' ELSE text END")
_texts("pad_cut", lambda t: T.pad_cut(t, 40), "rpad(coalesce(text, ''), 40, ' ')")


@plans.add("selection_context", "SELECT doc_id, substr(text, 101, 100) AS before, substr(text, 251, 100) AS after FROM documents WHERE length(text) >= 250")
def selection_context(spark, sf_dir):
    before, after = T.chars_around(F.col("text"), F.lit(200), F.lit(250))
    return table(spark, sf_dir, "documents").where(F.length("text") >= 250).select("doc_id", before.alias("before"), after.alias("after"))


_RAW = "CASE p_partkey % 5 WHEN 0 THEN 'us ' || (10000000 + p_partkey) || ' B2' WHEN 1 THEN '20' || (210000000 + p_partkey) WHEN 2 THEN 'US' || (9000000 + p_partkey) || 'A1' WHEN 3 THEN '1,0' || p_partkey || '-7' ELSE 'US' || p_partkey || 'B1' END"


def _raw(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_RAW).alias("raw"))


@plans.add("normalize_patent", f"SELECT p_partkey, CASE WHEN starts_with(b, 'US') THEN b ELSE 'US' || b END AS patent FROM (SELECT p_partkey, upper(regexp_replace({_RAW}, '[\\s,\\-]', '', 'g')) AS b FROM part)")
def normalize_patent(spark, sf_dir):
    return _raw(spark, sf_dir).select("p_partkey", T.normalize_patent(F.col("raw")).alias("patent"))


@plans.add("clean_patent", f"SELECT p_partkey, d AS digits, regexp_full_match(d, '[0-9]{{6,8}}') AS valid FROM (SELECT p_partkey, regexp_replace(regexp_replace({_RAW}, '^US', '', 'i'), '[A-Z][0-9]*$', '', 'i') AS d FROM part)")
def clean_patent(spark, sf_dir):
    digits = T.clean_patent(F.col("raw"))
    return _raw(spark, sf_dir).select("p_partkey", digits.alias("digits"), T.valid_patent(digits).alias("valid"))


@plans.add("is_published_application", f"SELECT p_partkey, regexp_matches(r, '[Aa][129]$') OR regexp_matches(regexp_replace(r, '^US', '', 'i'), '^20[0-9]{{9}}') AS published FROM (SELECT p_partkey, {_RAW} AS r FROM part)")
def is_published_application(spark, sf_dir):
    return _raw(spark, sf_dir).select("p_partkey", T.is_published_application(F.col("raw")).alias("published"))


_PATH = "CASE p_partkey % 3 WHEN 0 THEN '/patent/US' || (10000000 + p_partkey) || 'B2/en' WHEN 1 THEN '/patent/US20210' || p_partkey || 'A1' ELSE '/search?q=' || p_partkey END"


@plans.add("parse_patent_path", f"SELECT p_partkey, nullif(i, '') AS patent_id, CASE WHEN i <> '' THEN nullif(regexp_extract(i, '([A-Z][0-9]?)$', 1), '') END AS kind_code, CASE WHEN i <> '' THEN CASE WHEN regexp_extract(i, '([A-Z][0-9]?)$', 1) IN ('A1', 'A2', 'A9') THEN 'application' ELSE 'grant' END END AS patent_type FROM (SELECT p_partkey, regexp_extract({_PATH}, '/patent/(US[0-9A-Z]+)', 1) AS i FROM part)")
def parse_patent_path(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.parse_patent_path(F.expr(_PATH)).alias("p")).select("p_partkey", "p.patent_id", "p.kind_code", "p.patent_type")


@plans.add("short_patent_prefix", f"SELECT p_partkey, CASE WHEN d <> '' THEN '''' || right(d, 3) || CASE WHEN p_partkey % 2 = 0 THEN ' Pat., ' ELSE ' App., ' END END AS prefix FROM (SELECT p_partkey, regexp_extract({_RAW}, 'US([0-9]+)', 1) AS d FROM part)")
def short_patent_prefix(spark, sf_dir):
    kind = F.when(F.col("p_partkey") % 2 == 0, "grant").otherwise("application")
    return _raw(spark, sf_dir).select("p_partkey", T.short_patent_prefix(F.col("raw"), kind).alias("prefix"))


@plans.add("apply_prefix", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'US' || p_partkey || ' 4:15-22' ELSE '4:15-22' END AS citation FROM part")
def apply_prefix(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", T.apply_prefix(F.lit("4:15-22"), F.concat(F.lit("US"), F.col("p_partkey").cast("string")), F.col("p_size") > 25).alias("citation"))


_AGENT = "CASE event_id % 6 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/12' || (event_id % 9) || '.0 Safari/537' WHEN 1 THEN 'Mozilla/5.0 (X11; Linux) Firefox/1' || (event_id % 7) WHEN 2 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10) Safari/1' WHEN 3 THEN 'Mozilla/5.0 (Linux; Android 14) Chrome/99.1' WHEN 4 THEN 'Mozilla/5.0 (iPhone; CPU) Mobile' ELSE 'curl/8' END"


@plans.add("browser_os_parse", f"""SELECT event_id, coalesce(nullif(regexp_extract(a, '(Chrome/[0-9.]+)', 1), ''), nullif(regexp_extract(a, '(Firefox/[0-9.]+)', 1), '')) AS browser,
CASE WHEN contains(a, 'Windows NT 10.0') THEN 'Windows 10/11' WHEN contains(a, 'Windows') THEN 'Windows' WHEN contains(a, 'Mac OS X') OR contains(a, 'macOS') THEN 'macOS' WHEN contains(a, 'Linux') THEN 'Linux' WHEN contains(a, 'Android') THEN 'Android' WHEN contains(a, 'iPhone') OR contains(a, 'iPad') THEN 'iOS' END AS os
FROM (SELECT event_id, {_AGENT} AS a FROM events)""")
def browser_os_parse(spark, sf_dir):
    agent = F.expr(_AGENT)
    return table(spark, sf_dir, "events").select("event_id", T.browser_of(agent).alias("browser"), T.os_of(agent).alias("os"))


@plans.add("semver_categorize", "SELECT l_orderkey, l_linenumber, CASE WHEN n1 > o1 THEN 'major' WHEN n1 = o1 AND n2 > o2 THEN 'minor' ELSE 'patch' END AS step FROM (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS o1, l_partkey % 5 AS o2, l_suppkey % 3 AS n1, l_suppkey % 4 AS n2 FROM lineitem)")
def semver_categorize(spark, sf_dir):
    old, new = F.expr("concat(l_partkey % 3, '.', l_partkey % 5, '.1')"), F.expr("concat(l_suppkey % 3, '.', l_suppkey % 4)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.semver_step(old, new).alias("step"))


# Citations: lineitem rows stand for spans.
_SPAN = "1 + l_partkey % 4 AS c1, 1 + l_suppkey % 60 AS l1, 1 + l_partkey % 4 + CAST(l_linenumber = 7 AS INT) AS c2, 1 + l_suppkey % 60 + l_linenumber % 3 AS l2"
_SHORT = "CASE WHEN c1 = c2 AND l1 = l2 THEN c1 || ':' || l1 WHEN c1 = c2 THEN c1 || ':' || l1 || '-' || l2 ELSE c1 || ':' || l1 || '-' || c2 || ':' || l2 END"


def _spans(spark, sf_dir):
    return spread(table(spark, sf_dir, "lineitem")).selectExpr("l_orderkey", "l_linenumber", *_SPAN.split(", "))


_COLS = ("c1", "l1", "c2", "l2")


@plans.add("format_citation", f"SELECT l_orderkey, l_linenumber, {_SHORT} AS citation FROM (SELECT *, {_SPAN} FROM lineitem)")
def format_citation(spark, sf_dir):
    return _spans(spark, sf_dir).select("l_orderkey", "l_linenumber", C.format_citation(*map(F.col, _COLS)).alias("citation"))


@plans.add("format_citation_long", f"SELECT l_orderkey, l_linenumber, CASE WHEN c1 = c2 AND l1 = l2 THEN 'Col. ' || c1 || ', l. ' || l1 WHEN c1 = c2 THEN 'Col. ' || c1 || ', ll. ' || l1 || '-' || l2 ELSE 'Col. ' || c1 || ', l. ' || l1 || ' – Col. ' || c2 || ', l. ' || l2 END AS citation FROM (SELECT *, {_SPAN} FROM lineitem)")
def format_citation_long(spark, sf_dir):
    return _spans(spark, sf_dir).select("l_orderkey", "l_linenumber", C.format_citation_long(*map(F.col, _COLS)).alias("citation"))


@plans.add("parse_citation_strict", f"SELECT l_orderkey, l_linenumber, CAST(c1 AS INT) AS start_col, CAST(l1 AS INT) AS start_line, CAST(c2 AS INT) AS end_col, CAST(l2 AS INT) AS end_line FROM (SELECT *, {_SPAN} FROM lineitem)")
def parse_citation_strict(spark, sf_dir):
    return _spans(spark, sf_dir).select("l_orderkey", "l_linenumber", C.parse_citation_strict(C.format_citation(*map(F.col, _COLS))).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


@plans.add("parse_citation_lenient", f"SELECT l_orderkey, l_linenumber, CAST(c1 AS INT) AS start_col, CAST(l1 AS INT) AS start_line, CAST(c2 AS INT) AS end_col, CAST(l2 AS INT) AS end_line FROM (SELECT *, {_SPAN} FROM lineitem) WHERE l_linenumber <> 2")
def parse_citation_lenient(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 2, F.lit("n/a")).otherwise(F.concat(F.lit(" "), C.format_citation(*map(F.col, _COLS)), F.lit(" approx.")))
    parsed = _spans(spark, sf_dir).select("l_orderkey", "l_linenumber", C.parse_citation_lenient(text).alias("p"))
    return parsed.where("p IS NOT NULL").select("l_orderkey", "l_linenumber", "p.*")


_EXPECTED = "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE c1 || ':' || l1 || '-' || (l1 + 2) END"
_ACTUAL = "CASE WHEN l_orderkey % 13 = 0 THEN 'n/a' ELSE (c1 + CAST(l_orderkey % 17 = 0 AS INT)) || ':' || (l1 + l_linenumber % 3 - 1) || '-' || (l1 + 2 + l_orderkey % 4 - 1) END"


@plans.add("classify_result", f"""WITH s AS (SELECT *, {_SPAN} FROM lineitem), t AS (SELECT *, l_linenumber % 3 - 1 AS ds, l_orderkey % 4 - 1 AS de, {_EXPECTED} AS e, {_ACTUAL} AS a FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN e IS NULL OR a = 'n/a' OR l_orderkey % 17 = 0 THEN 'mismatch' WHEN ds = 0 AND de = 0 THEN 'exact' WHEN abs(ds) <= 1 AND abs(de) <= 1 THEN CASE WHEN ds = de THEN 'systematic' ELSE 'boundary' END ELSE 'mismatch' END AS tier,
CASE WHEN e IS NULL THEN 'null citation' WHEN a = 'n/a' THEN 'unparseable' WHEN l_orderkey % 17 = 0 THEN 'column mismatch' WHEN ds = 0 AND de = 0 THEN NULL
WHEN abs(ds) <= 1 AND abs(de) <= 1 THEN CASE WHEN ds = de THEN 'delta=' || CASE WHEN ds > 0 THEN '+' ELSE '' END || ds ELSE 'delta_start=' || CASE WHEN ds > 0 THEN '+' ELSE '' END || ds || ', delta_end=' || CASE WHEN de > 0 THEN '+' ELSE '' END || de END
ELSE 'delta_start=' || ds || ', delta_end=' || de END AS detail FROM t""")
def classify_result(spark, sf_dir):
    rows = _spans(spark, sf_dir).select("*", F.expr(_EXPECTED).alias("e"), F.expr(_ACTUAL).alias("a"))
    return C.graded(rows, "e", "a").select("l_orderkey", "l_linenumber", "tier", "detail")


@plans.add("confidence_tier", "SELECT l_orderkey, l_linenumber, CASE WHEN 1 - l_discount * 3 >= 0.95 THEN 'green' WHEN 1 - l_discount * 3 >= 0.80 THEN 'yellow' ELSE 'red' END AS tier, CASE WHEN 1 - l_discount * 3 >= 0.95 THEN CAST(0.98 AS DOUBLE) WHEN 1 - l_discount * 3 >= 0.80 THEN CAST(0.90 AS DOUBLE) ELSE CAST(0.70 AS DOUBLE) END AS as_number FROM lineitem")
def confidence_tier(spark, sf_dir):
    tier = C.confidence_tier(1 - F.col("l_discount") * 3)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tier.alias("tier"), C.tier_to_number(tier).alias("as_number"))


@plans.add("color_to_numeric", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(0.98 AS DOUBLE) WHEN 1 THEN CAST(0.90 AS DOUBLE) WHEN 2 THEN CAST(0.70 AS DOUBLE) END AS as_number FROM events")
def color_to_numeric(spark, sf_dir):
    colour = F.expr("CASE event_id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'red' ELSE 'grey' END")
    return table(spark, sf_dir, "events").select("event_id", C.tier_to_number(colour).alias("as_number"))


@plans.add("outcome_to_category", "SELECT event_id, CASE WHEN e IN ('no-match', 'paragraph-not-found') THEN 'no_match' WHEN e IS NOT NULL THEN 'tool_not_working' WHEN value / 100 < 0.95 THEN 'inaccurate_citation' END AS category FROM (SELECT *, CASE event_id % 6 WHEN 0 THEN 'no-match' WHEN 1 THEN 'paragraph-not-found' WHEN 2 THEN 'lookup-failed' WHEN 3 THEN 'no-position-map' END AS e FROM events)")
def outcome_to_category(spark, sf_dir):
    error = F.expr("CASE event_id % 6 WHEN 0 THEN 'no-match' WHEN 1 THEN 'paragraph-not-found' WHEN 2 THEN 'lookup-failed' WHEN 3 THEN 'no-position-map' END")
    return table(spark, sf_dir, "events").select("event_id", C.outcome_to_category(error, F.col("value") / 100).alias("category"))


@plans.add("paragraph_citation", "SELECT doc_id, '¶ [' || lpad(CAST(doc_id AS VARCHAR), 4, '0') || ']' || CASE WHEN doc_id % 3 = 0 THEN '-[' || lpad(CAST(doc_id + 2 AS VARCHAR), 4, '0') || ']' ELSE '' END AS citation FROM documents")
def paragraph_citation(spark, sf_dir):
    last = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 2)
    label = lambda n: F.lpad(n.cast("string"), 4, "0")
    return table(spark, sf_dir, "documents").select("doc_id", C.paragraph_citation(F.col("doc_id"), last, label).alias("citation"))


QUERIES, SQL = plans.QUERIES, plans.SQL
