"""Formatting, parsing and grading of citations such as 3:14, 3:14-20 and 3:60-4:2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.text import let


def format_citation(c1: Column, l1: Column, c2: Column, l2: Column) -> Column:
    head = F.concat(c1.cast("string"), F.lit(":"), l1.cast("string"))
    return F.when((c1 == c2) & (l1 == l2), head).when(c1 == c2, F.concat(head, F.lit("-"), l2.cast("string"))).otherwise(F.concat(head, F.lit("-"), c2.cast("string"), F.lit(":"), l2.cast("string")))


def format_citation_long(c1: Column, l1: Column, c2: Column, l2: Column) -> Column:
    return F.when((c1 == c2) & (l1 == l2), F.format_string("Col. %s, l. %s", c1, l1)).when(c1 == c2, F.format_string("Col. %s, ll. %s-%s", c1, l1, l2)).otherwise(F.format_string("Col. %s, l. %s – Col. %s, l. %s", c1, l1, c2, l2))


_FORM = r"^([0-9]+):([0-9]+)(?:-(?:([0-9]+):)?([0-9]+))?$"


def parse_citation(citation: Column) -> Column:
    """A struct of start_col, start_line, end_col, end_line; null if the text is no citation."""

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(citation, _FORM, i), F.lit("")).try_cast("int")

    c, line = group(1), group(2)
    return F.when(citation.rlike(_FORM), F.struct(c.alias("start_col"), line.alias("start_line"), F.coalesce(group(3), c).alias("end_col"), F.coalesce(group(4), line).alias("end_line")))


def parse_citation_strict(citation: Column) -> Column:
    return F.coalesce(parse_citation(citation), F.raise_error(F.concat(F.lit("not a citation: "), F.coalesce(citation, F.lit("null")))))


_LOOSE = r"^\s*([+]?[0-9]+)[^:\-]*:\s*([+]?[0-9]+)([^\-]*)(?:-(.*))?$"
_LOOSE_END = r"^\s*([+-]?[0-9]+)[^:]*(?::\s*([+-]?[0-9]+)[^:]*)?$"


def parse_citation_lenient(citation: Column) -> Column:
    """As parse_citation, but trailing text after a number is ignored, and the first dash splits the range."""

    number = lambda g: F.nullif(g, F.lit("")).try_cast("int")
    groups = lambda text, pattern, n: F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, n + 1)])

    def parsed(text: Column, g: Column, e: Column) -> Column:
        dash, cross = text.contains("-"), F.get(g, F.lit(3)).contains(":")
        c1, l1, e1, e2 = [number(F.get(a, F.lit(i))) for a, i in ((g, 0), (g, 1), (e, 0), (e, 1))]
        more = F.get(g, F.lit(2)).contains(":")
        whole = F.when(~dash, ~more).when(cross, ~more & e2.isNotNull()).otherwise(e1.isNotNull())
        c2 = F.when(cross, e1).otherwise(c1)
        l2 = F.when(cross, e2).when(dash, e1).otherwise(l1)
        return F.when(whole, F.struct(c1.alias("start_col"), l1.alias("start_line"), c2.alias("end_col"), l2.alias("end_line")))

    # The citation and the groups of both patterns are computed once and then named.
    ends = lambda text, g: let(groups(F.get(g, F.lit(3)), _LOOSE_END, 2), lambda e: parsed(text, g, e))
    return let(citation, lambda text: F.when(text.rlike(_LOOSE), let(groups(text, _LOOSE, 4), lambda g: ends(text, g))))


def _signed(n: Column) -> Column:
    return F.concat(F.when(n > 0, "+").otherwise(""), n.cast("string"))


def classify_parsed(expected: Column, actual: Column, e: Column, a: Column) -> Column:
    """A struct of tier (exact, systematic, boundary, mismatch) and detail, from two citations and their parsed forms."""
    ds, de = a["start_line"] - e["start_line"], a["end_line"] - e["end_line"]
    near = (F.abs(ds) <= 1) & (F.abs(de) <= 1)

    def out(tier: str, detail: Column) -> Column:
        return F.struct(F.lit(tier).alias("tier"), detail.cast("string").alias("detail"))

    return (
        F.when(expected.isNull() | actual.isNull(), out("mismatch", F.lit("null citation")))
        .when(e.isNull() | a.isNull(), out("mismatch", F.lit("unparseable")))
        .when((e["start_col"] != a["start_col"]) | (e["end_col"] != a["end_col"]), out("mismatch", F.lit("column mismatch")))
        .when((ds == 0) & (de == 0), out("exact", F.lit(None)))
        .when(near & (ds == de), out("systematic", F.concat(F.lit("delta="), _signed(ds))))
        .when(near, out("boundary", F.concat(F.lit("delta_start="), _signed(ds), F.lit(", delta_end="), _signed(de))))
        .otherwise(out("mismatch", F.concat(F.lit("delta_start="), ds.cast("string"), F.lit(", delta_end="), de.cast("string"))))
    )


def graded(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """df with tier and detail. Each citation is parsed once, in a projection of its own, so that the code stays small."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    parsed = df.select(*columns, parse_citation_lenient(F.col(expected)).alias("__e"), parse_citation_lenient(F.col(actual)).alias("__a"))
    result = classify_parsed(F.col(expected), F.col(actual), F.col("__e"), F.col("__a"))
    return parsed.select(*columns, result.alias("__r")).select(*columns, "__r.tier", "__r.detail")


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "green").when(confidence >= 0.80, "yellow").otherwise("red")


def tier_to_number(tier: Column) -> Column:
    return F.when(tier == "green", 0.98).when(tier == "yellow", 0.90).when(tier == "red", 0.70)


def outcome_to_category(error: Column, confidence: Column) -> Column:
    """A failure's or doubtful success's report category; null for a sure success."""
    return F.when(error.isin("no-match", "paragraph-not-found"), "no_match").when(error.isin("no-position-map", "lookup-failed", "pdf-not-available"), "tool_not_working").when(confidence < 0.95, "inaccurate_citation")


def paragraph_citation(first: Column, last: Column, label: Callable[[Column], Column] = lambda n: n) -> Column:
    """`label` writes a paragraph's number; whether there is one paragraph or a range goes by the numbers, since labels of a
    fixed width may be cut to the same."""
    last = F.coalesce(last, first)
    one, more = F.concat(F.lit("¶ ["), label(first), F.lit("]")), F.concat(F.lit("¶ ["), label(first), F.lit("]-["), label(last), F.lit("]"))
    return F.when(first.isNotNull(), F.when(first == last, one).otherwise(more))
