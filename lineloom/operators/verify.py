"""An independent check of citations: its own layout, its own normal forms, four tiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions import text as T
from lineloom.functions.citation import parse_citation
from lineloom.operators.layout import by_page, by_place, count_of, empty_strips, points, rows_of, sorted_fragments

#: Fixed values.
TOLERANCE_LINES, PER_COLUMN, NEAR_BOUNDARY, GATE, CLUSTER = 10, 120, 25, 0.95, 3
PAGE = ["doc_id", "page"]


def _facts() -> dict[str, Column]:
    """What has to be known of a page for its boundary."""
    mid = F.col("page_width") / 2
    return {"l": count_of("x", lambda x: x < mid), "r": count_of("x", lambda x: x >= mid), "points": points()}


def _bounds() -> dict[str, Column]:
    """boundary and two_column from these facts."""
    width = F.col("page_width")
    best = F.array_min(F.transform(empty_strips(F.col("points"), width), lambda s: F.struct(s["last"].cast("int").alias("last"), s["off"].alias("off"), s["b"].alias("b"), s["middle"].alias("middle"))))
    single = (F.col("l") + F.col("r") < 30) | (F.least("l", "r") <= 0.3 * F.greatest("l", "r"))
    return {"boundary": F.when(single, width).otherwise(F.coalesce(best["middle"], width / 2)), "two_column": ~single}


def boundary(items: DataFrame) -> DataFrame:
    """Per page the column boundary, or the page's width if it has one column. A strip that reaches the search range's
    end counts only if there is no other."""
    pages = by_page(items).select(*PAGE, "page_width", *[c.alias(k) for k, c in _facts().items()])
    return pages.select(*PAGE, *[c.alias(k) for k, c in _bounds().items()])


def mean_runs(y: Column) -> Column:
    """Sorted y -> lines (first, y, n) from the top: an item more than three points below the last line's running mean opens a
    new line. Items come sorted, so an earlier line is never nearer than the last one. y is the mean, first the place of the
    first of n items."""
    line = lambda s: F.array(F.struct(s["first"], s["y"], s["n"]))
    done = lambda s: F.when(s["n"] > 0, F.concat(s["done"], line(s))).otherwise(s["done"])

    def state(done: Column, first: Column, y: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), first.alias("first"), y.alias("y"), n.alias("n"))

    def step(s: Column, y: Column) -> Column:
        near = (s["n"] > 0) & (F.abs(s["y"] - y) <= CLUSTER)
        longer = state(s["done"], s["first"], (s["y"] * s["n"] + y) / (s["n"] + 1), s["n"] + 1)
        return F.when(near, longer).otherwise(state(done(s), s["first"] + s["n"], y, F.lit(1)))

    none = state(F.array().cast("array<struct<first: int, y: double, n: int>>"), F.lit(0), F.lit(None).cast("double"), F.lit(0))
    return F.aggregate(y.cast("array<double>"), none, step, done)


def mean_lines(fragments: Column) -> Column:
    """Sorted fragments -> the lines of `mean_runs` (y, items), items by x."""

    def lines(f: Column, places: Column) -> Column:
        return F.transform(mean_runs(f["y"]), lambda c: F.struct(c["y"].alias("y"), F.sort_array(F.slice(places, c["first"] + 1, c["n"])).alias("items")))

    return T.let(fragments, lambda f: T.let(by_place(f, "text"), lambda places: lines(f, places)))


def clusters(items: DataFrame) -> DataFrame:
    """doc_id, page, side, line_number (from 1), y (the running mean), text of the lines of each column of a page, without
    what stands in the header, the footer or between the columns. Pages are not moved."""
    facts = {**_facts(), "f": sorted_fragments(F.col("items"), "x", "text", "y")}
    pages = by_page(items).select(*PAGE, "page_width", "page_height", *[c.alias(k) for k, c in facts.items()]).select(*PAGE, "page_height", "f", *[c.alias(k) for k, c in _bounds().items()])

    def stays(i: Column) -> Column:
        near = F.abs(i["x"] - F.col("boundary")) <= NEAR_BOUNDARY
        return (i["y"] >= 40) & (i["y"] <= F.col("page_height") - 90) & ~(F.col("two_column") & near & F.trim(i["text"]).rlike(f"^(?:{T.GUTTER})$"))

    inside = pages.select(*PAGE, "boundary", F.filter("f", stays).alias("f"))
    left, right = F.filter("f", lambda i: i["x"] < F.col("boundary")), F.filter("f", lambda i: i["x"] >= F.col("boundary"))
    halves = [F.struct(F.lit(k).alias("side"), side.alias("f")) for k, side in ((1, left), (2, right))]
    sides = rows_of(inside, F.array(*halves), *PAGE)
    lines = sides.select(*PAGE, "side", F.posexplode_outer(mean_lines(F.col("f"))).alias("k", "line")).where("k IS NOT NULL")
    return lines.select(*PAGE, "side", (F.col("k") + 1).alias("line_number"), "line.y", F.array_join(F.col("line.items")["text"], " ").alias("text"))


def infer_lines(items: DataFrame) -> DataFrame:
    """doc_id, page, side, line_number, text: the lines of `clusters`, numbered one by one."""
    return clusters(items).drop("y")


def line_pixel_y(cited: DataFrame, items: DataFrame, dpi: int = 150) -> DataFrame:
    """cited (doc_id, page, line) -> pixel_y too: how far down the page's image a line stands, in pixels.

    Lines are those of the whole page over both columns, blank items aside; a number past the last line means the last one.
    A page without items gives the middle of an image of page_height (of cited, if it has one; else null).
    """
    pages = by_page(items.where(F.trim("text") != "") if "text" in items.columns else items).select(*PAGE, F.col("page_height").alias("__h"), sorted_fragments(F.filter("items", lambda i: F.trim(i["text"]) != ""), "y").alias("__f"))
    lines = pages.select(*PAGE, "__h", F.when(F.size("__f") > 0, mean_runs(F.col("__f")["y"])["y"]).alias("__y"))
    met = cited.join(lines, PAGE, "left")
    own = met["page_height"] if "page_height" in cited.columns else F.lit(None).cast("double")
    place = F.greatest(F.lit(0), F.least(F.col("line") - 1, F.size("__y") - 1)).cast("int")
    scale = dpi / 72
    y = F.when(F.col("__y").isNull(), own * scale / 2).otherwise(F.col("__h") * scale - F.get("__y", place) * dpi / 72)
    return met.select(*cited.columns, y.alias("pixel_y"))


def printed_columns(items: DataFrame) -> DataFrame:
    """Per page the least left number in the header band that has its successor on the right."""
    number = lambda i: F.regexp_extract(i["text"], r"(\d+)", 1).cast("int")
    band = F.filter("items", lambda i: (i["y"] >= F.col("page_height") - 110) & (i["y"] <= F.col("page_height") - 40) & F.trim(i["text"]).rlike(r"^\d{1,3}\.?$"))
    mid = F.col("page_width") / 2

    def least(b: Column) -> Column:
        right = F.transform(F.filter(b, lambda i: i["x"] >= mid), lambda i: number(i) - 1)
        return F.array_min(F.array_intersect(F.transform(F.filter(b, lambda i: i["x"] < mid), number), right))

    found = by_page(items).select(*PAGE, F.array(F.struct(T.let(band, least).alias("left"))).alias("n"))
    return rows_of(found, F.col("n"), *PAGE).where("left IS NOT NULL").withColumn("right", F.col("left") + 1)


def backfill_columns(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, two_column, left): two-column pages before the first printed one get its number less two a
    page, if as many pages as are missing can stand there."""
    first = pages.where(F.col("left").isNotNull()).groupBy("doc_id").agg(F.min("page").alias("p"), F.min_by("left", "page").alias("n"))
    met = pages.join(first, "doc_id", "left")
    before = Window.partitionBy("doc_id").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, 0)
    back = F.sum((F.col("two_column") & (F.col("page") < F.col("p"))).cast("int")).over(before)
    earlier = F.count_if(F.col("page") < F.col("p")).over(Window.partitionBy("doc_id"))
    guess = F.col("n") - 2 * back
    missing = (F.col("n") - 1) / 2
    fits = (F.col("page") < F.col("p")) & F.col("two_column") & (guess >= 1) & (missing == F.floor(missing)) & (missing >= 1) & (missing <= earlier)
    return met.withColumn("left", F.coalesce("left", F.when(fits, guess).cast("int"))).select("doc_id", "page", "two_column", "left")


def lines_in_range(cases: DataFrame, lines: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """cases (case_id, doc_id, citation) -> case_id with the cited lines as an array of (column, line, text).

    Of lines with the same column and number the last counts, at most PER_COLUMN lines of a column.
    """
    last = lines.groupBy("doc_id", "column", "line_number").agg(F.max_by("text", "entry_idx").alias("text"))
    c = cases.select("case_id", "doc_id", parse_citation(F.col("citation")).alias("c"))
    spans = c.withColumn("column", F.explode(F.sequence(F.col("c.start_col"), F.col("c.end_col"))))
    low = F.when(F.col("column") == F.col("c.start_col"), F.greatest(F.lit(1), F.col("c.start_line") - before)).otherwise(1)
    high = F.when(F.col("column") == F.col("c.end_col"), F.col("c.end_line") + after).otherwise(PER_COLUMN)
    met = spans.select("case_id", "doc_id", "column", low.alias("low"), F.least(high, F.lit(PER_COLUMN)).alias("high")).join(last, ["doc_id", "column"]).where((F.col("line_number") >= F.col("low")) & (F.col("line_number") <= F.col("high")))
    return met.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("column", "line_number", "text"))).alias("lines"))


def _cited(c: Column) -> Callable[[Column], Column]:
    """Whether a line lies in a parsed citation."""
    return lambda x: ((x["column"] > c["start_col"]) | (x["line_number"] >= c["start_line"])) & ((x["column"] < c["end_col"]) | (x["line_number"] <= c["end_line"]))


def _joined(lines: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(lines, lambda x: x["text"]), " "), F.lit(""))


def _any_form(window: Column, wanted: Column) -> Column:
    return F.contains(T.collapse(window), T.collapse(wanted)) | F.contains(T.aggressive_norm(window), T.aggressive_norm(wanted)) | F.contains(T.tight_norm(window), T.tight_norm(wanted))


def signed_offset(lines: Column, wanted: Column, start_col: Column, start_line: Column, end_col: Column, end_line: Column) -> Column:
    """The last line from which the lines below still hold the text, against the cited start (or end) line."""
    holds = F.filter(F.transform(lines, lambda x, i: F.struct(x["column"].alias("c"), x["line_number"].alias("n"), F.contains(T.collapse(_joined(F.slice(lines, i + 1, F.size(lines)))), wanted).alias("h"))), lambda s: s["h"])
    best = F.try_element_at(holds, F.lit(-1))
    return F.when(best["c"] == start_col, best["n"] - start_line).when(best["c"] == end_col, best["n"] - end_line).when(best.isNotNull(), 0)


def verify_citations(cases: DataFrame, lines: DataFrame) -> DataFrame:
    """cases (case_id, doc_id, text, citation) -> case_id, status, tier, offset.

    A: the text stands in the cited lines; B: it does in one of three normal forms; C: so within ten lines around;
    D: none. Cited lines without text are never A. Lines move once: the cited ones are taken from those around.
    """
    wide = lines_in_range(cases, lines, TOLERANCE_LINES, TOLERANCE_LINES).withColumnRenamed("lines", "wide")
    around = cases.join(wide, "case_id", "left").select("case_id", "text", parse_citation(F.col("citation")).alias("c"), "wide")
    met = around.select("*", _joined(F.filter("wide", _cited(F.col("c")))).alias("e"), _joined(F.col("wide")).alias("w"))
    tier = F.when((F.trim("e") != "") & F.contains("e", F.col("text")), "A").when(_any_form(F.col("e"), F.col("text")), "B").when(_any_form(F.col("w"), F.col("text")), "C").otherwise("D")
    graded = met.withColumn("tier", tier)
    offset = F.coalesce(signed_offset(F.col("wide"), T.collapse(F.col("text")), F.col("c.start_col"), F.col("c.start_line"), F.col("c.end_col"), F.col("c.end_line")), F.lit(0))
    return graded.select("case_id", F.when(F.col("tier") == "D", "disagree").otherwise("pass").alias("status"), "tier", F.when(F.col("tier") == "C", offset).when(F.col("tier") != "D", 0).cast("int").alias("offset"))


def calibrate(verdicts: DataFrame) -> DataFrame:
    """Counts by tier, the rate of A, B and C, and whether it reaches the gate."""
    rate = F.count_if(F.col("tier") != "D") / F.count("*")
    return verdicts.agg(*[F.count_if(F.col("tier") == t).alias(t) for t in "ABCD"], F.round(rate, 9).alias("rate"), (rate >= GATE).alias("passed"))
