"""Empty tables, null and clashing columns, repeated rows and long texts, by operator."""

from pyspark.sql import functions as F

from lineloom.llm import decontaminate, license_scan, simhash, url_filter
from tests.llm.test_llm import EDGE, docs


def test_contamination_of_and_by_nothing(spark):
    frame = docs(spark, EDGE).withColumns({"Hit_Spans": F.lit("x"), "hit_items": F.lit("y")})
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.mark(frame, none).collect()
    assert len(rows) == len(EDGE) and all(r.hit_spans == [] and r.hit_items == [] for r in rows)
    bench = spark.createDataFrame([(None, "same text again"), (7, None), (8, "..."), (9, "text again"), (9, "text again")], "item_id long, text string")
    marked = decontaminate.mark(frame, bench)
    assert {r.doc_id: (r.n_words, [tuple(s) for s in r.hit_spans], r.hit_items) for r in marked.collect() if r.hit_spans} == {i: (3, [(1, 3)], [9]) for i in (7, 8)}
    assert decontaminate.mark(frame.limit(0), bench).count() == 0 and sorted(c.lower() for c in marked.columns).count("hit_spans") == 1


def test_contamination_in_a_very_long_text(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    frame = docs(spark, ["filler words " * 400_000 + item])
    row = decontaminate.mark(frame, spark.createDataFrame([("k", item)], "item_id string, text string")).first()
    assert ([tuple(s) for s in row.hit_spans], row.hit_items, row.n_words) == ([(800_000, 800_013)], ["k"], 800_013)


def test_near_duplicates_of_nothing_and_of_clashing_columns(spark):
    frame = docs(spark, EDGE).withColumns({"Fingerprint": F.lit("x"), "component_id": F.lit("y")})
    assert simhash.near_duplicates(frame.limit(0)).count() == 0 and simhash.keep_one(frame.limit(0)).count() == 0
    got = {r["id"]: r.component_id for r in simhash.near_duplicates(frame).collect()}
    assert {"Fingerprint", "component_id"} <= set(simhash.keep_one(frame).columns)
    assert len(got) == len(EDGE) and got[0] == got[1] == got[2] == 0 and got[7] == got[8] == 7


def test_licences_of_nothing_repeated_rows_and_clashing_columns(spark):
    rows = [("a/LICENSE", "Released under the MIT License.", "mine"), ("a/LICENSE", "Released under the MIT License.", "mine"), ("a/x.py", "code " * 100_000, "mine")]
    frame = spark.createDataFrame(rows, "path string, text string, License string")
    got = license_scan.scan_licenses(frame)
    assert sorted((r.path, r.license, r.via) for r in got.collect()) == [("a/LICENSE", "MIT", "own")] * 2 + [("a/x.py", "MIT", "inherited")]
    assert [c.lower() for c in got.columns].count("license") == 1 and license_scan.scan_licenses(frame.limit(0)).count() == 0


def test_repeated_urls_are_judged_alike(spark):
    frame = spark.createDataFrame([(1, "http://a.net/x")] * 3, "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.judge_urls(frame, url_filter.PAGES_RULES).collect()] == [("net/", "block")] * 3
