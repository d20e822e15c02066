"""Queries against their SQL over keys and rows that the small tables do not have."""

import duckdb
from test_plans import plain

from lineloom.plans import registry


def same(spark, tmp_path, name, **tables):
    """Rows of the query and of its SQL over frames written as tables."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = plain(registry.queries()[name](spark, str(tmp_path)).toPandas())
    assert got == plain(c.execute(registry.oracle_sql()[name]).df())
    return got[1]


def test_paragraphs_past_four_digits(spark, tmp_path):
    docs = spark.createDataFrame([(n, "a") for n in (0, 3, 9999, 10002, 10003, 100002)], "doc_id long, text string")
    got = same(spark, tmp_path, "paragraph_citation", documents=docs)
    assert any("¶ [1000]-[1000]" in r for r in got)


def test_exact_matches_of_every_passage_in_every_document(spark, tmp_path):
    """Short documents, documents that hold several passages, and passages that several documents hold."""
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one\nalpha  beta\ngamma delta epsilon"), (3, "zeta"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "alpha beta"), ("d", "gamma delta"), ("z", "zeta"), ("n", "nowhere")], "item_id string, text string")
    assert len(same(spark, tmp_path, "match_exact", documents=docs, benchmark=items)) == 4


def test_pages_of_any_text_are_read_back_whole(spark, tmp_path):
    """Line breaks, carriage returns, no text at all; a page is not a file of its own."""
    pages = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None), (4, "x\ny z 😀\\\"")], "page_id long, html string")
    assert len(same(spark, tmp_path, "src_html", pages=pages)) == 4
    assert registry.queries()["src_html"](spark, str(tmp_path)).inputFiles().__len__() < 4 + spark.sparkContext.defaultParallelism


def test_references_are_decoded_once_a_step(spark):
    """The expression stays small: it does not name its own result again and again."""
    from pyspark.sql import functions as F

    from lineloom.operators import html as H

    df = spark.createDataFrame([("&#38;lt; &amp;lt; &#x41;&#xFFFFFF;&nope; &#960;",), (None,), ("plain",)], "t string").select(H.decode_entities(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == ["< &lt; A&#xFFFFFF;&nope; π", None, "plain"]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 6


def test_pages_are_not_moved(spark):
    """Layout of pages shuffles nothing by page; a document's lines move once."""

    def moves(name):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert [moves(n) for n in ("printed_columns", "column_boundary", "cluster_lines", "assign_lines_grid", "assign_lines_gap", "v_cluster")] == [0] * 6
    assert [moves(n) for n in ("fallback_columns", "page_sequence_gate", "build_position_map", "process_page", "doc_map_meta")] == [1] * 5


def test_items_are_zipped(spark):
    """The items of pages come from constant arrays, without a struct made by a lambda function for each word, and a page's
    words are cut out of a document's once the page is a row."""
    from lineloom.plans import layout, service

    for make in (layout.items, layout.uneven, service._uneven):
        made = make(spark, "/root/testdata/sf0.001")
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "arrays_zip" in plan and "named_struct" not in plan and "struct(" not in plan and "lambdafunction(slice" not in plan
        assert made.selectExpr("inline(items)").columns == ["text", "x", "y", "seq", "width", "height"]


def test_a_citation_is_matched_once(spark):
    """Each group of a citation is extracted once, whatever the citation is computed from."""
    from pyspark.sql import functions as F

    from lineloom.functions import citation as C

    rows = [("3:14",), (" 3:14-20 approx.",), ("3:60-4:2",), ("3:14-x",), ("n/a",), (None,), ("1:2:3",)]
    df = spark.createDataFrame(rows, "t string").select(C.parse_citation_lenient(F.concat(F.lit(" "), "t")).alias("p"))
    assert [r.p and tuple(r.p) for r in df.collect()] == [(3, 14, 3, 14), (3, 14, 3, 20), (3, 60, 4, 2), None, None, None, None]
    assert df._jdf.queryExecution().analyzed().toString().lower().count("regexp_extract(") == 6


def test_fragments_are_joined_as_by_the_fold(spark):
    """Empty and null fragments of a line, and gaps of up to one point."""
    from pyspark.sql import functions as F

    from lineloom.operators import layout as L

    kind = "entries array<struct<text: string, x: double, y: double, width: double, height: double>>"
    lines = [[("a", 0.0), ("b", 6.0), ("c", 12.5)], [("a", 0.0), ("", 9.0), ("b", 20.0)], [("a", 0.0), (None, 9.0)], [("a ", 0.0), ("b", 9.0)]]
    df = spark.createDataFrame([([(t, x, 1.0, 5.0, 9.0) for t, x in line],) for line in lines], kind)
    assert [r[0] for r in df.select(L.line_entry(F.col("entries"))["text"]).collect()] == ["ab c", "a b", None, "a b"]


def test_fragments_are_zipped(spark):
    """No struct is made by a lambda function for each item that is sorted."""
    for name in ("cluster_lines", "v_cluster", "line_pixel_y", "build_position_map"):
        assert "struct(down" not in registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_both_windows_of_an_event_end_at_the_same_time(spark, tmp_path):
    """Events at the edges of 7 and of 30 days before one time, past it, and at the edge of 30 days before a later time."""
    times = ["2023-12-29 11:59:59.999999", "2023-12-29 12:00:00", "2024-01-11 11:59:59", "2024-01-11 12:00:00", "2024-01-21 11:59:59.999999", "2024-01-21 12:00:00", "2024-01-28 12:00:00", "2024-02-20 00:00:00"]
    events = spark.createDataFrame(list(enumerate(times)), "event_id long, ts string").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts")
    assert len(same(spark, tmp_path, "recently_updated", events=events)) == len(times)
    rows = sorted(registry.queries()["recently_updated"](spark, str(tmp_path)).collect())
    assert [r.in_window for r in rows] == [False] + [True] * 7
    assert [r.recent for r in rows] == [False] * 5 + [True] * 3
    assert [r.in_later_window for r in rows] == [False] * 3 + [True] * 5
