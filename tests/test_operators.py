"""Citations, layout, verification and intake on small frames."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lineloom.functions import citation as C
from lineloom.functions import text as T
from lineloom.operators import html as H
from lineloom.operators import intake as I
from lineloom.operators import layout as L
from lineloom.operators import rules as R
from lineloom.operators import verify as V


@pytest.mark.parametrize(
    ("expected", "actual", "tier"),
    [("1:2", "1:2", "exact"), ("1:2-5", "1:3-6", "systematic"), ("1:2-5", "1:2-6", "boundary"), ("1:2-5", "1:3-4", "boundary"), ("1:2-5", "1:2-8", "mismatch"), ("1:2", "2:2", "mismatch"), (None, "1:2", "mismatch"), ("1:2", "n/a", "mismatch"), ("1:60-2:3", "1:60-2:3", "exact")],
)
def test_grading(spark, expected, actual, tier):
    df = spark.createDataFrame([(expected, actual)], "e string, a string")
    assert C.graded(df, "e", "a").first().tier == tier


def test_strict_parse_raises(spark):
    with pytest.raises(Exception, match="not a citation"):
        spark.createDataFrame([("x",)], "c string").select(C.parse_citation_strict(F.col("c"))).collect()


def test_normalizers(spark):
    row = spark.createDataFrame([("a  “b” ﬁn​ é ", "US 10,123-456 B2", "x 25 y 30% 5")], "a string, b string, c string")
    got = row.select(T.normalize_text(F.col("a")), T.normalize_patent(F.col("b")), T.strip_gutter(F.col("c"))).first()
    assert tuple(got) == ('a "b" fin é', "US10123456B2", "x y 30%")
    assert row.select(T.normalize_deep(F.lit("prolif eration-inducing a quick-fox"))).first()[0] == "proliferation-inducing a quick-fox"


def _items(rows):
    return [(1, 0, i, t, float(x), float(y), 20.0, 10.0, 612.0, 792.0) for i, (t, x, y) in enumerate(rows)]


ITEMS = "doc_id long, page int, seq int, text string, x double, y double, width double, height double, page_width double, page_height double"


def test_a_line_opens_three_points_from_its_first_item_not_its_last(spark):
    df = spark.createDataFrame(_items([("a", 60, 700), ("b", 90, 697.5), ("c", 120, 695)]), ITEMS).withColumn("side", F.lit(0))
    assert [len(r.entries) for r in L.cluster_lines(df).orderBy("line_idx").collect()] == [2, 1]


def test_fragments_join_by_gap(spark):
    df = spark.createDataFrame(_items([("wo", 60, 700), ("rd", 80.5, 700), ("next", 110, 700)]), ITEMS).withColumn("side", F.lit(0))
    assert L.cluster_lines(df).select(L.line_entry(F.col("entries"))["text"]).first()[0] == "word next"


def test_verifier_tiers(spark):
    lines = spark.createDataFrame([(1, i, 1, i + 1, t) for i, t in enumerate(["alpha beta", "gamma delta", "epsilon zeta", "eta"])], "doc_id long, entry_idx int, column int, line_number int, text string")
    cases = spark.createDataFrame([(1, 1, "beta gamma", "1:1-2"), (2, 1, "BETA  gamma", "1:1-2"), (3, 1, "epsilon", "1:1"), (4, 1, "omega", "1:1")], "case_id long, doc_id long, text string, citation string")
    got = {r.case_id: (r.tier, r.offset) for r in V.verify_citations(cases, lines).collect()}
    assert got == {1: ("A", 0), 2: ("B", 0), 3: ("C", 2), 4: ("D", None)}


def test_limiters_and_dedup():
    limit = I.ResettingLimit(2, 60)
    assert [limit(t) for t in (0, 50, 100, 109, 110)] == [True, True, False, False, True]
    log = I.SlidingLog(2, 60)
    assert [log(t) for t in (0, 50, 59, 60, 109, 110)] == [True, True, False, True, False, True]
    kept = I.Anchored(900)
    assert [kept(t) for t in (0, 899, 900, 1700, 1800)] == [True, False, True, False, True]


def test_fold_over_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, s double")
    got = {r.i: r.ok for r in I.fold(df, "k", ["i"], F.col("s"), lambda: I.Anchored(10), "ok").collect()}
    state, want = {}, {}
    for k, i, s in rows:
        want[i] = state.setdefault(k, I.Anchored(10))(s)
    assert got == want


def test_streaming_dedup_agrees_with_batch(spark, tmp_path):
    from lineloom.streaming.intake import anchored_dedup, limited

    start = datetime(2024, 1, 1)
    rows = [(f"f{i % 3}", i, start + timedelta(seconds=97 * i)) for i in range(120)]
    df = spark.createDataFrame(rows, "fp string, id long, at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made, state, column in (("dups", anchored_dedup(stream, "fp", "at", "id"), lambda: I.Anchored(900), "duplicate"), ("limits", limited(stream, "fp", "at", "id", 2, 600), lambda: I.ResettingLimit(2, 600), "allowed")):
        query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        got = {r.id: r[column] for r in spark.table(name).collect()}
        batch = I.fold(df, "fp", ["at", "id"], F.unix_micros("at") / 1e6, state, "ok")
        want = {r.id: (not r.ok if column == "duplicate" else r.ok) for r in batch.collect()}
        assert got == want


def test_html(spark):
    page = '<html><script>x<y</script><p>A &amp; B &#960; &#x1F600; &zzz;</p><section itemprop="claims">c</section></html>'
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(H.html_to_body(F.col("h"))).first()[0] == "A & B π 😀 &zzz; c"
    assert df.select(H.html_sections(F.col("h"))).first()[0].strip() == '<section itemprop="claims">c</section>'


@pytest.mark.parametrize(
    ("outcomes", "state"),
    [(["fail"] * 3, "CONFIRMED_BUG"), (["fail"] * 2, "FLAKE"), (["pass"] * 5 + ["fail"] * 10, "CONFIRMED_BUG"), (["fail"] * 7 + ["pass"], "LIKELY_BUG"), (["fail"] * 4 + ["pass"], "INTERMITTENT"), (["pass"], "FLAKE")],
)
def test_flake_states(spark, outcomes, state):
    df = spark.createDataFrame([(outcomes,)], "o array<string>")
    now = F.lit("2024-01-01").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert df.select(R.flake_state(F.col("o"), none, F.lit(None).cast("array<timestamp>"), now).alias("s")).select("s.state").first()[0] == state


def test_layout_by_hand(spark):
    rows = [(f"w{i}{side}", x, 690 - 12 * i) for i in range(40) for side, x in (("a", 60.0), ("b", 340.0))]
    rows += [("1", 150.0, 720.0), ("2", 430.0, 720.0), ("5", 300.0, 642.0), ("10", 300.0, 582.0), ("5", 301.0, 500.0)]
    df = spark.createDataFrame(_items(rows), ITEMS)
    assert tuple(L.column_boundary(df).select("boundary").first()) == (321.0,)  # points 302 to 339 are empty
    assert [tuple(r) for r in L.gutter_grid(df.withColumn("boundary", F.lit(321.0))).select("first_y", "spacing").collect()] == [(690.0, 12.0)]
    got = L.build_position_map(df).orderBy("entry_idx").collect()
    assert [(r.column, r.line_number, r.text) for r in got] == [(c, i + 1, f"w{i}{side}") for c, side in ((1, "a"), (2, "b")) for i in range(40)]
    assert L.build_position_map(df.where("x < 300")).count() == 0  # one column
    bare = df.where("y < 702 AND (x < 300 OR x > 310)")  # no printed numbers, no marks: numbered by gaps
    assert [(r.column, r.line_number) for r in L.build_position_map(bare).orderBy("entry_idx").collect()] == [(c, i + 1) for c in (1, 2) for i in range(40)]
    assert L.build_position_map(df.limit(0)).count() == 0


def test_parsed_answers(spark):
    raws = ['{"severity": "high", "category": "x"}', '{"severity": "dire", "category": "x"}', "no json", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i long, raw string")
    got = [tuple(r) for r in df.select("i", R.parse_single(F.col("raw")).alias("v")).orderBy("i").select("v.*").collect()]
    assert got == [("x", "high"), ("x", "medium"), ("HARNESS_ERROR", "low"), ("HARNESS_ERROR", "low")]
    answers = spark.createDataFrame([('[{"i": 0, "severity": "low"}, {"i": 9, "severity": "low"}]',), ("no json",), (None,)], "raw string")
    assert [(r.i, r.s) for r in R.parse_cluster(df.select("i"), answers, "i", "raw", "s").orderBy("i").collect()] == [(0, "low")] + [(i, "HARNESS_ERROR") for i in (1, 2, 3)]


def test_places_and_access(spark):
    df = spark.createDataFrame([(2,), (3,), (None,)], "n int")
    assert [r[0] for r in df.select(R.promote_move(F.col("n"))).collect()] == ["quarantine", "golden", "quarantine"]
    assert [r[0] for r in df.select(R.route(F.col("n").cast("string"), {"2": "a"}, F.lit("z"))).collect()] == ["a", "z", "z"]
    calls = [(True, False, False, False, True), (False, True, True, False, True), (False, True, False, True, True), (False, False, False, True, True), (False, False, False, False, False), (False, False, True, False, True)]
    rows = spark.createDataFrame(calls, "p boolean, r boolean, o boolean, t boolean, k boolean")
    assert [x[0] for x in rows.select(R.access_status(*map(F.col, "protk"))).collect()] == [204, 200, 401, 200, 404, 401]


def test_listed_items(spark):
    from lineloom.sources import files as S

    rows = [(1, 5, "B1", "x"), (1, 4, "A", "the grant"), (1, 7, "B1", "y"), (2, 3, "A", "the grant"), (2, 2, None, "the grant"), (3, 1, "A", None)]
    df = spark.createDataFrame(rows, "k long, i long, code string, d string")
    assert {r.k: r.i for r in S.pick_listed(df, "k", "i", F.col("code") == "B1", F.col("d").contains("grant")).collect()} == {1: 5, 2: 2}


def test_boundaries_of_uneven_pages_against_a_scan(spark):
    """One column, few items, gaps off the middle or at the range's end, none at all."""
    r = random.Random(4)
    pages = {}
    for p in range(60):
        gap = r.choice([(0, 0), (290, 312), (200, 240), (440, 470), (150, 175), (300, 306)])
        xs = [x + 0.5 for x in r.sample(range(40, 570), r.choice([20, 60, 300, 500])) if not gap[0] <= x < gap[1]]
        pages[p] = [x for x in xs if x < 306] if p % 7 == 0 else xs
    rows = [(1, p, i, "t", x, 500.0, 5.0, 10.0, 612.0, 792.0) for p, xs in pages.items() for i, x in enumerate(xs)]

    def scan(xs):
        left = sum(x < 306 for x in xs)
        few, many = sorted((left, len(xs) - left))
        if len(xs) < 30 or few <= 0.3 * many:
            return 612.0, False
        full, runs, at = {int(x) for x in xs}, [], 153
        while at < 459:
            stop = at
            while stop < 459 and stop not in full:
                stop += 1
            if stop - at >= L.GAP:
                runs.append((stop == 459, abs((at + stop) / 2 - 306), at, (at + stop) / 2))
            at = stop + 1
        return min(runs)[3] if runs else 306.0, True

    got = {x.page: (x.boundary, x.two_column) for x in V.boundary(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {p: scan(xs) for p, xs in pages.items() if xs}
    assert len({b for b, _ in got.values()}) > 5


def test_printed_and_missing_column_numbers(spark):
    def mark(doc, page, text, x, y=700.0):
        return (doc, page, 0, text, float(x), y, 8.0, 10.0, 612.0, 792.0)

    rows = [mark(1, 0, "5", 150), mark(1, 0, "3", 100), mark(1, 0, "4", 400), mark(1, 0, "6.", 420), mark(1, 1, "7", 150), mark(1, 2, "9", 150), mark(1, 2, "10", 400, 600.0), mark(1, 3, "x1", 150), mark(1, 3, "2", 400)]
    assert [(x.page, x.left, x.right) for x in V.printed_columns(spark.createDataFrame(rows, ITEMS)).collect()] == [(0, 3, 4)]
    pages = [(1, 0, True, None), (1, 1, True, None), (1, 2, True, 5), (1, 3, True, None), (2, 0, False, None), (2, 1, True, None), (2, 2, True, 3), (3, 0, True, None), (3, 1, True, 4), (4, 0, True, None)]
    got = {(x.doc_id, x.page): x.left for x in V.backfill_columns(spark.createDataFrame(pages, "doc_id long, page int, two_column boolean, left int")).collect()}
    assert got == {(1, 0): 1, (1, 1): 3, (1, 2): 5, (1, 3): None, (2, 0): None, (2, 1): 1, (2, 2): 3, (3, 0): None, (3, 1): 4, (4, 0): None}
