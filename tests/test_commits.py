"""Files and tables that change whole or not at all; lines by their running mean; places in a whole order."""

import pytest
from pyspark.sql import functions as F

from lineloom.operators import layout as L
from lineloom.operators import relational as R
from lineloom.operators import rules
from lineloom.operators import verify as V
from lineloom.sources import commits


def failing(df):
    """df with a row whose computation fails in the middle of a write."""
    return df.withColumn("name", F.when(F.col("name") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("name")))


def test_a_failed_job_leaves_the_file_as_it_was(spark, tmp_path):
    path = str(tmp_path / "state.json")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i long, name string")
    commits.write_json(rows, path)
    before = open(path).read()
    with pytest.raises(Exception, match="lost"):
        commits.write_json(failing(spark.createDataFrame([(3, "c")], "i long, name string")), path)
    assert open(path).read() == before and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["state.json"]
    commits.write_json(rows.limit(1), path)
    assert [tuple(x) for x in spark.read.schema("i long, name string").json(path).collect()] == [(1, "a")]
    commits.write_json(rows.limit(0), path)
    assert spark.read.schema("i long, name string").json(path).count() == 0


def corpus(spark, root):
    quarantine = spark.createDataFrame([(1, "a", 3), (2, "b", 3), (3, "c", 1), (4, "d", 3)], "id long, name string, stable_runs int")
    golden = spark.createDataFrame([(4, "old"), (9, "z")], "id long, name string")
    commits.commit(spark, root, {"golden": golden, "quarantine": quarantine})
    return lambda name: sorted(tuple(x) for x in commits.current(spark, root, name).collect())


def test_cases_move_between_tables(spark, tmp_path):
    root = str(tmp_path / "corpus")
    rows = corpus(spark, root)
    outcomes = rules.promote_cases(spark, root, spark.createDataFrame([(1,), (1,), (4,), (7,)], "id long"), "id")
    assert sorted(tuple(x) for x in outcomes.collect()) == [(1, "promoted"), (4, "already_golden"), (7, "not_in_quarantine")]
    assert rows("golden") == [(1, "a"), (4, "old"), (9, "z")] and rows("quarantine") == [(2, "b", 3), (3, "c", 1), (4, "d", 3)]


def test_a_failed_second_write_leaves_both_tables(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "corpus")
    rows = corpus(spark, root)
    before = rows("golden"), rows("quarantine")
    moved = rules.promoted
    monkeypatch.setattr(rules, "promoted", lambda *a: (lambda new, left, out: (new, failing(left), out))(*moved(*a)))
    with pytest.raises(Exception, match="lost"):
        rules.promote_cases(spark, root, spark.createDataFrame([(1,)], "id long"), "id")
    assert (rows("golden"), rows("quarantine")) == before and len(list((tmp_path / "corpus" / "versions").iterdir())) == 1
    with pytest.raises(Exception, match="lost"):
        commits.commit(spark, root, {"golden": failing(commits.current(spark, root, "quarantine"))})
    assert (rows("golden"), rows("quarantine")) == before
    assert commits.manifest(spark, str(tmp_path / "none")) == {}


def test_three_ways_to_cluster_lines_differ(spark):
    ys = [700.0, 698.0, 696.0, 694.0, 692.0, 650.0]
    rows = [(1, 0, i, f"w{i}", 60.0 + i, y, 5.0, 10.0, 612.0, 792.0, 0) for i, y in enumerate(ys)]
    items = spark.createDataFrame(rows, "doc_id long, page int, seq int, text string, x double, y double, width double, height double, page_width double, page_height double, side int")
    anchored = [x.n for x in L.cluster_lines(items).select("line_idx", F.size("entries").alias("n")).orderBy("line_idx").collect()]
    mean = [(x.y, x.text) for x in V.clusters(items).orderBy("line_number").collect()]
    assert anchored == [2, 2, 1, 1]
    assert mean == [(698.0, "w0 w1 w2"), (693.0, "w3 w4"), (650.0, "w5")]
    # single linkage, a third way, would make one line of the first five
    assert all(a - b <= 3 for a, b in zip(ys[:4], ys[1:5], strict=True))


def test_pixels_of_a_line(spark):
    items = spark.createDataFrame([(1, 0, 0, "a", 60.0, 700.0, 792.0), (1, 0, 1, "b", 400.0, 698.0, 792.0), (1, 0, 2, " ", 60.0, 300.0, 792.0), (1, 0, 3, "c", 60.0, 500.0, 792.0)], "doc_id long, page int, seq int, text string, x double, y double, page_height double")
    cited = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, 99), (1, 0, 0), (1, 5, 1)], "doc_id long, page int, line int").withColumn("page_height", F.lit(792.0))
    got = {(x.page, x.line): x.pixel_y for x in V.line_pixel_y(cited, items).collect()}
    high = 792 * 150 / 72
    assert got[0, 1] == got[0, 0] == pytest.approx(high - 699 * 150 / 72) and got[0, 2] == got[0, 99] == pytest.approx(high - 500 * 150 / 72)
    assert got[5, 1] == pytest.approx(high / 2)


def test_places_and_ties(spark):
    frame = spark.range(500).withColumn("v", F.col("id") % 7).repartition(9)
    got = {x.id: x.place for x in R.placed(frame, [F.desc("v"), F.asc("id")]).collect()}
    assert got == {i: k for k, i in enumerate(sorted(range(500), key=lambda i: (-(i % 7), i)), 1)}
    assert R.placed(frame.limit(0), [F.asc("id")]).count() == 0
    names = spark.createDataFrame([(n,) for n in ("zoo", "Éa", "eb", "B", "b", "a", "Z")], "n string")
    assert [x.n for x in names.transform(lambda d: R.top_k(d.select(F.col("n").alias("name")), "name", 9)).select(F.col("name").alias("n")).collect()] == ["a", "b", "B", "Éa", "eb", "Z", "zoo"]
