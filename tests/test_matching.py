"""Passage matching on hand-made lines."""

import random

import pytest
from pyspark.sql import functions as F

from lineloom.operators import matching as M


def page(*lines, columns=None, wrapped=None):
    return M.join_lines(lines, columns or [1] * len(lines), wrapped or [False] * len(lines))


def test_lines_join_and_words_broken_at_a_hyphen_do():
    assert page("the first", "part of text").text == "the first part of text"
    assert page("a trans-", "action there").text == "a transaction there"
    assert page("a trans-", "action", columns=[1, 2]).text == "a trans- action"
    assert page("soft­", "ware").text == "software"


def test_confusions_change_both_sides_and_cost_a_little():
    found = M.locate("a modern claim", page("this is a modern claim of it"))
    assert (found.first, found.last, found.tier) == (0, 0, 1)
    assert found.confidence == pytest.approx(0.98)


def test_without_context_the_last_place_wins_and_with_it_the_first_of_equals():
    p = page("red cat sat", "blue cat sat", "grey cat sat")
    assert M.locate("cat sat", p).first == 2
    assert M.locate("cat sat", p, before="the blue").first == 1
    assert M.locate("cat sat", p, before="unknown").first == 0


@pytest.mark.parametrize(
    ("passage", "confidence"),
    [("polyp eptide  sequences", 0.99), ("PolyPeptide sequences", 0.98), (".polypeptide sequences;", 0.98), (",POLYPEPTIDE sequences!", 0.97), ("polypep(tide) sequ'ences", 0.96)],
)
def test_solid_forms(passage, confidence):
    found = M.locate(passage, page("the polypeptide sequences are known", "to all"))
    assert (found.first, found.confidence) == (0, pytest.approx(confidence))


def test_bookends_bridge_inserted_text():
    head, tail = "abcde " * 10, "vwxyz " * 10
    found = M.locate(head + "middle " + tail, page(head, "a running head 123", "middle", tail))
    assert (found.first, found.last, found.tier, found.confidence) == (0, 3, 3, 0.92)


def test_fuzzy_agrees_with_the_definition():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(3)
    for _ in range(25):
        text = "".join(r.choice("abcd ") for _ in range(r.randint(1, 60)))
        needle = "".join(r.choice("abcd ") for _ in range(r.randint(1, 14)))
        n, best = len(needle), (0.0, -1, -1)
        for w in range(max(1, n - int(n * 0.2)), n + int(n * 0.2) + 1):
            for s in range(len(text) - w + 1):
                like = 1 - distance(needle, text[s : s + w]) / max(n, w)
                if like > best[0]:
                    best = (like, s, s + w)
        found = M.fuzzy(needle, text)
        if best[0] >= 0.8:
            assert found == (best[1], best[2], pytest.approx(best[0]))
        else:
            assert found is None


@pytest.mark.parametrize("few", [0, 1000])
def test_distances_of_all_heads(monkeypatch, few):
    monkeypatch.setattr(M, "FEW", few)
    r = random.Random(12)
    for n in (1, 2, 63, 64, 65, 100):
        needle, text = ("".join(r.choice("abcé") for _ in range(k)) for k in (n, 260))
        begins = M.np.array(sorted(r.sample(range(140), 5)))
        got = list(M._distances(M._codes(needle), M._codes(text), begins, 120))
        for k, b in enumerate(begins.tolist()):
            row = list(range(n + 1))
            for w, c in enumerate(text[b : b + 120], 1):
                last, row = row, [w]
                for i, x in enumerate(needle, 1):
                    row.append(min(last[i] + 1, row[-1] + 1, last[i - 1] + (x != c)))
                assert got[w - 1][k] == row[n]


def test_a_stray_line_number_is_passed_over_at_a_flat_confidence():
    p = page("valve of the tank opens slowly under 25 the weight of the float.", "A spring then closes it against the seat of the inlet")
    passage = "valve of the tank opens slowly under the weight of the float. A spring then closes it against the seat of the inlet"
    found = M.locate(passage, p)
    assert (found.first, found.last, found.confidence, found.tier) == (0, 1, 0.85, 5)


def test_nothing_to_find():
    assert M.locate("x", page("x y z")) is None
    assert M.locate(None, page("x y z")) is None
    assert M.locate("abc", page()) is None
    assert M.locate("entirely different words that never occur in it at all", page("short")) is None


def test_cite_over_frames(spark):
    lines = spark.createDataFrame([(1, i, 1 + i // 2, 1 + i % 2, t, False) for i, t in enumerate(["alpha beta gamma", "delta epsilon zeta", "eta theta iota"])], "doc_id long, entry_idx int, column int, line_number int, text string, wrap_hyphen boolean")
    asked = spark.createDataFrame([(1, 10, "beta gamma delta"), (1, 11, "zeta eta"), (1, 12, "nowhere to be found in these lines"), (2, 13, "alpha")], "doc_id long, passage_id long, text string")
    got = {r.passage_id: r.citation for r in M.cite(asked, lines).collect()}
    assert got == {10: "1:1-2", 11: "1:2-2:1", 12: None, 13: None}


def test_passages_of_a_hot_document_are_dealt(spark, monkeypatch):
    lines = spark.createDataFrame([(d, i, 1, 1 + i, f"word{i} of line{i} number{i}", False) for d in (1, 2) for i in range(30)], "doc_id long, entry_idx int, column int, line_number int, text string, wrap_hyphen boolean")
    asked = spark.createDataFrame([(1, i, f"line{i} number{i}") for i in range(30)] + [(2, 40, "line7"), (None, 41, "line7"), (3, 42, None)], "doc_id long, passage_id long, text string")
    want = {**{i: f"1:{i + 1}" for i in range(30)}, 40: "1:8", 41: None, 42: None}
    for share in (2, 7, 5_000):
        monkeypatch.setattr(M, "SHARE", share)
        rows = M.cite(asked, lines).collect()
        assert len(rows) == len(want)
        assert {r.passage_id: r.citation for r in rows} == want


def test_find_exact_in_blocks(spark):
    docs = spark.createDataFrame([(1, "one two\n\nthree four five"), (2, None), (3, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "two three"), (2, "four"), (3, None), (4, "absent")], "passage_id long, text string")
    for block in (1, 10):
        assert sorted((r.passage_id, r.doc_id, r.citation) for r in M.find_exact(docs, asked, block=block).collect()) == [(1, 1, "1:1-3"), (2, 1, "1:3")]


def test_queries_ask_documents_of_every_length(spark, tmp_path):
    from lineloom.plans import matching as plans

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    texts = ["\n".join(" ".join(word() for _ in range(12)) for _ in range(n)) for n in (5, 6, 90, 300)]
    texts[0] = texts[0][:320]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(texts[2]) > 4000 and len(texts[3]) > 1 << 14
    for name in ("match_and_cite", "cite_batch", "match_ws_stripped", "match_bookend", "match_gutter", "match_fuzzy", "best_by_context"):
        got = {x.doc_id: x.citation for x in plans.QUERIES[name](spark, str(tmp_path)).collect()}
        assert sorted(got) == [0, 1, 2, 3], name
        assert all(got.values()), name


def test_fuzzy_seeds_leave_no_window_out():
    r = random.Random(6)
    text = "".join(r.choice("abcdefghij ") for _ in range(20_000))
    for edits in (0, 2, 5, 9, 13):
        at = r.randrange(len(text) - 70)
        needle = list(text[at : at + 66])
        for i in r.sample(range(66), edits):
            needle[i] = "#"
        found = M.fuzzy("".join(needle), text)
        assert found and found[2] >= 1 - edits / 66 - 1e-9 and abs(found[0] - at) <= 13


def test_distances_by_diagonals():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(13)
    for n, most in ((1, 0), (5, 1), (20, 3), (61, 7)):
        text = "".join(r.choice("abé") for _ in range(90))
        needle = list(text[7 : 7 + n])
        needle[n // 2] = "#"
        begins = M.np.array([0, 4, 5, 6, 7, 9, 40, 89])
        got = M._within(M._codes("".join(needle)), M._codes(text + "\0" * (n + most)), begins, most)
        assert got.shape == (2 * most + 1, len(begins))
        for i, b in enumerate(begins.tolist()):
            for k in range(-most, most + 1):
                assert got[most + k, i] == min(most + 1, distance(needle, (text + "\0" * (n + most))[b : b + n + k]))


def test_small_inputs_keep_all_tasks_busy(spark):
    lines = spark.range(400).selectExpr("id AS doc_id", "0 AS entry_idx", "1 AS column", "1 AS line_number", "concat('line number ', id, ' of many') AS text", "false AS wrap_hyphen")
    asked = spark.range(400).selectExpr("id AS doc_id", "id AS passage_id", "concat('number ', id) AS text")
    rows = M.cite(asked, lines).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 400 and {x.citation for x in rows} == {"1:1"}
    assert len({x.task for x in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
