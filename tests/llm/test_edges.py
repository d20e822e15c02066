"""Ranks, groups and folders against brute force, and rows that the operators' docstrings speak of."""

import random

import numpy as np
import pytest

from lineloom.llm import language_id, license_scan, packing
from tests.llm.test_llm import EDGE, docs, prose


def test_language_by_definition(spark):
    """The out-of-place distance, gram by gram."""
    r = random.Random(1)
    vocabulary = {"aa": ["kali", "mano", "tupo"], "bb": ["schritt", "zwerg", "kraft"]}
    texts = [(lang, prose(r, 30, words)) for lang, words in vocabulary.items() for _ in range(5)]
    rows = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(99, "zzz", None)], "doc_id long, text string, lang string")
    profiles = language_id.learn(rows)

    def place(counts, most):
        kept = sorted(counts, key=lambda g: (-counts[g], g))[:most]
        return {g: np.mean([k for k, x in enumerate(kept) if counts[x] == counts[g]]) for g in kept}

    def counted(texts):
        out = {}
        for t in texts:
            for k, n in zip(*map(np.ndarray.tolist, language_id.grams(t)), strict=True):
                out[k] = out.get(k, 0) + n
        return out

    theirs = {lang: place(counted([t for own, t in texts if own == lang]), language_id.PROFILE_GRAMS) for lang in vocabulary}
    for text in [prose(r, 40, sum(vocabulary.values(), [])) for _ in range(20)] + ["kali", "x" * 3, "ab " * 2000]:
        mine, most = place(counted([text]), language_id.DOC_GRAMS), language_id.PROFILE_GRAMS
        away = {lang: np.mean([min(abs(p[g] - k), most) if g in p else most for g, k in mine.items()]) for lang, p in theirs.items()}
        best = min(sorted(away), key=lambda lang: round(away[lang], 9))
        lang, score = profiles.predict(text)
        assert abs(score - (1 - away[best] / most)) < 1e-9 and abs(away[lang] - away[best]) < 1e-9


def test_ranks_of_kept_grams_stay_below_their_number():
    keys, ranks = language_id.ranked(np.arange(1000), np.array([5] * 10 + [1] * 990), 400)
    assert keys.tolist() == list(range(400)) and ranks[:10].tolist() == [4.5] * 10 and ranks[10:].tolist() == [204.5] * 390


def test_language_columns_and_empty_tables(spark):
    frame = docs(spark, EDGE).selectExpr("doc_id", "text", "'old' AS Lang_Pred", "'s' AS score")
    profiles = language_id.learn(docs(spark, ["hello there"]))
    got = language_id.identify(frame, profiles)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.where("lang_pred = 'old'").count() == 0
    assert language_id.identify(frame.limit(0), profiles).count() == 0 and language_id.learn(docs(spark, ["x"]).limit(0)).langs == []


def test_rows_alike_are_packed_in_several_groups(spark):
    frame = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same text' AS text", "1 AS length")
    rows = packing.pack_documents(frame, packing.public_bpe, group_docs=1000)
    sizes = {r["g"]: r["n"] for r in rows.selectExpr("sequence_id >> 32 AS g", "length").groupBy("g").agg({"length": "sum"}).toDF("g", "n").collect()}
    assert len(sizes) == 20 and max(sizes.values()) < 2 * min(sizes.values()) and rows.where("doc_id IS NOT NULL").count() == 0


def test_packing_against_plain_first_fit_decreasing_and_a_padding_bound():
    r = random.Random(2)
    for _ in range(30):
        lengths = [r.choice([r.randint(1, 40), r.randint(1, 400)]) for _ in range(r.randint(1, 200))]
        room = []
        for n in sorted((x % 64 for x in lengths if x % 64), reverse=True):
            at = next((i for i, left in enumerate(room) if left >= n), None)
            if at is None:
                room.append(64)
                at = -1
            room[at] -= n
        sequences = packing.pack(lengths, 64)
        plain = len(room) + sum(x // 64 for x in lengths)
        # Sequences below the capacity come from the last bin alone, one a power of two.
        fills = [sum(p[2] for p in s) for s in sequences]
        assert sum(f == 64 for f in fills) <= plain and sum(fills) == sum(lengths) and sorted(f for f in fills if f < 64) == [1 << b for b in range(6) if sum(lengths) >> b & 1]


@pytest.mark.parametrize("most", [50_000, 0])
def test_inheritance_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(license_scan, "BROADCAST_DIRS", most)
    r = random.Random(3)
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f/g"]
    notes = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 2."]
    rows = [("/".join(filter(None, [r.choice(folders), name])), r.choice([*notes, "code", None, ""])) for name in [f"f{i}.py" for i in range(40)] + ["LICENSE", "COPYING", "LICENSE.md"] * 2]
    rows += [rows[0], rows[0], (None, notes[0]), (None, None)]
    frame = spark.createDataFrame([(p, t, k) for k, (p, t) in enumerate(rows)], "path string, text string, License int")
    got = license_scan.scan_licenses(frame.withColumnRenamed("License", "n"))
    scanner = license_scan.Scanner()
    said = {}
    for p, t in rows:
        name, score, whole = scanner.scan(t)
        folder, _, file = (p or "").rpartition("/")
        if p is not None and name and (whole or file.split(".")[0] in ("LICENSE", "COPYING")):
            said[folder] = min(said.get(folder, (0, "")), (-score, name))
    for x in got.collect():
        p, t = rows[x.n]
        own = scanner.scan(t)[0]
        want = (own, "own", None) if own else (None, None, None)
        folder = (p or "").rpartition("/")[0]
        while not own and p is not None:
            if folder in said:
                want = (said[folder][1], "inherited", folder)
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        assert (x.license, x.via, x.license_dir) == want, (p, t)
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0 and license_scan.scan_licenses(frame).columns == ["path", "license", "score", "via", "license_dir"]


def test_long_files_speak_as_a_whole():
    notice = license_scan.TEMPLATES["GPL-3.0"][1]
    assert license_scan.Scanner().scan("\n".join([notice] * 40))[0::2] == ("GPL-3.0", True)


def test_first_stage_carries_the_predicted_language(spark):
    import corpus_pipeline

    texts = [("en", "the cat and the dog"), ("fr", "le chat et le chien")] * 12 + [(None, "the dog and the cat"), (None, "le chien et le chat"), ("en", None), ("en", "1 2 3")]
    rows = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.identify_language(spark, rows, "")
    assert got.columns == rows.columns
    langs = {r.doc_id: r.lang for r in got.collect()}
    assert sorted(langs) == list(range(26)) and langs[24] == "en" and langs[25] == "fr"
