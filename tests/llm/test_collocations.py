"""Collocations against counting by definition, and rows that the docstrings speak of."""

import random
import re
from collections import Counter

from lineloom.llm import collocations


def by_definition(rows, least, longest, top):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang, own = lang or "und", counts.setdefault(lang or "und", Counter())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            own.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p, -a, left, right, sizes[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_random_texts_in_many_segments(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT_BYTES", 700)
    r = random.Random(4)
    words = ["an", "An", "Ätna", "ätna", "new", "york", "city", "x\x1cy", "\x85", "ñ", "of", "the", "und"]
    gaps = [" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x1c"]
    rows = [(r.choice(["en", "de", None, "und", "en"]), "".join(w + g for w, g in zip(r.choices(words, [1] * 4 + [5, 5, 5] + [1] * 6, k=40), r.choices(gaps, [9] + [1] * 8, k=40), strict=True))) for _ in range(300)]
    rows += [("en", None), ("fr", ""), ("fr", " .. "), ("en", "new york city new york city. " * 200), ("en", "no end " * 500)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least, top in ((5, 1000), (20, 7)):
        got = collocations.mine(frame, least=least, top=top)
        assert sorted(tuple(x) for x in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == by_definition(rows, least, 5, top)


def test_products_past_64_bits_are_exact(spark):
    big = 3 * 10**12
    found = spark.createDataFrame([("en", "a b c", 3, big, [big + 7, big + 1], [big + 5, big + 9])], "lang string, phrase string, words int, a long, lefts array<long>, rights array<long>")
    totals = spark.createDataFrame([("en", 5 * 10**12 + 3)], "lang string, n long")
    row = collocations.best(found, totals).first()
    scores = [1000 * big * (5 * 10**12 + 3) // (x * y) for x, y in ((big + 7, big + 5), (big + 1, big + 9))]
    assert (row.score, row.l) == (min(scores), (big + 7, big + 1)[scores.index(min(scores))]) and 1000 * big * row.n > 2**64


def test_equal_scores_take_the_first_cut(spark):
    found = spark.createDataFrame([("en", "a b c", 3, 100, [200, 100], [100, 200])], "lang string, phrase string, words int, a long, lefts array<long>, rights array<long>")
    row = collocations.best(found, spark.createDataFrame([("en", 1000)], "lang string, n long")).first()
    assert (row.l, row.r, row.score) == (200, 100, 5000)


def test_nothing_clashing_columns_and_a_text_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT_BYTES", 50)
    rows = [(None, "good day sir! " * 300, 1, "x", "y")]
    frame = spark.createDataFrame(rows, "lang string, text string, seg int, phrase string, n string")
    assert [(r.lang, r.phrase, r.a, r.n, r.score) for r in collocations.mine(frame).collect()] == [("und", "good day sir", 300, 900, 3000)]
    assert collocations.mine(frame.limit(0)).count() == 0 and collocations.mine(frame.withColumn("text", frame.text.substr(1, 20))).count() == 0


def test_places_survive_packing():
    import numpy as np

    for places in ([], [5], [0, 3, 2**30, 1, 7]):
        assert collocations._unpacked(collocations._packed(np.array(places, np.int32))).tolist() == places


def test_only_phrases_that_can_be_frequent_move_by_name(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r, least, ranges = random.Random(8), 6, 4
    batches, sums = [], Counter()
    for seg in range(5):
        text = " ".join(r.choice(["new york city", "of the", "a", "b", "c"] + [f"w{i}" for i in range(60)]) for _ in range(150))
        words, lens, places = collocations.postings([text.encode()])
        own = text.split()
        sums.update(f"{x} {y}" for x, y in zip(own, own[1:], strict=False))
        row = {"seg": seg, "lang": "en", "phrases": words, "lens": lens.astype(np.int32), "places": collocations._packed(places)}
        batches.append(pa.RecordBatch.from_pylist([row], schema=collocations._POSTINGS))
    frequent = {p for p, n in sums.items() if n >= least}
    assert 2 < len(frequent) < len(sums) // 5
    for bits in (2, 3, 8, 32):
        monkeypatch.setattr(collocations, "HASH_BITS", bits)
        sketches = pa.Table.from_batches(list(collocations._sketched(collocations._longer_seen, ranges, least, iter(batches))))
        marks = []
        for span in range(ranges):
            part = sketches.filter(pa.compute.equal(sketches.column("span"), span))
            marks += collocations._marked(least, part).to_pylist() if part.num_rows else []
        held = [b.append_column("marks", pa.array([[m for m in marks if m["seg"] == seg]])) for seg, b in enumerate(batches) if any(m["seg"] == seg for m in marks)]
        got = Counter()
        for b in collocations._counted(collocations._longer_seen, ranges, iter(held)):
            for row in b.to_pylist():
                got[row["phrase"]] += row["n"]
        assert all(got[p] == sums[p] for p in got) and frequent <= set(got)
        assert bits < 32 or set(got) == frequent


def test_a_segment_moves_a_row_for_each_range_and_not_for_each_phrase(monkeypatch):
    import numpy as np
    import pyarrow as pa

    r, least, ranges = random.Random(9), 12, 4
    texts = [" ".join(r.choice(["new york city", "of the", "ätna", "b"] * 4 + [f"w{i}" for i in range(20)]) for _ in range(600)) for _ in range(5)]
    for at_once, bits in ((1 << 18, 32), (1 << 18, 5), (7, 32)):
        monkeypatch.setattr(collocations, "AT_ONCE", at_once)
        held, names = [], None
        for seg, text in enumerate(texts):
            words, lens, places = collocations.postings([text.encode()])
            row = {"seg": seg, "lang": "en", "phrases": words, "lens": lens.astype(np.int32), "places": collocations._packed(places)}
            held.append(pa.RecordBatch.from_pylist([row], schema=collocations._POSTINGS))
        for k in (1, 2, 3):
            seen = collocations._words_seen if k == 1 else collocations._longer_seen
            sums = Counter(" ".join(own[i : i + k]) for own in (t.split() for t in texts) for i in range(len(own) - k + 1))
            sketches = pa.Table.from_batches(list(collocations._sketched(seen, ranges, least, iter(held), bits)))
            marks = [m for span in range(ranges) for m in collocations._marked(least, sketches.filter(pa.compute.equal(sketches.column("span"), span))).to_pylist()]
            marked = [b.append_column("marks", pa.array([[m for m in marks if m["seg"] == b.column("seg")[0].as_py()]])) for b in held]
            dealt = pa.Table.from_batches(list(collocations._dealt(seen, ranges, bits, iter(marked))))
            assert at_once < 100 or dealt.num_rows <= ranges * len(texts) < sum(n >= least for n in sums.values()) * len(texts)
            found = [row for span in range(ranges) if (part := dealt.filter(pa.compute.equal(dealt.column("span"), span))).num_rows for row in collocations._summed(k == 1, ranges, least, part).to_pylist()]
            own = [it for row in found if row["seg"] is None for it in row["own"]]
            assert len({it["number"] for it in own}) == len(own)
            last = {number: name.split()[-1] for number, name in (names or {}).items()}
            names = {it["number"]: it["word"] if k == 1 else f"{names[it['pair'] >> 32]} {last[it['pair'] & 0xFFFFFFFF]}" for it in own}
            assert {names[it["number"]]: it["a"] for it in own} == {p: n for p, n in sums.items() if n >= least}
            back = [b.append_column("back", pa.array([[{"at": f["at"], "numbers": f["numbers"]} for f in found if f["seg"] == b.column("seg")[0].as_py()]])) for b in held]
            held = list(collocations._kept(k == 1, iter(back)))
            for b, text in zip(held, texts, strict=True):
                words, places = text.split(), collocations._unpacked(b.column("places")[0].as_py())
                listed = np.repeat(b.column("phrases")[0].values.to_numpy(), b.column("lens")[0].values.to_numpy())
                assert sorted(places.tolist()) == [i for i in range(len(words) - k + 1) if sums[" ".join(words[i : i + k])] >= least]
                assert all(names[number] == " ".join(words[i : i + k]) for number, i in zip(listed.tolist(), places.tolist(), strict=True))
