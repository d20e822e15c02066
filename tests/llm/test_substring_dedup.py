"""Removal of repeated runs against all runs of all documents, on small tables."""

import random
from itertools import pairwise

import pytest

from lineloom.llm import substring_dedup
from tests.llm.test_llm import EDGE, prose


def brute_removed(rows):
    """rows: (id, text) -> removed sentence numbers of every row, by comparing every run of every row with all others."""
    shapes = []
    for i, text in rows:
        words = [(text or "")[a:b].lower().split() for a, b in substring_dedup.sentences(text)]
        own = []
        for a in range(len(words)):
            for b in range(a + substring_dedup.SPAN_SENTENCES, len(words) + 1):
                if sum(map(len, words[a:b])) >= substring_dedup.SPAN_WORDS:
                    own.append((" ".join(w for s in words[a:b] for w in s), a, b))
        shapes.append((i, own))
    first = {}
    for i, own in shapes:
        for run, *_ in own:
            if i is not None and (run not in first or first[run] is None or i < first[run]):
                first[run] = i
            first.setdefault(run, None)
    out = []
    for i, own in shapes:
        seen, gone = set(), set()
        for run, a, b in sorted(own, key=lambda x: x[1:]):
            if run in seen or i != first[run]:
                gone.update(range(a, b))
            seen.add(run)
        out.append(sorted(gone))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_every_repeated_run_is_covered(spark, seed):
    r = random.Random(seed)
    sentences = [prose(r, r.randint(1, 15)).capitalize() + r.choice(".!?") for _ in range(30)]
    texts = []
    for _ in range(40):
        at, n = r.randrange(len(sentences)), r.randint(0, 8)
        texts.append(r.choice([" ", "\n"]).join([*r.choices(sentences, k=r.randint(0, 3)), *sentences[at : at + n], prose(r, r.randint(0, 4))]))
    ids = [r.choice([None, *range(25)]) for _ in texts]
    rows = [*zip(ids, texts, strict=True), (ids[0], texts[0]), (99, None), (99, ""), (None, None)]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id int, text string, place int")
    got = {x.place: x for x in substring_dedup.remove_repeats(frame).collect()}
    assert [got[k].removed for k in range(len(rows))] == brute_removed(rows)
    assert any(x.removed for x in got.values())
    for k, (_, text) in enumerate(rows):
        kept = [(text or "")[a:b] for m, (a, b) in enumerate(substring_dedup.sentences(text)) if m not in got[k].removed]
        assert (got[k].text or "").split() == " ".join(kept).split() and got[k].n_sentences == len(substring_dedup.sentences(text))


def test_short_sentences_at_the_end_of_a_repeated_run_go_too(spark):
    shared = [" ".join(f"x{i}" for i in range(16)) + ".", " ".join(f"z{i}" for i in range(10)) + ".", "Y1 y2 y3."]
    texts = ["One of its own. " + " ".join(shared) + " Ends so.", "Another. " + " ".join(shared) + " Differs here."]
    frame = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {x.doc_id: x.text for x in substring_dedup.remove_repeats(frame).collect()}
    assert got == {"d0": texts[0], "d1": "Another. Differs here."}


def test_runs_hold_the_shortest_spans_both_ways():
    r = random.Random(5)
    text = " ".join(prose(r, r.randint(1, 14)) + "." for _ in range(50))
    sizes = [len(text[a:b].split()) for a, b in substring_dedup.sentences(text)]
    n, (_, _, first, last) = substring_dedup.runs(text)
    fits = {(a, b) for a in range(n) for b in range(a + 1, n) if sum(sizes[a : b + 1]) >= substring_dedup.SPAN_WORDS}
    want = {min((x for x in fits if x[0] == a), default=None) for a in range(n)} | {max((x for x in fits if x[1] == b), default=None) for b in range(n)}
    got = list(zip(first.tolist(), last.tolist(), strict=True))
    assert n == len(sizes) and set(got) == want - {None} and all(a < b for a, b in pairwise(got))


def test_edges(spark):
    frame = spark.createDataFrame([(i, t, "x", "y", 5) for i, t in enumerate(EDGE)], "doc_id long, text string, N_sentences string, removed string, first int")
    got = substring_dedup.remove_repeats(frame)
    assert got.columns == ["doc_id", "text", "first", "n_sentences", "removed"] and substring_dedup.remove_repeats(frame.limit(0)).count() == 0
    assert sorted((x.doc_id, x.text, x.first) for x in got.collect()) == [(i, t, 5) for i, t in enumerate(EDGE)]
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = spark.createDataFrame([(0, long), (1, "Start. " + long)], "doc_id long, text string")
    assert {x.doc_id: len(x.text.split()) for x in substring_dedup.remove_repeats(rows).collect()}[1] <= 17
