"""Surrogates: coreference, distinctness, format and script, against brute force over small tables."""

import random
import re

from lineloom.llm import pii
from tests.llm.test_llm import EDGE, docs


def replaced(spark, texts, key="k"):
    return [r.text for r in pii.pseudonymise(docs(spark, texts), key).orderBy("doc_id").collect()]


def test_surnames_stay_one_and_distinct(spark):
    syllables = ["stan", "ber", "ki", "lo", "mund", "ra", "fi", "gol", "tep", "xi", "ny", "dor", "vas", "que", "hal", "jum"]
    surnames = [(a + b + c).capitalize() for a in syllables for b in syllables for c in syllables][:3000]
    got = replaced(spark, [f"Mr {s} left. Mr John {s} came." for s in surnames])
    found = [re.fullmatch(r"Mr (\S+) left\. Mr (\S+) (\S+) came\.", t).groups() for t in got]
    assert all(a == b for a, _, b in found) and len({a for a, _, _ in found}) == 3000
    assert not {a for a, _, _ in found} & set(surnames)


def test_persons_of_one_surname_are_distinct(spark):
    r = random.Random(1)
    given = sorted({"".join(r.choice("abdeklmnor") for _ in range(5)).capitalize() for _ in range(150)})
    got = replaced(spark, [f"Mr {g} Smith and Mrs {g} Smith" for g in given])
    names = [re.fullmatch(r"Mr (\S+) (\S+) and Mrs (\S+) (\S+)", t).groups() for t in got]
    assert len({n[1] for n in names} | {n[3] for n in names}) == 1
    assert len({n[0] for n in names} | {n[2] for n in names}) == 2 * len(given)


FORMS = [
    ("Mr Παπαδόπουλος spoke", r"Mr \p{Greek}+ spoke"), ("Κυρία Ελένη Παπαδοπούλου", r"Κυρία \p{Greek}+ \p{Greek}+"), ("Господин Иван Петров", r"Господин \p{Cyrillic}+ \p{Cyrillic}+"),
    ("Mr Smith-Jones left", r"Mr \p{Lu}\p{Ll}+-\p{Lu}\p{Ll}+ left"), ("MR JOHN SMITH!", r"MR \p{Lu}{2,} \p{Lu}{2,}!"), ("so mr john smith, then", r"so mr \p{Ll}+ \p{Ll}+, then"),
    ("Dr. John Smith and Prof. Anna Meyer", r"Dr\. \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+ and Prof\. \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+"), ("by Anna Meyer.", r"by \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+\."),
    ("Herr Dr. O'Brien", r"Herr Dr\. \p{Lu}\p{Ll}+"), ("Frau Müller, Frau MÜLLER", r"Frau (\p{Lu}\p{Ll}+), Frau \p{Lu}{2,}"),
]


def test_names_keep_form_and_script(spark):
    import regex

    for (text, form), new in zip(FORMS, replaced(spark, [t for t, _ in FORMS]), strict=True):
        assert regex.fullmatch(form, new), new
        words = [w for w in regex.findall(r"\p{L}+", text) if w not in regex.findall(r"\p{L}+", form)]
        assert not any(regex.search(rf"\b{w}\b", new) for w in words if w[0].isupper() and w.lower() not in ("mr", "dr"))


def test_mentions_of_a_person_agree_over_case_and_title(spark):
    (new,) = replaced(spark, ["Mr John Smith, MR JOHN SMITH, Dr. John Smith, John Smith, mr john smith. Mr Smith."])
    names = re.findall(r"(\w+) (\w+)[,.]", new.replace("Mr ", "").replace("MR ", "").replace("Dr. ", "").replace("mr ", ""))
    assert len({(a.lower(), b.lower()) for a, b in names}) == 1 and len(names) == 5 and new.lower().endswith(f"mr {names[0][1].lower()}.")


def test_numbers_without_a_check_digit_stay(spark):
    texts = ["id 4111111111111112 here", "card 4111 1111 1111 1111 here", "7086638319846193"]
    rows = pii.pseudonymise(docs(spark, texts), "k").orderBy("doc_id").collect()
    assert [r.n_entities for r in rows] == [0, 1, 0] and rows[0].text == texts[0] and rows[2].text == texts[2] and rows[1].text != texts[1]


def test_distinct_over_all_kinds(spark):
    """Brute force: in each kind the map from entities to surrogates is one to one and hits no entity."""
    r = random.Random(2)
    kinds = {
        "ip": [f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}" for _ in range(400)],
        "mail": [f"{r.choice('abc')}{r.choice('abc')}@{r.choice('xy')}.org" for _ in range(60)],
        "ssn": [f"{r.randint(100, 103)}-{r.randint(10, 12)}-{r.randint(1000, 1020)}" for _ in range(100)],
        "phone": [f"({r.randint(200, 203)}) 555-{r.randint(1000, 1020)}" for _ in range(100)],
    }
    pairs = [(k, v) for k, vs in kinds.items() for v in vs]
    got = [t.split(" ", 1)[1] for t in replaced(spark, [f"{k} {v}" for k, v in pairs])]
    for kind in kinds:
        made = {}
        for (k, v), new in zip(pairs, got, strict=True):
            if k == kind:
                assert made.setdefault(v, new) == new and re.sub(r"[a-z]", "a", re.sub(r"\d", "0", new)) == re.sub(r"[a-z]", "a", re.sub(r"\d", "0", v)) or kind == "mail", (v, new)
        assert len(set(made.values())) == len(made) and not set(made.values()) & set(made)


def test_keys(spark):
    texts = ["write to ann@example.org"]
    assert replaced(spark, texts, "a") == replaced(spark, texts, "a") != replaced(spark, texts, "b")
    first = [r.text for r in pii.pseudonymise(docs(spark, texts)).collect()]
    assert first == [r.text for r in pii.pseudonymise(docs(spark, texts)).collect()] and len(pii.key_of(spark)) == 64


def test_edges(spark):
    long = "x" * 100 + "@" + "y" * 100 + ".org " + "word " * 200_000
    frame = docs(spark, [*EDGE, long, long]).selectExpr("*", "'a' AS N_Entities")
    rows = pii.pseudonymise(frame, "k").orderBy("doc_id").collect()
    assert [r.text for r in rows[: len(EDGE)]] == EDGE and len(rows[-1].text) == len(long) and rows[-1].text == rows[-2].text != long
    got = pii.pseudonymise(frame.limit(0), "k")
    assert got.count() == 0 and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_entities"]
