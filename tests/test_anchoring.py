"""Locating, growing and selecting passages against step-by-step searches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lineloom.operators import anchoring as A


def letters(text):
    return re.sub("[^a-zA-Z0-9]", "", text).lower()


def body_places(body):
    return [i for i, c in enumerate(body) if re.match("[a-zA-Z0-9]", c)]


def climbed(passage, body):
    """The ladder, rung by rung."""
    text, place = letters(body), body_places(body)

    def hit(name, own):
        at = text.find(own)
        return (name, place[at], place[at + len(own) - 1] + 1, own) if at >= 0 else None

    forms = [(name, letters(form)) for name, form in A.attempts(passage)]
    for name, own in forms:
        if len(own) >= 16 and (found := hit(f"alpha/{name}", own)):
            return found
    for name, own in forms:
        for side in ("tail", "head"):
            cut = 5
            while len(own) >= 30 and cut < len(own) * 0.6 and len(own) - cut >= 30:
                if found := hit(f"alpha-shrink-{side}-{cut}/{name}", own[: len(own) - cut] if side == "tail" else own[cut:]):
                    return found
                cut += 5
    return None


def test_locate_against_the_ladder():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeCHI1I") for _ in range(r.randint(1, 8)))
    kinds = set()
    for _ in range(600):
        body = " ".join(word() + r.choice(["", ",", ".", "-", "é"]) for _ in range(60))
        a = r.randrange(len(body) - 90)
        piece = body[a : a + r.choice([12, 20, 45, 90])]
        piece = r.choice(["", "What is claimed is : ", "I CLAIM:", "12. ", "we claim: 3. "]) + piece.replace("CH1", r.choice(["CHI", "CH1"]))
        piece = "".join(word() for _ in range(r.choice([0, 0, 1, 3]))) + " " * r.randint(0, 1) + piece + "".join(word() for _ in range(r.choice([0, 0, 2, 5])))
        found = A.locate(piece, body)
        assert found == climbed(piece, body)
        kinds.add(found and found[0].split("/")[0].rstrip("0123456789"))
    assert kinds == {None, "alpha", "alpha-shrink-tail-", "alpha-shrink-head-"}


def test_forms_of_a_passage():
    assert A.attempts("What is claimed is: 7. The CHI domain") == [
        ("raw", "What is claimed is: 7. The CHI domain"),
        ("strip-preamble", "7. The CHI domain"),
        ("strip-preamble+claim-num", "The CHI domain"),
        ("ocr:CHI->CH1", "7. The CH1 domain"),
        ("ocr:CHI->CH1+claim", "The CH1 domain"),
    ]
    assert A.attempts("short") == [] and A.locate(None, "body") is None and A.locate("a passage of words", "") is None


def stepped(own, body):
    """Growing step by step."""
    text, place = letters(body), body_places(body)
    a = text.find(own)
    if a < 0:
        return None

    def twice(x, y):
        return text.find(text[x:y], y) >= 0

    x, y, steps, grown = a, a + len(own), 0, False
    while twice(x, y) and steps < 30 and y < len(text):
        y, steps, grown = min(len(text), y + 6), steps + 1, True
    while twice(x, y) and steps < 60 and x > 0:
        x, steps, grown = max(0, x - 6), steps + 1, True
    if twice(x, y):
        return place[a], place[a + len(own) - 1] + 1, 2, False
    first, last = place[x], place[y - 1] + 1
    while grown and first and re.match("[a-zA-Z0-9]", body[first - 1]):
        first -= 1
    while grown and last < len(body) and re.match("[a-zA-Z0-9]", body[last]):
        last += 1
    return first, last, 1, grown


def test_unique_against_step_by_step():
    r = random.Random(3)
    seen = set()
    for n in range(500):
        parts = ["".join(r.choice("ab ") for _ in range(r.choice([3, 20, 200]))) for _ in range(3)]
        body = r.choice([" ", ", ", ""]).join(r.choice(parts) for _ in range(r.randint(1, 6)))
        text = letters(body)
        if not text:
            continue
        at = r.randrange(len(text))
        own = text[at : at + r.choice([4, 12])] if n % 9 else text[-6:]
        found = A.unique(own, body)
        assert found == stepped(own, body)
        seen.add(found[2:])
    assert seen == {(1, False), (1, True), (2, False)}


def test_a_piece_at_the_end_grows_to_the_left():
    body = "one end of it; another end of it"
    assert A.unique("endofit", body) == (4, 24 - 1, 1, True) or body[slice(*A.unique("endofit", body)[:2])].startswith("end of it")
    assert body[slice(*A.unique("dofitanotherendofit"[-7:], body + " x")[:2])].startswith("end of it")
    assert A.unique("absent", body) is None and A.unique("", body) is None and A.unique("a", None) is None


@pytest.mark.parametrize("seed", range(4))
def test_selections_come_back_in_the_passages_form(seed):
    r = random.Random(seed)
    parts = ["word", "a", " ", "  ", "\n", "-", " - ", ",", " ;", "x", "ap olypep-tide", "\xa0", ":", "b cdefg-h"]
    errors = set()
    for _ in range(500):
        nodes = ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 5))]
        flat = "".join(nodes)
        basic = A.normal(flat)
        if not basic:
            continue
        a = r.randrange(len(basic))
        form = r.choice([A.normal, A.deep])
        passage = form(flat)[a : a + r.randint(1, 12)]
        ok, error, is_deep, n1, o1, n2, o2, got = A.select(nodes, passage)
        errors.add(error)
        if n1 is not None:
            starts = [sum(map(len, nodes[:i])) for i in range(len(nodes))]
            assert flat[starts[n1] + o1 : starts[n2] + o2] == got
            assert ok == ((A.deep(got) == A.deep(passage)) if is_deep else (A.normal(got) == A.normal(passage)))
        if form is A.normal and passage.strip() == passage and not is_deep and error:
            assert error in ("ROUNDTRIP_MISMATCH", "LOCATE_FAIL")
    assert None in errors


def test_normal_forms_by_rule():
    r = random.Random(8)
    space = r"[\t-\r \u00a0\u2003\ufeff]"
    for _ in range(3000):
        text = "".join(r.choice(["a", "B", " ", "  ", "\n", "-", "--", ",", ";", ":", "\xa0", "\u2003", "\ufeff", "\t"]) for _ in range(r.randint(0, 12)))
        want = re.sub(f"{space}+", " ", text)
        want = re.sub(f"{space}+([,;:])", r"\1", re.sub(f"{space}*-{space}*", "-", want))
        assert A.normal(text) == re.sub(f"^{space}+|{space}+$", "", want), repr(text)


def test_selection_by_hand():
    nodes = ["The valve ", "of  the", " tank - it", " opens , slowly"]
    assert A.select(nodes, "of the tank-it opens") == (True, None, False, 1, 0, 3, 7, "of  the tank - it opens ")
    assert A.select(nodes, "opens,  slowly") == (True, None, False, 3, 1, 3, 15, "opens , slowly")
    assert A.select(["the ap olypep-", "tide here"], "apolypep-tide here")[:3] == (True, None, True)
    assert A.select(nodes, "something else")[1] == "NEEDLE_NOT_IN_CONTAINER" and A.select([], "")[1] == "LOCATE_FAIL" and A.select(None, "x")[0] is False


def test_columns_over_nulls_and_nothing(spark):
    rows = [(1, "the body of a text that is long enough", "body of a text that is"), (2, None, "x"), (3, "text", None), (4, "", "")]
    frame = spark.createDataFrame(rows, "i long, body string, passage string")
    found = {x.i: x.f.form for x in frame.select("i", A.locate_in_body(F.col("passage"), F.col("body")).alias("f")).collect()}
    assert found == {1: "alpha/raw", 2: None, 3: None, 4: None}
    grown = {x.i: x.f.occurrences for x in frame.select("i", A.ensure_unique(F.lit("t"), F.col("body")).alias("f")).collect()}
    assert grown == {1: 1, 2: None, 3: 1, 4: None}
    picked = {x.i: x.f.ok for x in frame.select("i", A.simulate_select(F.split("body", " "), F.lit("bodyof")).alias("f")).collect()}
    assert picked == {1: True, 2: False, 3: False, 4: False}
    assert frame.limit(0).select(A.locate_in_body(F.col("passage"), F.col("body"))).count() == 0
