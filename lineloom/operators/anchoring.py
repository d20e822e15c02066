"""Finding a passage again in another rendering of its document, making it unique there, and mapping it onto text nodes.

All three compare letters and digits or normal forms alone and give places in the text as it stands. Each takes and gives
columns, so what is asked and where meet by whatever join the caller has; a row needs the memory of its text.

Two ladders are not climbed step by step. A head of a passage stands in a text if a longer head does, and a piece occurs
again if a longer one around it does; so the first step that holds is found by halving, with a handful of searches.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lineloom.functions.text import PREAMBLES, WS
from lineloom.operators.matching import kept

#: Confusions of optical recognition.
CONFUSED = (("CHI", "CH1"), ("CH1", "CHI"), ("lI", "II"))
#: Fixed values of the ladders.
LEAST_TEXT, LEAST_LETTERS, LEAST_CUT = 8, 16, 30
CUT_STEP, CUT_SHARE = 5, 0.6
GROW_STEP, GROW_STEPS, GROW_ALL = 6, 30, 60

_ENDS = re.compile(f"^[{WS}]+|[{WS}]+$")
_OPENING = [re.compile(rf"^{re.escape(words)}[{WS}]*:[{WS}]*", re.I | re.A) for words in PREAMBLES]
_NUMBER = re.compile(rf"^[0-9]+\.[{WS}]+")
_ALNUM = re.compile("[A-Za-z0-9]")


def _trimmed(text: str) -> str:
    return _ENDS.sub("", text)


def attempts(passage: str) -> list[tuple[str, str]]:
    """(name, text) of the forms of a passage that are looked for, in order: as it is, without a preamble, without a claim
    number, with confused letters exchanged. Forms under eight characters and repeated forms are left out."""
    forms: dict[str, str] = {}

    def add(name: str, text: str) -> None:
        if len(text) >= LEAST_TEXT:
            forms.setdefault(text, name)

    add("raw", passage)
    bare = passage
    for opening in _OPENING:
        if opening.search(bare):
            bare = _trimmed(opening.sub("", bare, count=1))
            add("strip-preamble", bare)
    plain = _trimmed(_NUMBER.sub("", bare, count=1))
    if plain != bare:
        add("strip-preamble+claim-num", plain)
    for seen, meant in CONFUSED:
        for text, more in ((bare, ""), (plain, "+claim")):
            if seen in text:
                add(f"ocr:{seen}->{meant}{more}", text.replace(seen, meant))
    return [(name, text) for text, name in forms.items()]


def _letters(text: str) -> str:
    return "".join(_ALNUM.findall(text)).lower()


def _first_cut(length: int, held: object) -> int | None:
    """The least cut, in steps of five characters under 60 % that leave thirty, after which the rest is held."""
    cuts = [c for c in range(CUT_STEP, length, CUT_STEP) if c < length * CUT_SHARE and length - c >= LEAST_CUT]
    at = bisect_left(cuts, True, key=held)
    return cuts[at] if at < len(cuts) else None


def locate(passage: str | None, body: str | None) -> tuple[str, int, int, str] | None:
    """(form, start, stop, letters): where a passage's letters and digits stand in a body.

    Every form is looked for whole first, if it has sixteen letters. Then every form of thirty or more is cut, at its end
    and, failing that, at its head, by as little as makes it stand there.
    """
    if not passage or not body:
        return None
    view = kept(body, "alnum")
    text = view.text.lower()
    forms = [(name, _letters(form)) for name, form in attempts(passage)]

    def found(name: str, letters: str) -> tuple[str, int, int, str] | None:
        at = text.find(letters)
        return (name, *view.span(at, at + len(letters)), letters) if at >= 0 else None

    for name, letters in forms:
        if len(letters) >= LEAST_LETTERS and (hit := found(f"alpha/{name}", letters)):
            return hit
    for name, letters in forms:
        n = len(letters)
        if n < LEAST_CUT:
            continue
        cut = _first_cut(n, lambda c, letters=letters, n=n: letters[: n - c] in text)
        if cut:
            return found(f"alpha-shrink-tail-{cut}/{name}", letters[: n - cut])
        cut = _first_cut(n, lambda c, letters=letters: letters[c:] in text)
        if cut:
            return found(f"alpha-shrink-head-{cut}/{name}", letters[cut:])
    return None


def unique(letters: str | None, body: str | None) -> tuple[int, int, int, bool] | None:
    """(start, stop, occurrences, grown): a body's piece around the first occurrence of these letters that occurs once.

    The piece grows by six letters to the right, thirty times at most, then to the left, until no other occurrence follows
    it; a grown one is widened to whole words. Occurrences count up to two and do not overlap. Null without an occurrence.
    """
    if not letters or not body:
        return None
    view = kept(body, "alnum")
    text = view.text.lower()
    a = text.find(letters)
    if a < 0:
        return None
    b, n = a + len(letters), len(text)
    if text.find(letters, b) < 0:
        return (*view.span(a, b), 1, False)
    # The piece starts at its first occurrence however it grows, so it occurs once if none follows.
    right = min(GROW_STEPS, -(-(n - b) // GROW_STEP))
    k = bisect_left(range(1, right + 1), True, key=lambda k: text.find(text[a : min(n, b + GROW_STEP * k)], min(n, b + GROW_STEP * k)) < 0)
    b, start = min(n, b + GROW_STEP * min(k + 1, right)), a
    if k == right:
        left = min(GROW_ALL - right, -(-a // GROW_STEP))
        k = bisect_left(range(1, left + 1), True, key=lambda k: text.find(text[max(0, a - GROW_STEP * k) : b], b) < 0)
        if k == left:
            return (*view.span(a, a + len(letters)), 2, False)
        start = max(0, a - GROW_STEP * (k + 1))
    first, last = view.span(start, b)
    while first > 0 and _ALNUM.match(body[first - 1]):
        first -= 1
    while last < len(body) and _ALNUM.match(body[last]):
        last += 1
    return first, last, 1, True


_GAPS = re.compile(f"[{WS}]+|-[{WS}]*")
#: White space that is not a single space.
_RUNS = re.compile(f"[{WS}]{{2,}}|(?! )[{WS}]")
_SPLIT_WORD = re.compile("(?<=[a-zA-Z])([a-zA-Z]) ([a-zA-Z]{4,}-[a-z])")


def normal(text: str) -> str:
    """One space for a run of white space, none around hyphens, before commas, semicolons and colons, or at the ends."""
    text = _RUNS.sub(" ", text).replace(" -", "-").replace("- ", "-")
    for mark in ",;:":
        text = text.replace(" " + mark, mark)
    return _trimmed(text)


def deep(text: str) -> str:
    """The normal form with a letter that stands apart from its broken word joined to it."""
    return _SPLIT_WORD.sub(r"\1\2", normal(text))


def _places(flat: str, most: int) -> np.ndarray:
    """For the characters of the normal form up to number `most` at least, their places in the text. White space at the end
    counts as one more character."""
    made: list[np.ndarray] = []
    done, size = 0, 0
    for m in _GAPS.finditer(flat):
        a, b = m.span()
        made.append(np.arange(done, a))
        size += a - done
        if flat[a] == "-" or (size and (b == len(flat) or flat[b] not in "-,;:")):
            made.append(np.array([a]))
            size += 1
        done = b
        if size > most:
            return np.concatenate(made)
    made.append(np.arange(done, len(flat)))
    return np.concatenate(made)


def _spread(basic: str, start: int, stop: int) -> tuple[int, int]:
    """A span of the deep form as one of the normal form."""
    gone = [m.start() + 1 for m in _SPLIT_WORD.finditer(basic)]
    own = np.setdiff1d(np.arange(len(basic) + 1), gone)  # places that the deep form keeps, and the end
    # A span that starts where a space went starts at the space, and one that ends there ends before it.
    first, last = int(own[start]), int(own[stop])
    return (first - 1 if first - 1 in gone else first), (last - 1 if last - 1 in gone else last)


Selected = tuple[bool, str | None, bool, int | None, int | None, int | None, int | None, str | None]


def select(nodes: list[str] | None, passage: str | None) -> Selected:
    """(ok, error, deep, first node, offset, last node, offset, text) of selecting a passage over the text nodes of a page.

    The passage is looked for in the normal form of the joined nodes, then in the deep form; its span is carried back to
    nodes and offsets (code points), and what stands there has to have the passage's form again.
    """
    nodes, passage = nodes or [], passage or ""
    flat = "".join(nodes)
    basic, want = normal(flat), normal(passage)
    is_deep = want not in basic
    if is_deep:
        whole, part = deep(flat), deep(passage)
        at = whole.find(part)
        if at < 0:
            return False, "NEEDLE_NOT_IN_CONTAINER", False, None, None, None, None, None
        start, stop = _spread(basic, at, at + len(part))
    else:
        start = basic.find(want)
        stop = start + len(want)
    places = _places(flat, max(start, stop))
    if max(start, stop) > len(places) or not nodes:
        return False, "LOCATE_FAIL", is_deep, None, None, None, None, None
    ends = np.cumsum([len(n) for n in nodes])
    spots = []
    for k in (start, stop):
        if k == len(places):
            spots.append((len(nodes) - 1, len(nodes[-1]), len(flat)))
        else:
            node = int(np.searchsorted(ends, places[k], side="right"))
            spots.append((node, int(places[k] - (ends[node] - len(nodes[node]))), int(places[k])))
    got = flat[spots[0][2] : spots[1][2]]
    ok = deep(got) == deep(passage) if is_deep else normal(got) == want
    return ok, None if ok else "ROUNDTRIP_MISMATCH", is_deep, *spots[0][:2], *spots[1][:2], got


def _columns(rows: Iterator[tuple | None], names: list[str], kinds: dict[str, str]) -> pd.DataFrame:
    empty = (None,) * len(names)
    return pd.DataFrame([r or empty for r in rows], columns=names).astype(kinds)


def locate_in_body(passage: Column, body: Column) -> Column:
    """`locate` as a column: form, start, stop, letters; all null where nothing is found or a side is null or empty."""

    @F.pandas_udf("form string, start int, stop int, letters string")
    def located(passage: pd.Series, body: pd.Series) -> pd.DataFrame:
        return _columns((locate(p, b) for p, b in zip(passage, body, strict=True)), ["form", "start", "stop", "letters"], {"start": "Int32", "stop": "Int32"})

    return located(passage, body)


def ensure_unique(letters: Column, body: Column) -> Column:
    """`unique` as a column: start, stop, occurrences, grown; all null where the letters do not occur."""

    @F.pandas_udf("start int, stop int, occurrences int, grown boolean")
    def grown(letters: pd.Series, body: pd.Series) -> pd.DataFrame:
        return _columns((unique(p, b) for p, b in zip(letters, body, strict=True)), ["start", "stop", "occurrences", "grown"], {"start": "Int32", "stop": "Int32", "occurrences": "Int32", "grown": "boolean"})

    return grown(letters, body)


def simulate_select(nodes: Column, passage: Column) -> Column:
    """`select` as a column: ok, error, deep, first_node, first_offset, last_node, last_offset, text."""

    @F.pandas_udf("ok boolean, error string, deep boolean, first_node int, first_offset int, last_node int, last_offset int, text string")
    def selected(nodes: pd.Series, passage: pd.Series) -> pd.DataFrame:
        names = ["ok", "error", "deep", "first_node", "first_offset", "last_node", "last_offset", "text"]
        spots = {n: "Int32" for n in names[3:7]}
        return _columns((select(None if n is None else list(n), p) for n, p in zip(nodes, passage, strict=True)), names, {"ok": "boolean", "deep": "boolean", **spots})

    return selected(nodes, passage)
