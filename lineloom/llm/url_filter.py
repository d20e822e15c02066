"""URL rules by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL `.host/path`. All globs are packed side by side into the bits of a few
64-bit words. Reading one character moves every glob at once: a state advances where the character's match mask has
its bit, and a wildcard state stays where the character's loop mask has its bit. URLs are taken a batch at a time, one
character column after the other, so the automaton runs over arrays.

Globs: `*` any run of characters but `/`, `**` any run, `?` one character but `/`, all else itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import LOWER, UPPER, appended, table, with_columns, without

COLUMNS = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class Rule:
    """A host suffix with a path prefix; both may hold globs."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: The rules of the `pages` query.
PAGES_RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def tokens(glob: str) -> list[str]:
    found, i = [], 0
    while i < len(glob):
        step = 2 if glob.startswith("**", i) else 1
        found.append(glob[i : i + step])
        i += step
    return found


class Automaton:
    """All globs in one bit vector; bit b of word b // 64 is one state of one glob."""

    def __init__(self, globs: Sequence[str]):
        parsed = [tokens(g) for g in globs]
        alphabet = sorted({t for p in parsed for t in p if len(t) == 1 and t not in "*?"} | {"/"})
        self.codes = np.array([ord(c) for c in alphabet], dtype=np.uint32)
        n_classes = len(alphabet) + 1  # the last class: any other character
        slash = alphabet.index("/")
        n_bits = sum(1 + sum(t not in ("*", "**") for t in p) for p in parsed)
        self.words = max(1, -(-n_bits // 64))
        match, loop = np.zeros((n_classes, n_bits), bool), np.zeros((n_classes, n_bits), bool)
        start, self.accept, bit = np.zeros(n_bits, bool), [], 0
        for p in parsed:
            start[bit] = True
            for t in p:
                if t == "**":
                    loop[:, bit] = True
                elif t == "*":
                    loop[np.arange(n_classes) != slash, bit] = True
                else:
                    bit += 1
                    if t == "?":
                        match[np.arange(n_classes) != slash, bit] = True
                    else:
                        match[alphabet.index(t), bit] = True
            self.accept.append((bit // 64, np.uint64(1 << (bit % 64))))
            bit += 1
        self.match, self.loop, self.start = self._pack(match), self._pack(loop), self._pack(start[None, :])[0]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        padded = np.zeros((bits.shape[0], self.words * 64), bool)
        padded[:, : bits.shape[1]] = bits
        return np.packbits(padded, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes)).astype(np.int32)

    def accepted(self, texts: Sequence[str]) -> np.ndarray:
        """A row for each text, a column for each glob: whether the glob fits the whole text."""
        if not texts:
            return np.zeros((0, len(self.accept)), bool)
        rows = [self.classes(t) for t in texts]
        lengths = np.array([len(r) for r in rows])
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([rows[i] for i in order]) if lengths.any() else np.zeros(0, np.int32)
        begin = np.concatenate(([0], np.cumsum(lengths[order])[:-1]))
        state = np.tile(self.start, (len(texts), 1))
        ends = lengths[order]
        one, top = np.uint64(1), np.uint64(63)
        for k in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-ends, -k, side="left"))  # rows with more than k characters come first
            d, c = state[:live], flat[begin[:live] + k]
            moved = d << one
            moved[:, 1:] |= d[:, :-1] >> top
            state[:live] = (moved & self.match[c]) | (d & self.loop[c])
        out = np.zeros((len(texts), len(self.accept)), bool)
        for j, (word, mask) in enumerate(self.accept):
            out[order, j] = (state[:, word] & mask) != 0
        return out


def canonical(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (after the first `://`, A-Z lower-cased) and path (up to `?`, `#` or the end); both empty without `://`."""
    host = F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(df: DataFrame, rules: Sequence[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule wins, then block
    before allow, then the earlier rule. No rule, no `://` or a null url: rule null, verdict `default`. Repeated rows
    are judged alike, an empty table gives an empty one, input columns named like the new ones are replaced. No
    shuffle: a row depends on itself alone.
    """
    host, path = canonical(F.col(url_col))
    base = without(df.withColumns({"__host": host, "__path": path}), ["host", "path", "rule", "verdict"])
    base = base.withColumnsRenamed({"__host": "host", "__path": "path"})
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), rules[i].verdict != "block", i))
    ranked = [rules[i] for i in order]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([r.glob for r in ranked])
        rule_names = pa.array([*(r.text for r in ranked), None], pa.string())
        verdicts = pa.array([*(r.verdict for r in ranked), default], pa.string())
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            fits = automaton.accepted(["." + h + p if h else "" for h, p in zip(hosts, paths, strict=True)])
            none = np.ones((len(hosts), 1), bool)
            best = pa.array(np.argmax(np.hstack([fits, none]), axis=1))
            yield with_columns(batch, {"rule": rule_names.take(best), "verdict": verdicts.take(best)})

    return base.mapInArrow(judged, appended(base, "rule string, verdict string"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every `pages` url under PAGES_RULES."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, PAGES_RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
