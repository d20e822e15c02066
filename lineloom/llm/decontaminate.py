"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is 13 consecutive words of an item (a shorter item is one window) and counts only where all its words occur
in a row, so the overlap asked of a window's shingle set is the whole set, and one prefix token is necessary and
enough to find it: the rarest of its 5-word shingles (in the benchmark's windows; ties by hash). Documents are read
once. Their shingles meet the prefix tokens, the token's place in the window gives the only place the window can start,
the bounds of the document cut windows that do not fit, and the rest is verified word by word.

Windows travel to the executors in blocks of at most BLOCK_WINDOWS. Documents go through one block after the other,
with a table in the shared folder in between, so a benchmark of any size needs the memory of one block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm.common import appended, scratch, table, with_columns, without

WINDOW = 13
SHINGLE = 5
#: Some 30 MB for 13-word windows.
BLOCK_WINDOWS = 100_000
#: Document bytes that are matched together; a longer document is matched alone.
BATCH_BYTES = 4 << 20
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, then runs of 0-9, a-z and all that is not ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` word ids; a hash only proposes, so equal hashes of unlike runs do no harm."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        x = ids[k : k + n].astype(np.uint64) * _MIX[k]
        out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


class Windows:
    """A block of windows: vocabulary, prefix tokens by shingle width, window words by length."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        """items: (item, words of one of its windows)."""
        owners: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item, window in items:
            owners[tuple(window)].add(item)
        texts = sorted(owners)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.owners = [sorted(owners[t]) for t in texts]
        rows = [np.array([self.vocabulary[w] for w in t], np.int32) for t in texts]
        hashes = [shingle_hashes(r, min(SHINGLE, len(r))) for r in rows]
        tokens, counts = np.unique(np.concatenate([np.unique(h) for h in hashes]), return_counts=True) if rows else (np.zeros(0, np.uint64), [])
        held = dict(zip(tokens.tolist(), list(counts), strict=True))
        self.places: dict[int, list] = defaultdict(list)
        for i, (r, h) in enumerate(zip(rows, hashes, strict=True)):
            at = min(range(len(h)), key=lambda k: (held[int(h[k])], int(h[k])))
            self.places[min(SHINGLE, len(r))].append((int(h[at]), i, at))
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), WINDOW), np.int32)
        for i, r in enumerate(rows):
            self.rows[i, : len(r)] = r
        self.prefixes = {}
        for width, found in self.places.items():
            found.sort()
            h = np.array([f[0] for f in found], np.uint64)
            keys, first = np.unique(h, return_index=True)
            self.prefixes[width] = (keys, np.append(first, len(h)), np.array([f[1] for f in found]), np.array([f[2] for f in found]))
        del self.places

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start word, window) of every occurrence of a window."""
        get = self.vocabulary.get
        sizes = np.array([len(d) for d in docs], np.int64)
        ids = np.fromiter((get(w, 0) for d in docs for w in d), np.int32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        end = begin + sizes
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        starts, windows = [], []
        for width, (keys, first, window, offset) in self.prefixes.items():
            whole = np.nonzero(known[width:] - known[:-width] == width)[0]  # shingles of known words only
            h = shingle_hashes(ids, width)[whole]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            at, place = at[hit], whole[hit]
            n = first[at + 1] - first[at]
            rep = np.repeat(np.arange(len(at)), n)
            entry = first[at][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            starts.append(place[rep] - offset[entry])
            windows.append(window[entry])
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        window = np.concatenate(windows) if windows else np.zeros(0, np.int64)
        stop = start + self.lengths[window]
        # Positional and length bounds: the window has to lie inside one document.
        doc = np.searchsorted(begin, start, side="right") - 1
        fits = (start >= 0) & (doc >= 0) & (stop <= end[np.maximum(doc, 0)]) if len(start) else np.zeros(0, bool)
        start, window, doc = start[fits], window[fits], doc[fits]
        for k in range(WINDOW):
            inside = k < self.lengths[window]
            same = ~inside | (ids[np.minimum(start + k, max(len(ids) - 1, 0))] == self.rows[window, k]) if len(start) else inside
            start, window, doc = start[same], window[same], doc[same]
        return doc, start - begin[doc] if len(doc) else start, window


def _blocks(items: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[Windows]:
    """Items block by block, in no order; the driver holds one block at a time."""
    held: list[tuple[int, list[bytes]]] = []
    for item, text in items.select(item_col, text_col).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).toLocalIterator():
        w = words(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            held.append((item, w[i : i + WINDOW]))
            if len(held) >= size:
                yield Windows(held)
                held = []
    yield Windows(held)


def _groups(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that texts of BATCH_BYTES, or one text, are matched at once."""
    for batch in batches:
        column, at, held = batch.column(text_col), 0, 0
        for i in range(batch.num_rows):
            n = len(column[i].as_buffer() or b"") if column[i].is_valid else 0
            if held and held + n > BATCH_BYTES:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def mark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs with n_words, hit_spans (merged [start, stop) word spans inside windows) and hit_items (sorted item ids).

    Null texts have no words. Items without words, with a null text or a null id take no part; items that repeat count
    once each by id. Repeated documents are marked alike; an empty benchmark marks nothing. Input columns named like
    the new ones are replaced, all others are carried.
    """
    spark = docs.sparkSession
    now = without(docs, ["n_words", "hit_spans", "hit_items"])
    item_type = items.schema[item_col].dataType
    done = False
    for block in _blocks(items, item_col, item_text_col, block_windows):
        shared = spark.sparkContext.broadcast(block)
        if done:
            now = scratch(now, "marked")
        arrow_item = pa.int64() if isinstance(item_type, T.LongType) else pa.int32() if isinstance(item_type, T.IntegerType) else pa.string()

        def marked(batches: Iterator[pa.RecordBatch], shared=shared, again=done, arrow_item=arrow_item) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in _groups(batches, text_col):
                texts = [words(t.as_py()) for t in batch.column(text_col)]
                spans: list[list] = [[] for _ in texts]
                owned: list[set] = [set() for _ in texts]
                if again:
                    spans = [[(s["start"], s["stop"]) for s in x] for x in batch.column("hit_spans").to_pylist()]
                    owned = [set(x) for x in batch.column("hit_items").to_pylist()]
                for d, s, w in zip(*(x.tolist() for x in windows.find(texts)), strict=True):
                    spans[d].append((s, s + int(windows.lengths[w])))
                    owned[d].update(windows.owners[w])
                if again:
                    batch = batch.select([n for n in batch.schema.names if n not in ("n_words", "hit_spans", "hit_items")])
                yield with_columns(batch, {
                    "n_words": pa.array([len(t) for t in texts], pa.int64()),
                    "hit_spans": pa.array([[{"start": a, "stop": b} for a, b in _merged(s)] for s in spans], _SPANS),
                    "hit_items": pa.array([sorted(o) for o in owned], pa.list_(arrow_item)),
                })

        base = now.drop("n_words", "hit_spans", "hit_items")
        now = now.mapInArrow(marked, appended(base, f"n_words long, hit_spans array<struct<start: long, stop: long>>, hit_items array<{item_type.simpleString()}>"))
        done = True
    return now


def n_hit() -> F.Column:
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contaminated() -> F.Column:
    """Some word is hit, and at least one in twenty."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return marked.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), contaminated().alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
