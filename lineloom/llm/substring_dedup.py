"""Substring deduplication over runs of consecutive sentences.

A text is cut into sentences (at `.`, `!`, `?` before white space, and at line ends; of every SENTENCE_WORDS consecutive
words of a sentence, the least hashed pair of neighbours is cut apart, so that a passage is cut at the same words wherever
it stands and a long sentence cannot hide it). No sentence keeps more than SENTENCE_WORDS words.

A run of SPAN_SENTENCES or more consecutive sentences with SPAN_WORDS words or more that stands elsewhere before is
removed. Of all such runs, the shortest from every sentence and the shortest up to every sentence are hashed (96 bits,
after lower-casing and turning white space into one space): any longer run is covered by those inside it. Hashes are
joined over all documents; a sentence covered by a span that is not the first of its kind is removed. First is the least
id, then the first place in it.

Texts are hashed once and hashes are shuffled once. Before that, a task settles what it can for every SETTLED spans: of a
kind's occurrences among them only the one with the least id can be the first of all, so it alone is sent; the others
are removed anyway and leave as merged ranges of sentences. A passage that a third of all documents hold so leaves a row
for every such chunk of rows, and what is left is streamed in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm.common import appended, table, text_key, without

SPAN_SENTENCES = 2
SPAN_WORDS = 20
SENTENCE_WORDS = 16
#: Spans that a task settles among themselves before it sends them.
SETTLED = 400_000
_WORD = re.compile(r"\S+")
#: Factors of the bytes of a word, by place in it.
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, 4096, np.uint64) | np.uint64(1)


def _sliding(values: np.ndarray, size: int, least: np.ufunc) -> np.ndarray:
    """least (or its opposite) of every `size` consecutive values."""
    width = 1
    while 2 * width <= size:
        values = least(values[:-width], values[width:])
        width *= 2
    return least(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def _cuts(joined: bytes, starts: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """The words before which long sentences are cut; sentence: the number of the sentence of every word."""
    codes = np.frombuffer(joined + b" ", np.uint8)
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    words = np.add.reduceat(_FACTORS[place & 4095] * codes, starts)
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    pairs = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    pairs = (pairs >> np.uint64(1)) | np.uint64(1)
    size = SENTENCE_WORDS - 1  # pairs in SENTENCE_WORDS words
    low = _sliding(pairs, size, np.minimum)
    low[sentence[size:] != sentence[:-size]] = 0  # not of one sentence
    edge = np.zeros(size - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), size, np.maximum) == pairs) + 1


def _shape(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Of a lower-cased text: the words joined by single spaces as bytes, each word's start and end there, and the first word of every
    sentence, followed by the number of words."""
    lines = [line.split() for line in text.split("\n")]
    joined = " ".join([w for line in lines for w in line]).encode("utf-8", "surrogatepass")
    if not joined:
        none = np.zeros(0, np.int64)
        return joined, none, none, np.zeros(1, np.int64)
    codes = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(codes == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(codes))
    final = codes[ends - 1]
    stops = (final == 46) | (final == 33) | (final == 63)
    stops[np.cumsum([len(line) for line in lines if line]) - 1] = True
    first = np.concatenate(([0], np.flatnonzero(stops[:-1]) + 1))
    sizes = np.diff(np.append(first, len(starts)))
    if (sizes >= SENTENCE_WORDS).any():
        first = np.union1d(first, _cuts(joined, starts, np.repeat(np.arange(len(sizes)), sizes)))
    return joined, starts, ends, np.append(first, len(starts))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """[start, end) of every sentence, without the white space around it."""
    first = _shape((text or "").lower())[3].tolist()
    words = [m.span() for m in _WORD.finditer(text or "")]
    return [(words[i][0], words[j - 1][1]) for i, j in zip(first, first[1:], strict=False)]


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[i, j) of the shortest span from every sentence that has one."""
    n = len(first) - 1
    stop = np.maximum(np.searchsorted(first, first[:-1] + SPAN_WORDS), np.arange(n) + SPAN_SENTENCES)
    i = np.flatnonzero(stop <= n)
    return i, stop[i]


def _both(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[i, j) of the shortest spans from and up to every sentence, each once, in order."""
    n = len(first) - 1
    begin = np.minimum(np.searchsorted(first, first[1:] - SPAN_WORDS, side="right") - 1, np.arange(1, n + 1) - SPAN_SENTENCES)
    j = np.flatnonzero(begin >= 0)
    i, stop = _starts(first)
    return np.divmod(np.union1d(i * (n + 1) + stop, begin[j] * (n + 1) + j + 1), n + 1)


def _hashed(joined: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> Spans:
    digest = xxhash.xxh3_128_digest
    places = zip(starts[first[i]].tolist(), ends[first[j] - 1].tolist(), strict=True) if len(i) else ()
    h = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in places]), "<i8").reshape(-1, 2)
    return h[:, 0], (h[:, 1] & 0x7FFFFFFF).astype(np.int32), i.astype(np.int32), (j - 1).astype(np.int32)


def spans(text: str | None) -> Spans:
    """Hash, check, first sentence and last sentence of the span from every sentence that has one."""
    shape = _shape((text or "").lower())
    return _hashed(*shape, *_starts(shape[3]))


def runs(text: str | None) -> tuple[int, Spans]:
    """The number of sentences, and hash, check, first and last sentence of the spans from and up to every sentence."""
    shape = _shape((text or "").lower())
    return len(shape[3]) - 1, _hashed(*shape, *_both(shape[3]))


def _settled(docs: list[tuple[int, Spans]], ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """docs: (sentences, spans) of documents that differ in id or text; ranks: the order of their ids, equal for equal ids.

    Returns document, h, c, first and last of the spans that may be the first of their kind, and document, first and last
    sentence of the ranges that are removed whatever other documents hold.
    """
    h, c, first, last = (np.concatenate([d[1][k] for d in docs]) for k in range(4))
    sizes = np.array([len(d[1][0]) for d in docs])
    doc = np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(h, kind="stable")  # then by document and place
    h, c, first, last, doc = h[order], c[order], first[order], last[order], doc[order]
    same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    sent = np.ones(len(h), bool)
    if len(h):
        heads = np.concatenate(([0], np.flatnonzero(~same) + 1))
        kind = np.concatenate(([0], np.cumsum(~same)))
        sent = ranks[doc] == np.minimum.reduceat(ranks[doc], heads)[kind]
        sent[1:] &= ~(same & (doc[1:] == doc[:-1]))
    # Slots of sentences, one more for each document.
    slots = np.cumsum([0, *(d[0] + 1 for d in docs)])
    edges = np.zeros(slots[-1] + 1, np.int64)
    np.add.at(edges, slots[doc[~sent]] + first[~sent], 1)
    np.add.at(edges, slots[doc[~sent]] + last[~sent] + 1, -1)
    turns = np.diff(np.concatenate(([0], np.cumsum(edges) > 0)).astype(np.int8))
    begin, stop = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    owner = np.searchsorted(slots, begin, side="right") - 1
    return doc[sent], h[sent], c[sent], first[sent], last[sent], owner, begin - slots[owner], stop - slots[owner] - 1


def _span_rows(docs: DataFrame) -> DataFrame:
    """(id, key, h, c, first, last): spans that may be the first of their kind; and with c = -1 and a hash of the document
    as h, the ranges of sentences to be removed in any case, and a row with first = -1 and the number of sentences as
    last."""
    names = ["id", "key", "h", "c", "first", "last"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("id").to_pylist(), batch.column("key").to_pylist()
            found: list[tuple[int, Spans]] = []
            rows: list[int] = []
            held = 0

            def out(batch=batch, ids=ids) -> pa.RecordBatch:
                place = {x: k for k, x in enumerate(sorted({ids[r] for r in rows} - {None}))}
                ranks = np.array([place.get(ids[r], len(place)) for r in rows])
                doc, h, c, first, last, owner, begin, stop = _settled(found, ranks)
                own = np.array(rows)[np.concatenate((doc, owner, np.arange(len(rows))))]
                rest = len(own) - len(doc)
                took = batch.select(["id", "key", "own"]).take(pa.array(own))
                columns = [
                    np.concatenate((h, took.column("own").to_numpy()[len(doc) :])),
                    np.concatenate((c, np.full(rest, -1, np.int32))),
                    np.concatenate((first, begin.astype(np.int32), np.full(len(rows), -1, np.int32))),
                    np.concatenate((last, stop.astype(np.int32), np.array([f[0] for f in found], np.int32))),
                ]
                return pa.RecordBatch.from_arrays([took.column("id"), took.column("key"), *map(pa.array, columns)], names=names)

            seen = set()
            for k, text in enumerate(batch.column("text")):
                if (ids[k], keys[k]) in seen:
                    continue
                seen.add((ids[k], keys[k]))
                found.append(runs(text.as_py()))
                rows.append(k)
                held += len(found[-1][1][0])
                if held > SETTLED:
                    yield out()
                    found, rows, held = [], [], 0
            if found:
                yield out()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "key", F.xxhash64("id", "key").alias("own"), "text").mapInArrow(made, f"id {kind}, key long, h long, c int, first int, last int")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with n_sentences, removed (sentence numbers from 0, sorted) and the text without the removed sentences.

    What stands between kept sentences is kept as it was; a text that loses nothing stays as it is, null stays null and
    has no sentences. The id may be of any type that has an order. Rows that share an id are versions of one document:
    spans they share are kept in each, and rows wholly alike come out alike. Rows with a null id come after all others
    and are never first unless none has an id. An empty table gives an empty one. Input columns named like the new ones
    are replaced, all others carried.
    """
    base = without(df, ["n_sentences", "removed"]).withColumn("__key", text_key(text_col))
    found = _span_rows(base.select(F.col(id_col).alias("id"), F.col("__key").alias("key"), F.col(text_col).alias("text")))
    of_first = F.first("id").over(Window.partitionBy("h", "c").orderBy(F.asc_nulls_last("id")))
    over = found.withColumn("of_first", of_first).where((F.col("c") < 0) | ~F.col("id").eqNullSafe(F.col("of_first")))
    span = F.when(F.col("first") >= 0, F.struct("first", "last"))
    gone = over.groupBy("id", "key").agg(F.collect_set(span).alias("__spans"), F.max(F.when(F.col("first") < 0, F.col("last"))).alias("__n"))
    gone = gone.withColumnsRenamed({"id": "__id", "key": "__gone_key"})
    met = base.join(gone, base[id_col].eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__gone_key"))).drop("__id", "__gone_key", "__key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, covered in zip(batch.column(text_col), batch.column("__spans").to_pylist(), strict=True):
                text = t.as_py()
                out = sorted({k for s in covered for k in range(s["first"], s["last"] + 1)})
                drop = set(out)
                if out:
                    places = sentences(text)
                    stops = [a for a, _ in places[1:]] + [len(text)]
                    text = (text[: places[0][0]] + "".join(text[a:stop] for k, ((a, _), stop) in enumerate(zip(places, stops, strict=True)) if k not in drop)).rstrip()
                texts.append(text)
                removed.append(out)
            rest = [c for c in batch.schema.names if c not in ("__spans", "__n")]
            arrays = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("__n"), pa.array(removed, pa.list_(pa.int32()))], names=[*rest, "n_sentences", "removed"])

    return met.mapInArrow(cut, appended(met.drop("__spans", "__n"), "n_sentences int, removed array<int>"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences that repeat an earlier passage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_sentences", F.size("removed").alias("n_removed"), "removed", "text")
