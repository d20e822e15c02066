"""Token counts by byte-pair merging over a heap and a linked list; no token ids are made.

A text falls into chunks at white space, which the vocabulary drops and over which no token reaches. A chunk falls into
words by the vocabulary's own normalizer and pattern. Of a word, every byte is a symbol, the last one with the mark of a
word's end. All adjacent pairs that may merge lie in a heap by rank and place; the lowest is popped again and again and,
if its symbols still stand, merged in a linked list, and the pairs that so arise are pushed. A word's count is its symbols
minus its merges.

Counts of short chunks and words are kept by worker process, up to a bound, so a frequent word is merged once.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import appended, table, with_columns, without

LIMIT = 2048
#: Most chunks and words whose counts a worker keeps, and their greatest length.
KEPT = 400_000
KEPT_CHARS = 48
#: Code units of a text that are split at once.
SLICE = 1 << 20

#: White space of the vocabulary's pattern (fixed values: the code points of the Unicode property White_Space).
_SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_GAP = re.compile(f"[{_SPACE}]+")
#: What str.split() takes for white space beyond that.
_OTHER_GAPS = re.compile("[\x1c-\x1f]")


class Merges:
    """The pairs of a BPE vocabulary whose words end with a mark: ranks, and what symbol each merge makes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self._inner = {s: i for s, i in vocab.items() if len(s) == 1}
        self._last = {s[: -len(end)]: i for s, i in vocab.items() if len(s) == 1 + len(end) and s.endswith(end)}
        self._bits = max(vocab.values()).bit_length()
        self._rank = {vocab[a] << self._bits | vocab[b]: r for r, (a, b) in enumerate(merges)}
        self._made = [vocab[a + b] for a, b in merges]

    def count(self, symbols: str) -> int:
        """Tokens of a word, given as one character a byte."""
        bits, rank, made = self._bits, self._rank.get, self._made
        part = [self._inner[c] for c in symbols[:-1]]
        part.append(self._last[symbols[-1]])
        n = len(part)
        now = [rank(a << bits | b, -1) for a, b in zip(part, part[1:])]  # of the pair that starts here; -1: none or no more
        heap = [r * n + i for i, r in enumerate(now) if r >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = 0
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if now[i] != r:
                continue  # one of its symbols has merged meanwhile
            merged += 1
            part[i] = made[r]
            j = after[i]
            k = after[i] = after[j]
            if k < n:
                now[j] = -1
                before[k] = i
                now[i] = r = rank(part[i] << bits | part[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + i)
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                now[h] = r = rank(part[h] << bits | part[i], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + h)
        return n - merged


class _Kept(dict):
    """Counts by text, made where they lack and kept up to a bound."""

    def __init__(self, make: Callable[[str], int]):
        self.make = make

    def __missing__(self, text: str) -> int:
        n = self.make(text)
        if len(text) <= KEPT_CHARS and len(self) < KEPT:
            self[text] = n
        return n


class Counter:
    """Counts the tokens of texts as the vocabulary's library does without begin, end or limit.

    A special token's string inside a text is that one token, by the library's default; it holds no white space.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = [t["content"] for t in model["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        library = Tokenizer.from_file(path)
        self._normal, self._words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        merges = Merges(model["model"]["vocab"], model["model"]["merges"], model["model"]["end_of_word_suffix"])
        self._word = _Kept(merges.count)
        self._chunk = _Kept(self._of_chunk)

    def _of_chunk(self, chunk: str) -> int:
        if chunk.isalpha() and chunk.isascii():
            return self._word[chunk.lower()]
        plain = self._special.split(chunk)
        return len(plain) - 1 + sum(self._word[word] for part in plain if part for word, _ in self._words(self._normal(part)))

    def of(self, text: str) -> int:
        split = _GAP.split if _OTHER_GAPS.search(text) else str.split
        total, start = 0, 0
        while start < len(text):
            end = start + SLICE
            gap = _GAP.search(text, end) if end < len(text) else None
            end = gap.start() if gap else len(text)
            total += sum(map(self._chunk.__getitem__, split(text[start:end])))
            start = end
        return total


def count_tokens(docs: DataFrame, counter: Callable[[], Callable[[str], int]], text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens).

    counter() makes a worker's function from text to count. A null text is empty: no bytes, no tokens. Every row, repeated
    or with a null id, is counted by itself; columns of docs with the names of the new ones are replaced. Whole texts are
    counted, a slice at a time; rows do not move. An empty table gives an empty result.
    """
    rows = without(docs, ["n_bytes", "n_tokens", "over_limit"])
    at = [c.lower() for c in rows.columns].index(text_col.lower())
    schema = appended(rows, "n_tokens long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter()
        for batch in batches:
            counts = [of(t.as_py()) if t.is_valid else 0 for t in batch.column(at)]
            yield with_columns(batch, {"n_tokens": pa.array(counts, pa.int64())})

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return rows.mapInArrow(counted, schema).withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})


@functools.cache
def public_words() -> Callable[[str], int]:
    """The public vocabulary of words with ends, found by its package on the worker; one a worker process, with its counts."""
    import public_tokenizers

    return Counter(public_tokenizers.path("word_bpe_49k.json")).of


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_words)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
