"""Packing documents into sequences: first-fit decreasing in randomised groups, with a tournament tree of bin room.

Documents are dealt by a hash into groups of some GROUP_DOCS or GROUP_BYTES and each group is packed by itself, which needs one
shuffle and the memory of one group. In a group, a document longer than a sequence first fills whole sequences; what
remains of each document goes, longest first, into the first bin with room for it. The tree holds the largest room
below each node, so the first such bin is found in log time. Gaps that are left are filled by cutting pieces of the
emptiest bins, and the last bin is cut at powers of two, which are not padded.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import table

CAPACITY = 2048
END_ID = 1
GROUP_DOCS = 4096
#: Bytes of text of a group, about.
GROUP_BYTES = 64 << 20


class Ids:
    """Ids of a text as little-endian unsigned 32-bit numbers, by a byte-level BPE tokenizer file.

    The merges run in a faster library over the same vocabulary (given as ranks). Its pattern needs a lookahead only
    to split runs of white space, so texts without such runs use the pattern without it, which gives the same parts.
    A text that may hold a special token goes to the tokenizer itself.
    """

    _runs = re.compile(r"\s\s")

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer)
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}

        def merger(name: str, pattern: str) -> Callable[[str], list[int]]:
            return tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary

        self._any, self._simple = merger("any", pattern), merger("simple", pattern.replace(r"\s+(?!\S)|", ""))

    def of(self, text: str) -> bytes:
        if "<|" in text:
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = (self._any if self._runs.search(text) else self._simple)(text)
        return np.array(ids, "<u4").tobytes() if sys.byteorder != "little" else array("I", ids).tobytes()


class Bins:
    """Open bins in order, with a tournament tree over their room."""

    def __init__(self, most: int, capacity: int):
        self.width = 1 << max(0, most - 1).bit_length()
        self.room = [0] * self.width + [capacity] * self.width
        for i in range(self.width - 1, 0, -1):
            self.room[i] = capacity

    def first_fit(self, size: int) -> int:
        """Put `size` into the first bin with room and return the bin."""
        room, i = self.room, 1
        while i < self.width:
            i *= 2
            if room[i] < size:
                i += 1
        at = i - self.width
        room[i] -= size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length): every token in one piece, no gaps, each sequence full or a power of two.

    Documents of the same length go in the order given. Lengths of zero take no part.
    """
    full = [[(d, at, capacity)] for d, n in enumerate(lengths) for at in range(0, n - n % capacity, capacity)]
    rest = sorted((-(n % capacity), d) for d, n in enumerate(lengths) if n % capacity)
    bins: list[list[tuple[int, int, int]]] = []
    tree = Bins(len(rest), capacity)
    for size, d in rest:
        at = tree.first_fit(-size)
        if at == len(bins):
            bins.append([])
        bins[at].append((d, lengths[d] + size, -size))
    room = [capacity - sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (room[i], i))
    i, j = 0, len(order) - 1
    while i < j:
        to, giver = order[i], order[j]
        if not room[to]:
            i += 1
        elif not bins[giver]:
            j -= 1
        else:
            d, start, n = bins[giver].pop()
            cut = min(n, room[to])
            bins[to].append((d, start + n - cut, cut))
            room[to] -= cut
            room[giver] += cut
            if cut < n:
                bins[giver].append((d, start, n - cut))
    out = full + [bins[k] for k in order[:j] if bins[k]] if order else full
    if order and bins[order[j]]:
        last, left = bins[order[j]], capacity - room[order[j]]
        size = capacity
        while left:
            while size > left:
                size //= 2
            took, sequence = size, []
            while took:
                d, start, n = last.pop(0)
                cut = min(n, took)
                sequence.append((d, start, cut))
                took -= cut
                if cut < n:
                    last.insert(0, (d, start + cut, n - cut))
            out.append(sequence)
            left -= size
    return out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    encoder() makes a worker's function from text to ids. A null or empty text is the end id alone. Rows with a null or
    repeated doc_id are documents of their own. sequence_id is group * 2**32 + number in the group. The number of
    groups follows the number of documents and their bytes, and a row's number is part of the deal, so a group stays bounded
    (but for one huge text) even if all rows are alike. Ids are whole numbers; other columns are not carried.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    groups = max(1, round(size["n"] / group_docs), -(-(size["bytes"] or 0) // GROUP_BYTES))
    rows = docs.select(F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(2048)), F.lit(groups)).alias("grp"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = end_id.to_bytes(4, "little")
    state: dict[str, Callable[[str], bytes]] = {}

    def packed(group: pa.Table) -> pa.Table:
        if "encode" not in state:
            state["encode"] = encoder()
        encode = state["encode"]
        ids = [encode(t.as_py() or "") + end for t in group.column("text")]
        names = group.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (names[i] is None, names[i] or 0, ids[i]))
        base = group.column("grp")[0].as_py() << 32
        rows = []
        for k, sequence in enumerate(pack([len(ids[i]) // 4 for i in order], capacity)):
            offset = 0
            for d, start, n in sequence:
                own = ids[order[d]]
                rows.append((names[order[d]], start, n, own[4 * start : 4 * (start + n)], len(own) // 4, base + k, offset))
                offset += n
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return rows.groupBy("grp").applyInArrow(packed, PIECES)


def public_bpe() -> Callable[[str], bytes]:
    """The public byte-level BPE vocabulary, found by its package on the worker."""
    import public_tokenizers

    return Ids(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).of


def packed_digest(docs: DataFrame) -> DataFrame:
    pieces = pack_documents(docs, public_bpe)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packed_digest(table(spark, sf_dir, "documents"))
