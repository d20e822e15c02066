"""Phrases whose words stand together more often than chance has it, from vertical lists of positions.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Everything is counted
within a language. Documents are dealt into segments of some SEGMENT_BYTES of one language; a segment holds an inverted
list for each of its phrases: the phrase and the ascending places of its occurrences. A list's length is the phrase's
exact count in the segment, and the sum over segments is its frequency. A phrase of k + 1 words comes from merge-joining
the places of a frequent phrase with the postings of the word after it. Past two words, those postings are narrowed to the
places where the word ends a frequent phrase of k words, as any other cannot end a longer frequent one.

Most phrases of a segment are rare, so before they move themselves, hashes of them do: sorted, as packed differences with
the lengths, some one to two bytes a phrase. The lengths of all segments are summed by hash, and a bit a phrase goes back:
whether the sum reaches the limit. No frequent phrase is left out so, and a rare one that shares its hash is counted and
dropped.

What is left moves as packed arrays, one a segment and range of hashes: a word by its name, a longer phrase by the numbers
of its first and its last part, each with its length and its place in the segment. Ranges are summed exactly, and each
frequent phrase gets a number there. Its place and its number go back to the segments that hold it, which join once more
and keep these lists alone. Names and the frequencies of parts stand once a phrase, in a table of each level that names the
two parts' numbers, and not in the segments.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm.common import UPPER, discard, scratch, scratch_path, table

LEAST = 100
LONGEST = 5
TOP = 2000
NO_LANG = "und"
#: Bytes of text of a segment, about. A longer text is cut at the end of a piece.
SEGMENT_BYTES = 12 << 20
#: Bytes of text that a task holds in open segments.
OPEN_BYTES = 3 * SEGMENT_BYTES
#: Parts into which a language's candidates are dealt for ranking; each gives at most the rows that are asked for.
SALTS = 64
#: Bits of a phrase's hash, at most. Fewer leave more rare phrases to be counted themselves; the rows are the same. So many
#: are taken that a hash stands for WORDS_A_HASH words of the largest language.
HASH_BITS, WORDS_A_HASH = 32, 8
#: Phrases of a segment that are dealt over the ranges at once.
AT_ONCE = 1 << 18
#: Frequent phrases' numbers are less than that, so that those of two parts fit in 64 bits.
MOST = 1 << 31
#: Hashes are summed in spans, as many as there are segments to so many, and RANGES at least.
RANGES, SEGMENTS_A_RANGE = 64, 64

_STOP = ord(".")
_MAP = bytearray(range(256))
for _c in b",;:!?\n\x0b\x0c\r":
    _MAP[_c] = _STOP
for _c in UPPER.encode():
    _MAP[_c] += 32
_PIECES = bytes(_MAP)

POSTINGS = "seg long, lang string, phrases array<string>, lens array<int>, places binary"
LISTS = "seg long, lang string, phrases array<long>, lens array<int>, places binary"
COUNTS = "seg long, lang string, span int, keys binary, at binary, lens binary"
#: Of a segment, places and numbers of frequent phrases; or, without a segment, the frequent phrases of a range.
FOUND = "seg long, at binary, numbers binary, lang string, own array<struct<number: long, a: long, word: string, pair: long>>"
SKETCHES = "seg long, lang string, span int, hashes binary, lens binary"
MARKS = "seg long, span int, bits binary"


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with b"." between pieces. All ASCII white space but space and tab ends a piece."""
    return text.translate(_PIECES).replace(b".", b" . ").split()


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers of 32 bits by byte plane, as their upper bytes are mostly zero, compressed."""
    planes = values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _opened(packed: bytes) -> np.ndarray:
    planes = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _packed(places: np.ndarray) -> bytes:
    """Differences of places, squeezed."""
    return _squeezed(np.diff(places.astype("<i4"), prepend=np.int32(0)))


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(_opened(packed), dtype=np.int32)


def postings(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, the lengths of their lists, and the lists one after another. Each stop takes a place of its own."""
    codes: dict[bytes, int] = {b".": 0}
    found: list[np.ndarray] = []
    for text in texts:
        words = tokens(text)
        for w in words:
            if w not in codes:
                codes[w] = len(codes)
        found.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
        found.append(np.zeros(1, np.int32))
    at = np.concatenate(found) if found else np.zeros(0, np.int32)
    order = np.argsort(at, kind="stable")
    lens = np.bincount(at, minlength=len(codes))
    return [w.decode("utf-8", "replace") for w in list(codes)[1:]], lens[1:], order[lens[0] :]


def extend(lens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One word longer: (number of the first part, number of the last part, lengths, places) of every phrase that occurs.

    lens and places: the lists of the frequent phrases of k words. The list of a phrase is merge-joined with the lists at the
    next place: for k = 1 the postings of the next word, else these narrowed as above.
    """
    number = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    order = np.argsort(places, kind="stable")
    number, places = number[order], places[order]
    here = np.flatnonzero(np.diff(places) == 1)  # a place holds one phrase of k words, so the next entry is its neighbour
    pair = number[here].astype(np.int64) * len(lens) + number[here + 1]
    order = np.argsort(pair, kind="stable")
    pair, places = pair[order], places[here][order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    counts = np.diff(np.append(first, len(pair)))
    return *np.divmod(pair[first], max(1, len(lens))), counts, places


def _chosen(lens: np.ndarray, places: np.ndarray, kept: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists at `kept`, which get these numbers, in the order of rising numbers: (numbers, lengths, places)."""
    order = np.argsort(numbers)
    new = np.full(len(lens), -1, np.int32)
    new[kept[order]] = np.arange(len(kept), dtype=np.int32)
    owner = np.repeat(new, lens)
    on = owner >= 0
    return numbers[order], lens[kept[order]], places[on][np.argsort(owner[on], kind="stable")]


def _longer_names(phrases: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Of every pair of a first and a last part, the phrase: the first and the last's last word, or both parts' numbers."""
    if pa.types.is_integer(phrases.type):
        own = phrases.to_numpy()
        return pa.array(own[a] << 32 | own[b])
    name = phrases.to_pylist()
    end = [p[p.rfind(" ") + 1 :] for p in name]
    return pa.array([f"{name[i]} {end[j]}" for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.string())


def _frame(schema: pa.Schema, *values: object) -> pa.RecordBatch:
    """A batch of one row."""
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema)


_POSTINGS = pa.schema([("seg", pa.int64()), ("lang", pa.string()), ("phrases", pa.list_(pa.string())), ("lens", pa.list_(pa.int32())), ("places", pa.binary())])
_LISTS = pa.schema([("seg", pa.int64()), ("lang", pa.string()), ("phrases", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("places", pa.binary())])
_OWN = pa.struct([("number", pa.int64()), ("a", pa.int64()), ("word", pa.string()), ("pair", pa.int64())])
_FOUND = pa.schema([("seg", pa.int64()), ("at", pa.binary()), ("numbers", pa.binary()), ("lang", pa.string()), ("own", pa.list_(_OWN))])


def _slices(text: bytes, most: int) -> Iterator[bytes]:
    """A text of more than `most` bytes in parts that end where a piece ends."""
    while len(text) > most:
        cut = max(text.rfind(stop, 0, most) for stop in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r"))
        if cut < 0:
            break
        yield text[: cut + 1]
        text = text[cut + 1 :]
    yield text


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each language fills a segment of its own; if many languages are open, the fullest closes first."""
    seg, held, sizes = TaskContext.get().partitionId() << 32, {}, {}

    def closed(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal seg
        words, lens, places = postings(held.pop(lang))
        del sizes[lang]
        if words:
            yield _frame(_POSTINGS, seg, lang, words, lens.astype(np.int32), _packed(places))
            seg += 1

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang = lang.as_py()
            for part in _slices(text.as_buffer().to_pybytes() if text.is_valid else b"", SEGMENT_BYTES):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sizes[lang] >= SEGMENT_BYTES:
                    yield from closed(lang)
                elif sum(sizes.values()) >= OPEN_BYTES:
                    yield from closed(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from closed(lang)


def _hashes(phrases: pa.Array) -> np.ndarray:
    """Of names; numbers stand for themselves."""
    if pa.types.is_integer(phrases.type):
        return phrases.to_numpy().astype(np.uint64)
    return np.fromiter((xxhash.xxh64_intdigest(name.encode()) for name in phrases.to_pylist()), np.uint64, len(phrases))


def _short(mixed: np.ndarray) -> np.ndarray:
    """HASH_BITS bits of numbers of 64."""
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(by)
    return ((mixed ^ (mixed >> np.uint64(33))) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _words_seen(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """Hashes and lengths of a segment's words, and what gives the names of some."""
    names = batch.column("phrases")[i].values
    return _short(_hashes(names)), batch.column("lens")[i].values.to_numpy(), lambda some: names.take(pa.array(some))


def _longer_seen(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]:
    """The same of the phrases of one word more. A phrase is known by its first and its last part."""
    phrases, lens, places = (batch.column(c)[i].values if c != "places" else batch.column(c)[i] for c in ("phrases", "lens", "places"))
    a, b, counts, _ = extend(lens.to_numpy(), _unpacked(places.as_py()))
    own = _hashes(phrases)
    return _short(own[a] * np.uint64(0x9E3779B97F4A7C15) + own[b]), counts, lambda some: _longer_names(phrases, a[some], b[some])


def _bounds(ranges: int, bits: int) -> np.ndarray:
    """Where each range of hashes of so many bits starts, and where the last ends."""
    return np.arange(ranges + 1, dtype=np.int64) * (1 << bits) // ranges


def _spans(hashes: np.ndarray, ranges: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of rising hashes, and where in it each range starts and ends."""
    order = np.argsort(hashes, kind="stable")
    return order, np.searchsorted(hashes[order], _bounds(ranges, bits))


def _sketched(seen: Callable, ranges: int, least: int, batches: Iterator[pa.RecordBatch], bits: int | None = None) -> Iterator[pa.RecordBatch]:
    """For each range the hashes of a segment's phrases and their lengths, of which more than `least` counts as that."""
    bits = bits or HASH_BITS
    starts = _bounds(ranges, bits)
    for batch in batches:
        for i in range(batch.num_rows):
            hashes, counts, _ = seen(batch, i)
            hashes = hashes >> (HASH_BITS - bits)
            order, ends = _spans(hashes, ranges, bits)
            hashes, counts = hashes[order], np.minimum(counts[order], least)
            rows = []
            for span in np.flatnonzero(np.diff(ends)).tolist():
                at = slice(ends[span], ends[span + 1])
                rows.append((span, _packed(hashes[at] - starts[span]), _squeezed(counts[at])))
            if rows:
                spans, packed, lens = zip(*rows, strict=True)
                columns = [pa.array([batch.column(c)[i].as_py()] * len(rows), t) for c, t in (("seg", pa.int64()), ("lang", pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.int32()), pa.array(packed, pa.binary()), pa.array(lens, pa.binary())], names=["seg", "lang", "span", "hashes", "lens"])


def _marked(least: int, sketches: pa.Table) -> pa.Table:
    """Of one range: a bit for each phrase of each segment, whether the lengths of all with its hash come to `least`."""
    parts = [_unpacked(x) for x in sketches.column("hashes").to_pylist()]
    counts = np.concatenate([_opened(x) for x in sketches.column("lens").to_pylist()])
    hashes = np.concatenate(parts)
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.diff(hashes[order], prepend=np.int32(-1)))
    enough = np.add.reduceat(counts[order], first, dtype=np.int64) >= least
    marks = np.empty(len(hashes), bool)
    marks[order] = np.repeat(enough, np.diff(np.append(first, len(hashes))))
    own = np.split(marks, np.cumsum([len(p) for p in parts])[:-1])
    bits = [pa.compress(np.packbits(m).tobytes(), codec="zstd", asbytes=True) if m.any() else None for m in own]
    out = pa.table({"seg": sketches.column("seg"), "span": sketches.column("span"), "bits": pa.array(bits, pa.binary())})
    return out.filter(out.column("bits").is_valid())


def _counted(seen: Callable, ranges: int, batches: Iterator[pa.RecordBatch], bits: int | None = None) -> Iterator[pa.RecordBatch]:
    """The marked phrases of a segment, how often it holds them, their ranges and their places among its phrases."""
    bits = bits or HASH_BITS
    for batch in batches:
        for i in range(batch.num_rows):
            hashes, counts, names_of = seen(batch, i)
            hashes = hashes >> (HASH_BITS - bits)
            order, ends = _spans(hashes, ranges, bits)
            kept = []
            for mark in batch.column("marks")[i].as_py():
                start, stop = ends[mark["span"]], ends[mark["span"] + 1]
                own = pa.decompress(mark["bits"], decompressed_size=int(stop - start + 7) // 8, codec="zstd", asbytes=True)
                kept.append(order[start:stop][np.unpackbits(np.frombuffer(own, np.uint8), count=int(stop - start)).view(bool)])
            kept = np.sort(np.concatenate(kept))
            for at in range(0, len(kept), AT_ONCE):
                some = kept[at : at + AT_ONCE]
                span = np.searchsorted(_bounds(ranges, bits), hashes[some], side="right") - 1
                columns = [pa.array([batch.column(c)[i].as_py()] * len(some), t) for c, t in (("seg", pa.int64()), ("lang", pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, names_of(some), pa.array(counts[some], pa.int64()), pa.array(span), pa.array(some)], names=["seg", "lang", "phrase", "n", "span", "at"])


def _packed_keys(keys: pa.Array) -> bytes:
    """Names, which have no spaces, or pairs of numbers, the first of which rise."""
    if not pa.types.is_integer(keys.type):
        names = " ".join(keys.to_pylist()).encode()
        return len(names).to_bytes(8, "little") + pa.compress(names, codec="zstd", asbytes=True)
    first, last = np.divmod(keys.to_numpy(), 1 << 32)
    first = _packed(first)
    return len(first).to_bytes(8, "little") + first + _squeezed(last)


def _names(packed: bytes) -> list[str]:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True).decode().split(" ")


def _pairs(packed: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(packed[:8], "little")
    return _unpacked(packed[8:cut]).astype(np.int64) << 32 | _opened(packed[cut:])


def _dealt(seen: Callable, ranges: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `_counted` gives, a row for each range of hashes."""
    for counted in _counted(seen, ranges, batches, bits):
        span = counted.column("span").to_numpy()
        order = np.argsort(span, kind="stable")
        span, keys = span[order], counted.column("phrase").take(pa.array(order))
        n, at = (counted.column(c).to_numpy()[order] for c in ("n", "at"))
        first = np.flatnonzero(np.diff(span, prepend=-1)).tolist()
        rows = [(_packed_keys(keys[x:y]), _packed(at[x:y]), _squeezed(n[x:y])) for x, y in zip(first, [*first[1:], len(span)], strict=True)]
        columns = [counted.column(c).slice(0, len(rows)) for c in ("seg", "lang")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(span[first], pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))], names=["seg", "lang", "span", "keys", "at", "lens"])


def _summed(words: bool, ranges: int, least: int, counts: pa.Table) -> pa.Table:
    """Of one range: the frequent phrases with their numbers, and places and numbers of those that each segment holds."""
    packed, span = counts.column("keys").to_pylist(), counts.column("span")[0].as_py()
    n = [_opened(x) for x in counts.column("lens").to_pylist()]
    if words:
        keys = pa.array([name for x in packed for name in _names(x)], pa.string()).dictionary_encode()
        keys, which = keys.dictionary, keys.indices.to_numpy()
    else:
        keys, which = np.unique(np.concatenate([_pairs(x) for x in packed]), return_inverse=True)
    order = np.argsort(which, kind="stable")
    sums = np.add.reduceat(np.concatenate(n)[order], np.flatnonzero(np.diff(which[order], prepend=-1)), dtype=np.int64)
    common = np.flatnonzero(sums >= least)
    common = common[np.argsort(-sums[common], kind="stable")]
    numbers = np.full(len(sums), -1, np.int64)
    numbers[common] = np.arange(len(common)) * ranges + span
    if numbers.max() >= MOST:
        raise OverflowError(f"a language has more than {MOST} frequent phrases of a length")
    rows, end = [], 0
    for seg, at, size in zip(counts.column("seg").to_pylist(), counts.column("at").to_pylist(), map(len, n), strict=True):
        own = numbers[which[end : end + size]]
        end += size
        if (own >= 0).any():
            rows.append((seg, _packed(_unpacked(at)[own >= 0]), _squeezed(own[own >= 0])))
    seg, at, numbers_of = zip(*rows, (None, None, None), strict=True)
    nothing = pa.nulls(len(common))
    named = [keys.take(pa.array(common)), nothing.cast(pa.int64())] if words else [nothing.cast(pa.string()), pa.array(keys[common])]
    own = pa.StructArray.from_arrays([pa.array(numbers[common]), pa.array(sums[common]), *named], fields=list(_OWN))
    own = pa.ListArray.from_arrays(pa.array([0] * len(rows) + [0, len(own)], pa.int32()), own)
    return pa.Table.from_arrays([pa.array(seg, pa.int64()), pa.array(at, pa.binary()), pa.array(numbers_of, pa.binary()), pa.array([counts.column("lang")[0].as_py()] * len(seg)), own], schema=_FOUND)


def _kept(words: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a segment's frequent words, or of its frequent phrases of one word more."""
    for batch in batches:
        for i in range(batch.num_rows):
            seg, lang, lens, places, back = (batch.column(c)[i] for c in ("seg", "lang", "lens", "places", "back"))
            lens, places = lens.values.to_numpy(), _unpacked(places.as_py())
            if not words:
                _, _, lens, places = extend(lens, places)
            at = np.concatenate([_unpacked(x) for x in back.values.field("at").to_pylist()])
            numbers = np.concatenate([_opened(x) for x in back.values.field("numbers").to_pylist()])
            numbers, lens, places = _chosen(lens, places, at, numbers)
            yield _frame(_LISTS, seg.as_py(), lang.as_py(), numbers.astype(np.int64), lens.astype(np.int32), _packed(places))


def _found(lists: DataFrame, words: bool, ranges: int, bits: int, least: int, name: str) -> DataFrame:
    """FOUND of the words of the lists, or of the phrases of one word more: by hash first, then those that this leaves."""
    seen, columns = (_words_seen, ["seg", "lang", "phrases", "lens"]) if words else (_longer_seen, ["seg", "lang", "phrases", "lens", "places"])

    def marked(sketches: pa.Table) -> pa.Table:
        return _marked(least, sketches)

    def summed(counts: pa.Table) -> pa.Table:
        return _summed(words, ranges, least, counts)

    own = lists.select(*columns)
    sketches = own.mapInArrow(functools.partial(_sketched, seen, ranges, least, bits=bits), SKETCHES)
    marks = sketches.groupBy("lang", "span").applyInArrow(marked, MARKS)
    marks = marks.groupBy("seg").agg(F.collect_list(F.struct("span", "bits")).alias("marks"))
    counts = own.join(marks, "seg").mapInArrow(functools.partial(_dealt, seen, ranges, bits), COUNTS)
    return scratch(counts.groupBy("lang", "span").applyInArrow(summed, FOUND), name)


def _narrowed(lists: DataFrame, found: DataFrame, words: bool) -> DataFrame:
    """The segments' lists of what was found."""
    back = found.where(F.col("seg").isNotNull()).groupBy("seg").agg(F.collect_list(F.struct("at", "numbers")).alias("back"))
    return lists.join(back, "seg").mapInArrow(functools.partial(_kept, words), LISTS)


def _named(found: DataFrame, parts: DataFrame | None, name: str) -> DataFrame:
    """lang, number, phrase, last (its last word), a, lefts, rights of the phrases found; parts: the same of one word less."""
    own = found.where(F.col("seg").isNull()).select("lang", F.explode("own").alias("it"))
    if parts is None:
        none = F.array().cast("array<long>")
        return scratch(own.select("lang", "it.number", F.col("it.word").alias("phrase"), F.col("it.word").alias("last"), "it.a", none.alias("lefts"), none.alias("rights")), name)
    own = own.select("lang", "it.number", "it.a", F.shiftright("it.pair", 32).alias("left"), F.col("it.pair").bitwiseAND((1 << 32) - 1).alias("right"))
    left = parts.select("lang", F.col("number").alias("left"), F.col("phrase").alias("start"), F.array_append("lefts", F.col("a")).alias("lefts"))
    right = parts.select("lang", F.col("number").alias("right"), "last", F.array_prepend("rights", F.col("a")).alias("rights"))
    return scratch(own.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select("lang", "number", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "a", "lefts", "rights"), name)


def by_segment(lists: DataFrame, path: str) -> DataFrame:
    """lists written to the shared folder in buckets of segments, so that what comes back to the segments moves to the lists
    and not these to it. The catalog forgets the table at once; its files go when no later level reads them."""
    spark = lists.sparkSession
    made = f"lineloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists.write.bucketBy(buckets, "seg").option("path", path).saveAsTable(made)
    kept = spark.table(made)
    kept.schema  # resolved while the catalog knows it
    spark.sql(f"DROP TABLE {made}")
    return kept


def candidates(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(candidates, totals): lang, phrase, words, a, lefts, rights of every phrase of 2 to `longest` words that occurs `least`
    times or more, and lang, n (words in all).

    lefts[k - 1] is the frequency of the first k words, rights[k - 1] that of the rest. A null text is empty, a null language
    is `und`. Other columns, ids among them, play no part; repeated rows count each time. Empty tables give empty results.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = docs.sparkSession
    path = scratch_path(spark, "postings")
    lists = by_segment(texts.mapInArrow(_segments, POSTINGS), path)
    sizes = lists.groupBy("lang").agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda all, n: all + n)).alias("n"), F.count("*").alias("segments"))
    sizes = scratch(sizes, "sizes")
    most, segments = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("segments"), F.lit(0))).first()
    ranges = max(RANGES, 1 << (segments // SEGMENTS_A_RANGE).bit_length())
    bits = min(HASH_BITS, max(16, (most // WORDS_A_HASH).bit_length()))
    named, longer = None, []
    for k in range(1, longest + 1):
        found = _found(lists, k == 1, ranges, bits, least, f"found-{k}")
        named = _named(found, named, f"named-{k}")
        if k > 1:
            longer.append(named.select("lang", "phrase", F.lit(k).alias("words"), "a", "lefts", "rights"))
        if k < longest:
            before, path = path, scratch_path(spark, f"lists-{k}")
            lists = by_segment(_narrowed(lists, found, k == 1), path)
            discard(spark, before)
    return functools.reduce(DataFrame.unionAll, longer), sizes.select("lang", "n")


def not_inside(found: DataFrame) -> DataFrame:
    """Candidates that do not lie inside a longer one of the same frequency.

    A part is never rarer than the whole, so a candidate inside a much longer one of its frequency is also inside one that is a
    word longer: each candidate names its two parts of one word less, if they are as frequent.
    """
    k = F.col("words") - 1
    longer = found.where(F.col("words") > 2)
    first = longer.where(F.col("a") == F.get("lefts", k - 1)).select("lang", F.expr("substring_index(phrase, ' ', words - 1)").alias("phrase"))
    rest = longer.where(F.col("a") == F.get("rights", F.lit(0))).select("lang", F.expr("substring_index(phrase, ' ', 1 - words)").alias("phrase"))
    return found.join(first.unionAll(rest), ["lang", "phrase"], "left_anti")


def _exact(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).cast("decimal(19,0)")


def best(found: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` of each language by score, frequency (both descending) and phrase.

    The score of a cut is floor(1000 a n / (l r)) in decimals of 38 digits; the lowest counts, of equal ones the first.
    A language's rows are ranked in SALTS parts first, of which each gives `top` at most.
    """
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    dealt = found.withColumn("salt", salt.cast("int")).repartition("lang", "salt")
    sizes = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    scored = dealt.join(sizes.hint("shuffle_hash"), ["lang", "salt"])
    scored = scored.withColumn("over", F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n"))
    cuts = F.transform("lefts", lambda left, i: F.struct(F.call_function("div", F.col("over"), _exact(left) * _exact(F.get("rights", i))).alias("score"), i.alias("cut"), left.alias("l"), F.get("rights", i).alias("r")))
    scored = scored.select("lang", "salt", "phrase", "a", "n", F.array_min(cuts).alias("cut")).select("lang", "salt", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The best collocations of each language; see `candidates` and `best`."""
    found, totals = candidates(docs, text_col, lang_col, least, longest)
    return best(not_inside(found), totals, top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents."""
    return mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, words FROM (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]'), lambda w: w <> '') AS words FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents))
  WHERE len(words) > 0),
totals AS (SELECT lang, sum(len(words))::HUGEINT AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, k AS words, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f
  FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
found AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS parts FROM grams WHERE words > 1),
cuts AS (SELECT lang, phrase, words, a, unnest(range(1, words)) AS k, parts FROM found),
scored AS (
  SELECT c.lang, c.phrase, c.words, a, k, l.f AS l, r.f AS r, n, 1000 * a * n // (l.f * r.f) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(parts[1:k], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(parts[k+1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT f.lang, array_to_string(f.parts[s : s + m - 1], ' ') AS phrase, f.a
  FROM found f, (SELECT unnest(range(2, 5)) AS m) s1, (SELECT unnest(range(1, 5)) AS s) s2
  WHERE m < f.words AND s + m - 1 <= f.words)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest w
WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = w.lang AND i.phrase = w.phrase AND 100 * i.a >= 100 * w.a)
QUALIFY rank <= 2000
"""
