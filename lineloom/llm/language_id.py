"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's 1- to 3-grams by frequency. A document's most frequent n-grams are compared with each
profile by how far out of place they stand; the language with the least total wins. N-grams are numbers (21 bits a
character), so counting is sorting arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import appended, table, with_columns, without

#: n-grams of a document, and of a language.
DOC_GRAMS = 400
PROFILE_GRAMS = 3000
#: Labelled documents that profiles are learned from, at most (about; chosen by hash).
TRAIN_DOCS = 20_000
UNKNOWN = "und"
#: Range of the hash that samples are chosen by.
_HASHES = 1_000_000_000
_STEP = 1 << 20
_BITS = np.int64(21)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as numbers, each run of anything else as 1, with a 1 at either end."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    c[~_letters()[c]] = 1
    c = np.concatenate(([1], c, [1]))
    return c[(c != 1) | np.concatenate(([True], c[:-1] != 1))]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of a whole text with their counts; grams without a letter are left out."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = np.zeros(0, np.int64)
    text = text or ""
    for at in range(0, len(text), _STEP):
        c = _codes(text[at : at + _STEP])
        if len(tail):  # grams over the border; a run of other characters at it stays one
            c = c[1:] if len(c) > 1 else c
            tail = tail[:-1] if len(tail) and tail[-1] == 1 else tail
        new = len(tail)
        c = np.concatenate((tail, c))
        one, two = c[new:], (c[:-1] << _BITS | c[1:])[max(0, new - 1) :]
        three = (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[max(0, new - 2) :] if len(c) > 2 else c[:0]
        found, n = np.unique(np.concatenate((one[one != 1], two, three)), return_counts=True)
        keys, place = np.unique(np.concatenate((keys, found)), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate((counts, n)), minlength=len(keys)).astype(np.int64)
        tail = c[-3:]
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent n-grams (ties to the lesser number) with their ranks from 0; of these, equal counts share
    the middle of their ranks."""
    order = np.lexsort((keys, -counts))[:most]
    keys, counts = keys[order], counts[order]
    _, first, n = np.unique(-counts, return_index=True, return_counts=True)
    return keys, np.repeat(first + (n - 1) / 2, n)


class Profiles:
    """Ranks of every learned n-gram in every language."""

    def __init__(self, rows: list[tuple[str, int, float]]):
        """rows: (language, n-gram, rank)."""
        self.langs = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({r[1] for r in rows}), np.int64)
        self.ranks = np.full((len(self.langs), len(self.keys)), float(PROFILE_GRAMS))
        at = {k: i for i, k in enumerate(self.keys.tolist())}
        of = {x: i for i, x in enumerate(self.langs)}
        for lang, key, rank in rows:
            self.ranks[of[lang], at[key]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 - its mean distance as a share of the largest; ties to the first by name."""
        keys, counts = grams(text)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        keys, ranks = ranked(keys, counts, DOC_GRAMS)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        theirs = np.where(known[None, :], self.ranks[:, at], float(PROFILE_GRAMS))
        away = np.minimum(np.abs(theirs - ranks[None, :]), PROFILE_GRAMS)
        away = np.where(theirs >= PROFILE_GRAMS, PROFILE_GRAMS, away).mean(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / PROFILE_GRAMS)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def quotas(counts: Mapping[str, int], most: int) -> dict[str, int]:
    """Rows to take of every label, at most `most` in all but one of each at least: an equal share, of which rare labels need less and leave the rest
    to the others."""
    out: dict[str, int] = {}
    left = most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - k)))
        left -= out[lang]
    return out


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most: int = TRAIN_DOCS) -> Profiles:
    """Profiles from labelled rows; rows with a null label take no part.

    Above `most` rows, a sample by hash of the id holds about that many: all rows of a rare language, of the others equal
    shares. Counts are added up on the executors and only the PROFILE_GRAMS first of each language reach the driver.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(counts.values()) > most:
        least = [(lang, -(-_HASHES * n // counts[lang])) for lang, n in quotas(counts, most).items()]
        bounds = rows.sparkSession.createDataFrame(least, "lang string, __bound long")
        rows = rows.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(_HASHES)) < F.col("__bound")).drop("__bound")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def merge(lang: str, parts: list) -> None:
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            held[lang] = keys, np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)

        for batch in batches:
            parts: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts.setdefault(lang, []).append(grams(text))
            for lang, p in parts.items():
                merge(lang, [held[lang], *p] if lang in held else p)
        for lang, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    from pyspark.sql import Window

    total = rows.select("lang", "text").mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    first = total.withColumn("r", place).where(F.col("r") <= PROFILE_GRAMS).collect()
    found = []
    for lang in sorted({r["lang"] for r in first}):
        own = [r for r in first if r["lang"] == lang]
        keys, ranks = ranked(np.array([r["gram"] for r in own], np.int64), np.array([r["n"] for r in own], np.int64), PROFILE_GRAMS)
        found += zip([lang] * len(own), keys.tolist(), ranks.tolist(), strict=True)
    return Profiles(found)


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score (0 to 1), from the whole text alone.

    A null text, or one without letters, is `und` with score 0, as is everything when nothing was learned. Repeated
    rows are judged alike; input columns named lang_pred or score are replaced, all others carried. No shuffle.
    """
    base = without(df, ["lang_pred", "score"])
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column(text_col)]
            yield with_columns(batch, {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})

    return base.mapInArrow(predicted, appended(base, "lang_pred string, score double"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, by profiles of the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
