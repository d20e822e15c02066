"""SimHash near-duplicates, with candidates by the pigeonring principle.

Two fingerprints within 2 of 64 bits, cut into a ring of 8 segments of 8 bits, must have a start segment from which
every chain of l segments differs in at most l * 2 / 8 bits: the first three segments are equal, and the first seven
differ in one bit at most, so of segments 4-5 and 6-7 one pair is equal too. Three equal segments and an equal pair
make a 40-bit key; 8 starts and 2 pairs give 16 keys for each distinct fingerprint. Within a key the chain budgets are
checked first, then the full distance. Equal fingerprints are one node before keys are made, so that a key, which
fixes 40 bits, can hold 2**24 members at most, whatever the number of copies.

A key's members leave as a star (each linked member with the least of its links), not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm.common import scratch, table, text_key
from lineloom.llm.graph import components

MAX_BITS = 2
SEGMENTS = 8
WIDTH = 3
SEED = 42
#: Shingles whose bits are counted at once: bounds memory for very long texts.
STEP = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp) for each row: key is a 64-bit key of the text, fp the fingerprint as a signed long."""
    rows = df.select(F.col(id_col).alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(fps.view(np.int64))], names=["id", "key", "fp"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(hashed, f"id {id_type}, key long, fp long")


def ring_keys(nodes: DataFrame) -> DataFrame:
    """(bucket, turned) for each start and pair of each distinct fp; turned is fp rotated so that the start comes first."""
    made = []
    for s in range(SEGMENTS):
        fp = F.col("fp")
        turned = fp if s == 0 else F.shiftleft(fp, 8 * s).bitwiseOR(F.shiftrightunsigned(fp, 64 - 8 * s))
        first = F.shiftrightunsigned(turned, 24)
        second = F.shiftleft(F.shiftrightunsigned(turned, 40), 16).bitwiseOR(F.shiftrightunsigned(turned, 8).bitwiseAND(F.lit(0xFFFF)))
        made += [F.struct((F.lit((2 * s + h) << 40).bitwiseOR(key)).alias("bucket"), turned.alias("turned")) for h, key in ((0, first), (1, second))]
    return nodes.select(F.explode(F.array(*made)).alias("k")).select("k.bucket", "k.turned")


#: Differences that a key's members may have in the 24 bits that the key leaves open (low 24 bits in either layout).
_OPEN_MASKS = np.array([0, *(1 << i for i in range(24)), *((1 << i) | (1 << j) for i in range(24) for j in range(i))], dtype=np.uint64)


def within_budget(diff: np.ndarray) -> np.ndarray:
    """Chains from the first segment: segments 1-3 equal, 1-7 differ in one bit at most, then the full distance."""
    chain = np.bitwise_count(diff >> np.uint64(8)) <= (SEGMENTS - 1) * MAX_BITS // SEGMENTS
    return chain & ((diff >> np.uint64(40)) == 0) & (np.bitwise_count(diff) <= MAX_BITS)


def _spread(masks: np.ndarray, half: int) -> np.ndarray:
    """24 open bits at their places in a turned fingerprint: below the key, or around its pair."""
    if half == 0:
        return masks
    low, high = masks & np.uint64(0xFF), masks >> np.uint64(8)
    return low | (high << np.uint64(24))


def linked(members: np.ndarray, half: int) -> list[tuple[int, int]]:
    """Links (root index, member index) that join what the budgets join among a key's sorted, distinct members."""
    n = len(members)
    if n <= 256:
        a, b = np.nonzero(np.triu(within_budget(members[:, None] ^ members[None, :]), 1))
    else:
        masks = _spread(_OPEN_MASKS[1:], half)
        found = []
        for m in masks[within_budget(masks)]:
            to = members ^ m
            at = np.minimum(np.searchsorted(members, to), n - 1)
            hit = np.nonzero((members[at] == to) & (at > np.arange(n)))[0]
            found.append(np.stack([hit, at[hit]]))
        a, b = np.concatenate(found, axis=1)
    if not len(a):
        return []
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = top(i), top(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [(r, i) for i in range(n) if (r := top(i)) != i]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, members) of every bucket with two members or more, from rows sorted by bucket and member."""
    kept_b, kept_m = np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts: list[np.ndarray] = []  # of a bucket that goes on over whole batches
    for batch in batches:
        b, m = batch.column("bucket").to_numpy(zero_copy_only=False), batch.column("turned").to_numpy(zero_copy_only=False)
        if len(kept_b) and len(b) and b[0] == kept_b[0] and b[-1] == b[0]:
            parts.append(m)
            continue
        b = np.concatenate([kept_b, np.full(sum(map(len, parts)), kept_b[0] if len(kept_b) else 0, np.int64), b])
        m = np.concatenate([kept_m, *parts, m])
        parts = []
        if not len(b):
            continue
        cuts = np.concatenate(([0], np.nonzero(np.diff(b))[0] + 1))
        sizes = np.diff(np.concatenate((cuts, [len(b)])))
        for c, n in zip(cuts[:-1][sizes[:-1] > 1].tolist(), sizes[:-1][sizes[:-1] > 1].tolist(), strict=True):
            yield int(b[c]), m[c : c + n]
        kept_b, kept_m = b[cuts[-1] :], m[cuts[-1] :]
    m = np.concatenate([kept_m, *parts])
    if len(m) > 1:
        yield int(kept_b[0]), m


def _linked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for bucket, members in _runs(batches):
        turned = np.unique(members.view(np.uint64))
        start, half = divmod(bucket >> 40, 2)
        pairs = linked(turned, half)
        if not pairs:
            continue
        k = np.uint64(8 * start)
        fps = (((turned >> k) | (turned << (np.uint64(64) - k))) if start else turned).view(np.int64).tolist()
        a += [fps[i] for i, _ in pairs]
        b += [fps[j] for _, j in pairs]
        if len(a) >= 50_000:
            yield out()
            a, b = [], []
    yield out()


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) over distinct fp: enough links to join every two fingerprints within MAX_BITS."""
    return ring_keys(nodes).repartition("bucket").sortWithinPartitions("bucket", "turned").mapInArrow(_linked_runs, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp, component_id) for each row of df; component_id is the least id reachable over links.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. Rows with a null id take part
    and get their component's least id, null if it has none. Repeated rows each come out. Other columns are not
    carried. Fingerprints are computed once and kept in the shared folder (some 24 bytes a document).
    """
    rows = scratch(fingerprints(df, id_col, text_col), "fingerprints")
    nodes = scratch(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(links(nodes))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch(placed.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("id", "key", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of near-duplicates: its least id (nulls last, then the least text key)."""
    rows = near_duplicates(df, id_col, text_col)
    # A component without any id has a null component_id; its rows are told apart by fingerprint.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp"))]
    best = rows.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "key")).alias("b"))
    kept = scratch(best.select(F.col("b.id").alias("__id"), F.col("b.key").alias("__key")), "kept")
    keyed = df.withColumn("__k", text_key(text_col))
    out = keyed.join(kept, keyed[id_col].eqNullSafe(kept["__id"]) & (keyed["__k"] == kept["__key"]), "left_semi")
    again = rows.join(kept, rows["id"].eqNullSafe(kept["__id"]) & (rows["key"] == kept["__key"]), "left_semi")
    if again.groupBy("id", "key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, "__k"])
    return out.drop("__k")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
