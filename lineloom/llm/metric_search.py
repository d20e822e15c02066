"""Exact top-k inner products by M-trees.

With every vector lifted by one coordinate to the same length, the largest inner product is the smallest distance, so
metric trees can answer it: |q - v'|^2 = |q|^2 + M^2 - 2 q.v, where M is the largest norm of all. Vectors are dealt to the
nearest of at most PIVOTS sampled ones, so that a region is a ball; a region of more than TREE_ROWS vectors (copies, or a
dense place) is dealt by a hash to several trees. A tree holds its vectors in leaf pages under routing pages, each entry
with its covering radius and its distance to the parent's centre. A query visits pages best first; an entry whose stored
parent distance already rules it out by the triangle inequality has no distance computed, and a page is left out when even
the nearest point of its ball is farther than the k-th best so far. Bounds are widened by a rounding margin and scores are
whole numbers, so the answer is exact.

Queries go in blocks of bounded size to where the trees are; no tree moves. Each query first meets the trees of its own
region; its k-th score there is a bound, with which it then enters only the trees whose ball can hold a better one.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lineloom.llm.common import scratch, table

PAGE = 128
FANOUT = 16
TREE_ROWS = 8192
#: Rows of a region, about, until there are PIVOTS of them.
REGION_ROWS = 4096
#: Sampled vectors that are broadcast, at most.
PIVOTS = 1024
#: Queries of a block, and their components.
QUERY_ROWS = 16384
QUERY_NUMBERS = 1 << 22
SCALE = 256
_LONG_MIN, _LONG_MAX = -(1 << 63), (1 << 63) - 1


@dataclass
class Space:
    """How vectors are lifted: all are divided by `unit` and filled up to `width`, and end with the norm `top`."""

    width: int
    unit: float
    top: float

    def whole(self, values: list[list[float]]) -> np.ndarray:
        """floor(SCALE * x), a row each."""
        x = np.zeros((len(values), self.width))
        for i, v in enumerate(values):
            x[i, : len(v)] = v
        with np.errstate(over="ignore"):
            return np.floor(np.minimum(np.maximum(SCALE * x, -1.7e308), 1.7e308))

    def lifted(self, whole: np.ndarray, query: bool = False) -> np.ndarray:
        v = whole / self.unit
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, self.top**2 - np.einsum("ij,ij->i", v, v)))
        return np.hstack([v, rest[:, None]])


def exact(whole: np.ndarray) -> bool:
    """Whether all products of such vectors fit the 53 bits of a float."""
    return whole.shape[1] * 2.0**40 < 2.0**53 and bool((np.abs(whole) < 2**20).all())


@dataclass
class Node:
    """A page. Entry i of a routing page is child i; entry i of a leaf is a vector."""

    centre: np.ndarray
    radius: float
    children: list[Node] | None
    rows: np.ndarray | None
    #: Each entry's distance to this page's centre, and its radius.
    to_centre: np.ndarray
    radii: np.ndarray


class MTree:
    """Bulk-loaded M-tree over lifted vectors."""

    def __init__(self, ids: np.ndarray, whole: np.ndarray, space: Space):
        """whole: whole numbers as float64, a row each."""
        self.ids, self.whole, self.space = ids, whole, space
        self.exact = exact(whole)
        self.lifted = space.lifted(whole)
        #: Vectors whose score was computed, over all searches.
        self.scored = 0
        self.root = self._build(np.arange(len(ids)))

    def __getstate__(self) -> dict:
        """Lifted vectors are made again; whole numbers travel in the least type that holds them."""
        small = bool((np.abs(self.whole) < 2**31).all())
        return self.__dict__ | {"lifted": None, "whole": self.whole.astype(np.int32) if small else self.whole}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.whole = self.whole.astype(np.float64)

    def _build(self, rows: np.ndarray) -> Node:
        points = self.lifted[rows]
        centre = points.mean(axis=0)
        if len(rows) <= PAGE:
            away = np.linalg.norm(points - centre, axis=1)
            return Node(centre, float(away.max(initial=0.0)), None, rows, away, np.zeros(len(rows)))
        # Halves across the direction of the two far points, as often as the fan-out wants: balanced, also for copies.
        parts = [rows]
        while len(parts) < FANOUT and len(max(parts, key=len)) > PAGE:
            parts.sort(key=len)
            part = parts.pop()
            p = self.lifted[part]
            a = p[np.argmax(((p - p.mean(axis=0)) ** 2).sum(axis=1))]
            b = p[np.argmax(((p - a) ** 2).sum(axis=1))]
            order = np.argsort(p @ (b - a), kind="stable")
            parts += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        children = [self._build(p) for p in parts]
        radii = np.array([c.radius for c in children])
        away = np.linalg.norm(np.stack([c.centre for c in children]) - centre, axis=1)
        radius = min(float((away + radii).max()), float(np.linalg.norm(points - centre, axis=1).max()))
        return Node(centre, radius, children, None, away, radii)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> list[int]:
        """Inner products, those beyond a long at its ends."""
        self.scored += len(rows)
        if self.exact and exact(query[None, :]):
            return (self.whole[rows] @ query).astype(np.int64).tolist()
        q = [int(x) for x in query.tolist()]
        return [min(_LONG_MAX, max(_LONG_MIN, sum(int(a) * b for a, b in zip(v, q, strict=True)))) for v in self.whole[rows].tolist()]

    def search(self, query: np.ndarray, own: int | None, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) with id other than `own`, ties to the smaller id; none below `least`, if that is given."""
        space = self.space
        lifted = space.lifted(query[None, :], query=True)[0]
        margin = 1e-6 * (1.0 + float(np.linalg.norm(lifted)) + space.top)
        base = float(lifted @ lifted) + space.top**2
        best: list[tuple[int, int]] = []  # (score, -id), worst first
        floor = least

        def reach() -> float:
            # Scores at the lower end of a long may stand for any smaller one.
            if floor is None or floor == _LONG_MIN:
                return np.inf
            return max(0.0, base - 2.0 * (floor / space.unit / space.unit)) ** 0.5 + margin

        limit = reach()
        d = float(np.linalg.norm(lifted - self.root.centre))
        pages = [(max(0.0, d - self.root.radius), 0, d, self.root)]
        serial = 1
        while pages:
            nearest, _, d, node = heapq.heappop(pages)
            if nearest > limit:
                break
            near = np.flatnonzero(np.abs(d - node.to_centre) - node.radii <= limit)
            if node.rows is not None:
                rows = node.rows[near]
                for s, i in zip(self.scores(rows, query), self.ids[rows].tolist(), strict=True):
                    if i == own or floor is not None and s < floor:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                    else:
                        continue
                    if len(best) == k and (floor is None or best[0][0] > floor):
                        floor = best[0][0]
                limit = reach()
                continue
            if not len(near):
                continue
            to = np.linalg.norm(np.stack([node.children[i].centre for i in near]) - lifted, axis=1)
            for i, away in zip(near.tolist(), to.tolist(), strict=True):
                child = node.children[i]
                if away - child.radius <= limit:
                    heapq.heappush(pages, (max(0.0, away - child.radius), serial, away, child))
                    serial += 1
        return [(s, -i) for s, i in sorted(best, reverse=True)]


_FOUND = "query long, query_id long, vec_id long, score long"


def _search(trees: DataFrame, asked: Broadcast, k: int, home: bool) -> DataFrame:
    """(query, query_id, vec_id, score) of the queries (id, components, region, least score) that are at home in a
    tree's region, or else of all others."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, regions, floors = asked.value
        whole = None
        for batch in batches:
            for place, pages in zip(batch.column("region").to_pylist(), batch.column("pages"), strict=True):
                if not ((regions == place) if home else (regions != place)).any():
                    continue
                tree = pickle.loads(pages.as_py())
                whole = tree.space.whole(values) if whole is None else whole
                rows = []
                for n in np.flatnonzero(regions == place if home else regions != place).tolist():
                    rows += [(n, ids[n], i, s) for s, i in tree.search(whole[n], ids[n], k, floors[n])]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "vec_id", "score"])

    return trees.select("region", "pages").mapInArrow(found, _FOUND)


def _blocks(asked: DataFrame, size: int) -> Iterator[list[Row]]:
    """The queries in blocks of bounded size; the driver holds one at a time."""
    held: list[Row] = []
    numbers = 0
    for row in asked.toLocalIterator():
        held.append(row)
        numbers += len(row["v"])
        if len(held) >= size or numbers >= QUERY_NUMBERS:
            yield held
            held, numbers = [], 0
    if held:
        yield held


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS, region_rows: int = REGION_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products of floor(256 * x).

    Ids are whole numbers. Rows with a null id, a null vector or a null, NaN or infinite component take no part. A query's
    own id is no candidate; all candidates come if there are fewer than k, and none from an empty table. Ties go to the
    smaller id; rows that repeat an id are candidates of their own, and queries of their own if their vectors differ.
    Shorter vectors count as filled up with zeros. Scores beyond a long stop at its ends. Other columns are not carried.
    A region of any size is spread over trees by a hash of its rows, so a common vector is spread like any other.
    """
    spark = vectors.sparkSession
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)

    def most(unit: float) -> F.Column:
        return F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + F.pow((F.abs(x) * SCALE + 1) / unit, F.lit(2.0))))

    mine, asked = clean(vectors), clean(queries).distinct()
    width = F.size("v")
    total = mine.agg(F.count("*").alias("n"), F.max(width).alias("w"), F.max(F.array_max(F.transform("v", F.abs))).alias("top"), most(1.0).alias("norm")).first()
    largest = asked.agg(F.max(width).alias("w"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not total["n"] or largest["w"] is None:
        return empty
    unit = max(1.0, min(1.7e308, SCALE * max(total["top"] or 0.0, largest["top"] or 0.0)))
    norm = total["norm"] / unit / unit if unit < 1e100 and np.isfinite(total["norm"]) else mine.agg(most(unit)).first()[0]
    space = Space(max(total["w"], largest["w"]), unit, float(np.sqrt(norm)) * (1 + 1e-9))

    # Pivots: a bounded sample by hash, each vector once.
    wanted = min(PIVOTS, -(-total["n"] // region_rows), max(1, (QUERY_NUMBERS // max(1, space.width))))
    sampled = mine.orderBy(F.xxhash64("v", F.lit(5)), "id").limit(4 * wanted).select("v").collect()
    pivots = space.lifted(space.whole([list(v) for v in dict.fromkeys(tuple(r["v"]) for r in sampled)][:wanted]))
    centres = spark.sparkContext.broadcast((space, pivots))

    def placed(values: list[list[float]], held: tuple[Space, np.ndarray], query: bool = False) -> np.ndarray:
        lifted = held[0].lifted(held[0].whole(values), query)
        return np.argmin((held[1] ** 2).sum(axis=1)[None, :] - 2.0 * (lifted @ held[1].T), axis=1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = placed(batch.column("v").to_pylist(), centres.value) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region.astype(np.int32))], names=["id", "v", "region"])

    def built(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        held = centres.value[0]
        tree = MTree(ids[order], held.whole(group.column("v").take(pa.array(order)).to_pylist()), held)
        return pa.table({"region": pa.array([group.column("region")[0].as_py()], pa.int32()), "pages": pa.array([pickle.dumps(tree)], pa.binary())})

    # A row's number is part of the deal, so rows wholly alike are spread too.
    rows = scratch(mine.mapInArrow(dealt, "id long, v array<double>, region int").withColumn("n", F.monotonically_increasing_id()), "regions")
    sizes = {r["region"]: r["count"] for r in rows.groupBy("region").count().collect()}
    shares = F.create_map(*[F.lit(x) for r, n in sorted(sizes.items()) for x in (r, -(-n // tree_rows))])
    trees = rows.groupBy("region", F.pmod(F.xxhash64("n"), shares[F.col("region")]).alias("share")).applyInArrow(built, "region int, pages binary")
    trees = scratch(trees, "trees")

    out = None
    for serial, block in enumerate(_blocks(asked, query_rows)):
        ids, values = [r["id"] for r in block], [list(r["v"]) for r in block]
        regions = placed(values, (space, pivots), query=True)
        first = scratch(_search(trees, spark.sparkContext.broadcast((ids, values, regions, [None] * len(ids))), k, home=True), "home")
        kth = Window.partitionBy("query").orderBy(F.desc("score"))
        floors: list[int | None] = [None] * len(ids)
        for r in first.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select("query", "score").collect():
            floors[r["query"]] = r["score"]
        rest = _search(trees, spark.sparkContext.broadcast((ids, values, regions, floors)), k, home=False)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        best = first.unionAll(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        best = scratch(best, f"found-{serial}") if out is not None or len(ids) >= query_rows else best
        out = best if out is None else out.unionAll(best)
    return out


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
