"""The search against brute force, and that its bounds leave vectors out."""

import numpy as np

from lineloom.llm import metric_search
from lineloom.llm.metric_search import MTree, Space


def brute(ids, whole, q, own, k):
    return sorted(((int(s), int(i)) for s, i in zip(whole @ q, ids, strict=True) if i != own), key=lambda x: (-x[0], x[1]))[:k]


def clustered(r, clusters=30, each=100, width=16):
    centres = r.normal(size=(clusters, width)) * 20
    return np.floor(256 * np.concatenate([c + r.normal(size=(each, width)) * 0.2 for c in centres]))


def space_of(whole):
    unit = float(np.abs(whole).max())
    return Space(whole.shape[1], unit, float(np.sqrt(((whole / unit) ** 2).sum(axis=1).max())) * (1 + 1e-9))


def test_search_of_clusters_leaves_most_vectors_out():
    r = np.random.default_rng(1)
    whole = clustered(r)
    tree = MTree(np.arange(len(whole)), whole, space_of(whole))
    for n in range(0, len(whole), 30):
        assert tree.search(whole[n], n, 5) == brute(tree.ids, whole, whole[n], n, 5)
    assert tree.scored < 0.4 * len(whole) * (len(whole) / 30)
    scored, least = tree.scored, brute(tree.ids, whole, whole[7], 7, 5)[-1][0]
    assert tree.search(whole[7], 7, 5, least) == brute(tree.ids, whole, whole[7], 7, 5)
    assert tree.scored - scored < len(whole) // 2 and tree.search(whole[7], 7, 5, 1 << 60) == []


def test_a_ball_too_far_is_not_entered():
    r = np.random.default_rng(2)
    whole = clustered(r)
    space = space_of(whole)
    near, far = MTree(np.arange(100), whole[:100], space), MTree(np.arange(100, 200), whole[100:200], space)
    q = whole[3]
    least = near.search(q, 3, 5)[-1][0]
    if brute(far.ids, whole[100:200], q, 3, 1)[0][0] < least:
        far.search(q, 3, 5, least)
        assert far.scored == 0


def test_ties_copies_and_random_vectors():
    r = np.random.default_rng(3)
    for width, size in ((1, 40), (3, 700), (8, 700)):
        whole = np.floor(r.normal(size=(size, width)) * 3)
        whole[size // 2 :] = whole[0]
        ids = r.permutation(size)
        tree = MTree(ids, whole, space_of(whole))
        for n in range(0, size, 13):
            assert tree.search(whole[n], ids[n], 7) == brute(ids, whole, whole[n], ids[n], 7)


def test_regions_copies_and_blocks(spark):
    r = np.random.default_rng(4)
    values = (clustered(r, clusters=8, each=60, width=6) / 256).tolist()
    rows = [(i, v) for i, v in enumerate(values)] + [(1000 + i, values[0]) for i in range(200)] + [(7, values[7])] * 150 + [(50, None), (None, values[1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = metric_search.top_k(frame, frame.where("vec_id % 50 = 0"), tree_rows=64, query_rows=7, region_rows=64).collect()
    clean = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v is not None]
    ids, whole = np.array([i for i, _ in clean]), np.stack([v for _, v in clean])
    want = [(q, k + 1, i, s) for q in sorted({i for i in ids.tolist() if i % 50 == 0}) for k, (s, i) in enumerate(brute(ids, whole, whole[ids.tolist().index(q)], q, 5))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_tables_and_few_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0])], "vec_id long, embedding array<double>")
    got = metric_search.top_k(frame, frame)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == [(0, 1, 50, 3 * 65536), (50, 1, 0, 3 * 65536)]
    assert metric_search.top_k(frame.limit(0), frame).count() == 0 == metric_search.top_k(frame, frame.limit(0)).count()
