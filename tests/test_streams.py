"""Streams with list state against the batch operators."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lineloom.operators import intake as I
from lineloom.streaming import rings as S

pytest.importorskip("google.protobuf")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Twelve days' worth of bursts a key, in three files that arrive one after the other."""
    r = random.Random(7)
    rows, at = [], {k: datetime(2024, 1, 1) for k in ("a", "b", None)}
    path = tmp_path_factory.mktemp("events")
    for part in range(3):
        for _ in range(60):
            k = r.choice(list(at))
            at[k] += r.choice([timedelta(seconds=r.randint(0, 200)), timedelta(seconds=600), timedelta(days=r.choice([0, 0, 3, 7]))])
            rows.append((k, len(rows), at[k], r.choice(["pass", "fail"]), r.random() < 0.3))
        spark.createDataFrame(rows[part * 60 :], "k string, i long, ts timestamp, outcome string, flake boolean").coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def streamed(spark, path, build, name, tmp):
    S.rocksdb(spark)
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = build(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp}/{name}-state").option("path", f"{tmp}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(f"{tmp}/{name}")


def test_sliding_limit_agrees_with_the_fold_at_ten_minutes(spark, events, tmp_path):
    got = streamed(spark, events, lambda e: S.sliding(e, "k", "ts", "i"), "sliding", tmp_path)
    rows = spark.read.parquet(events)
    want = I.fold(rows, "k", ["ts", "i"], F.unix_micros("ts") / 1e6, lambda: I.SlidingLog(5, 600), "allowed")
    pairs = sorted((x.i, x.allowed) for x in want.collect())
    assert sorted((x.i, x.allowed) for x in got.collect()) == pairs
    assert {a for _, a in pairs} == {True, False} and len(pairs) == 180


def test_rings_and_histories_agree(spark, events, tmp_path):
    build = lambda e: (e, "k", "ts", "i", F.col("outcome"), F.col("flake"))
    got = streamed(spark, events, lambda e: S.ring_stream(*build(e)), "rings", tmp_path)
    want = S.ring_batch(*build(spark.read.parquet(events)))
    plain = lambda df: sorted((x.i, x.ring, [round(h, 3) for h in x.history]) for x in df.collect())
    assert plain(got) == plain(want)
    assert max(len(x.ring) for x in want.collect()) == 10 and len({len(x.history) for x in want.collect()}) > 3


def test_rings_by_definition(spark, events):
    rows = sorted(spark.read.parquet(events).collect(), key=lambda x: (x.ts, x.i))
    want = {}
    for n, x in enumerate(rows):
        own = [y for y in rows[: n + 1] if y.k == x.k]
        want[x.i] = ([y.outcome for y in own][-10:], [y.ts for y in own if y.flake and y.ts > x.ts - timedelta(days=14)])
    got = S.ring_batch(spark.read.parquet(events), "k", "ts", "i", F.col("outcome"), F.col("flake"))
    zone = datetime(1970, 1, 1)
    assert {x.i: (x.ring, [zone + timedelta(seconds=h) for h in x.history]) for x in got.collect()} == want
