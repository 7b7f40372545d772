"""Exact sizes, gapless slots, and the law of the matrix and of the whole shuffle against brute force."""

import itertools
import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandline.llm import sharding
from strandline.llm.sharding import digest, hypergeometric, log_probability, matrix, shard, split


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (1, 9, 10), (3, 0, 2), (40, 25, 33), (200, 3, 100)])
def test_probability(good, bad, draws):
    """Against exact fractions of whole numbers."""
    for x in range(-1, draws + 2):
        exact = math.comb(good, x) * math.comb(bad, draws - x) / math.comb(good + bad, draws) if 0 <= x <= draws and 0 <= draws - x <= bad and x <= good else 0
        assert math.isclose(math.exp(log_probability(x, good, bad, draws)), exact, rel_tol=1e-11, abs_tol=1e-300)


def test_probability_of_large_numbers():
    """Neighbours' ratio is exact arithmetic at any size."""
    good, bad, draws = 7 * 10**11, 3 * 10**12, 10**12
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    for x in (mode, mode + 10**5, mode - 10**6):
        ratio = (good - x) * (draws - x) / ((x + 1) * (bad - draws + x + 1))
        assert abs(log_probability(x + 1, good, bad, draws) - log_probability(x, good, bad, draws) - math.log(ratio)) < 1e-9


@pytest.mark.parametrize("good,bad,draws", [(5, 7, 4), (40, 25, 33), (3000, 9000, 4000)])
def test_draws(good, bad, draws):
    rng = np.random.default_rng(1)
    seen = Counter(hypergeometric(rng, good, bad, draws) for _ in range(20_000))
    chi = sum((seen[x] - e) ** 2 / e for x in range(draws + 1) if (e := 20_000 * math.exp(log_probability(x, good, bad, draws))) >= 5)
    cells = sum(20_000 * math.exp(log_probability(x, good, bad, draws)) >= 5 for x in range(draws + 1))
    assert chi < cells + 5 * math.sqrt(2 * cells)


def test_draws_of_large_numbers():
    """Mean and deviation at 10 ** 12."""
    rng = np.random.default_rng(2)
    good, bad, draws = 3 * 10**11, 7 * 10**11, 10**11
    x = np.array([hypergeometric(rng, good, bad, draws) for _ in range(4000)], float)
    mean, sd = draws * 0.3, math.sqrt(draws * 0.3 * 0.7 * (good + bad - draws) / (good + bad - 1))
    assert abs(x.mean() - mean) < 5 * sd / math.sqrt(4000) and abs(x.std() / sd - 1) < 0.06


def test_matrix_law():
    """Every table of the law with its probability, found by dealing all orders of the rows."""
    columns, rows = [2, 1, 2], [2, 2, 1]
    labels = [j for j, n in enumerate(columns) for _ in range(n)]
    edges = np.cumsum([0, *rows])
    exact = Counter(tuple(tuple(order[edges[i] : edges[i + 1]].count(j) for j in range(3)) for i in range(3)) for order in itertools.permutations(labels))
    total = sum(exact.values())
    rng = np.random.default_rng(5)
    seen = Counter(tuple(map(tuple, split(rng, columns, rows))) for _ in range(20_000))
    assert set(seen) <= set(exact)
    assert sum((seen[t] - e) ** 2 / e for t, n in exact.items() if (e := 20_000 * n / total)) < len(exact) + 5 * math.sqrt(2 * len(exact))


def test_matrix_of_many_groups(spark):
    """A tree of several levels over groups with gaps in their numbers: sums are kept, and a repetition draws the same."""
    counts = {i * 7: 1 + i % 5 for i in range(700)}
    groups = spark.createDataFrame(list(counts.items()), "node bigint, n bigint")
    total = sum(counts.values())
    sizes = [total // 5 + (i < total % 5) for i in range(5)]
    drawn = {r.node: r.columns for r in matrix(groups, sizes, 3, 7 * 699).collect()}
    assert {k: sum(v) for k, v in drawn.items()} == counts and np.array(list(drawn.values())).sum(0).tolist() == sizes
    assert drawn == {r.node: r.columns for r in matrix(groups.repartition(3), sizes, 3, 7 * 699).collect()}
    assert drawn != {r.node: r.columns for r in matrix(groups, sizes, 4, 7 * 699).collect()}


def test_matrix_work_is_linear():
    """Drawing for ten times the groups takes about ten times as long: 256 groups of 50,000 rows against 26."""
    def seconds(n):
        began = time.process_time()
        split(np.random.default_rng(0), [n * 50_000 // 24] * 23 + [n * 50_000 - 23 * (n * 50_000 // 24)], [50_000] * n)
        return time.process_time() - began

    seconds(10)
    assert seconds(256) < 25 * seconds(26)


def check(out, total, shards):
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == total
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_documents(spark, sf):
    df = digest(spark.read.parquet(f"{sf}/documents.parquet"))
    out = shard(df, 24).collect()
    check(out, df.count(), 24)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted(map(tuple, df.collect()))


def test_groups_and_ties(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 10)
    df = spark.createDataFrame([Row(doc_id=None if i % 50 == 0 else i % 7, text=None if i % 9 == 0 else "same", _at=1) for i in range(503)], "doc_id int, text string, _at int").repartition(5)
    check(shard(df, 4, seed=2).collect(), 503, 4)
    first = shard(df.coalesce(1).orderBy("doc_id", "text"), 4, seed=2)
    assert first.where("shard = 0").count() in (125, 126)


def test_clashing_names(spark):
    df = spark.createDataFrame([Row(Shard=i, slot="x", _slot=2) for i in range(50)])
    out = shard(df, 3)
    assert out.columns == ["Shard", "slot", "_slot", "_shard", "__slot"]
    assert sorted(r.Shard for r in out.collect()) == list(range(50))


def test_small(spark):
    df = spark.createDataFrame([Row(x=1), Row(x=2)])
    check(shard(df, 24).collect(), 2, 24)
    empty = shard(df.limit(0), 24)
    assert empty.count() == 0 and empty.columns == ["x", "shard", "slot"]
    with pytest.raises(ValueError):
        shard(df, 0)


def test_uniform(spark, monkeypatch):
    """Where a row goes does not depend on where it stood: place by source as a table of equal expected counts."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 700)
    out = shard(spark.range(24_000, numPartitions=6), 4, seed=9)
    cells = out.groupBy(F.floor(F.col("id") / 2000).alias("a"), "shard", F.floor(F.col("slot") / 1000).alias("b")).count().collect()
    expected = 24_000 / (12 * 4 * 6)
    assert sum((r["count"] - expected) ** 2 / expected for r in cells) < 288 + 5 * math.sqrt(2 * 288)
    pairs = out.alias("x").join(out.alias("y"), (F.col("x.shard") == F.col("y.shard")) & (F.col("x.slot") + 1 == F.col("y.slot")))
    assert pairs.where("x.id + 1 = y.id").count() < 10 and 0.47 < pairs.where("x.id < y.id").count() / 23_996 < 0.53
