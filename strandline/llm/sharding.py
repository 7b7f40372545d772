"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each source group sends to each shard is drawn from the exact distribution of a uniform shuffle. A group then
permutes its rows and deals them out by its row of the matrix, shards are exchanged, and each shard permutes again: every order
of all rows is equally likely, and every shard has exactly its size. One law holds: ``rows``.

The matrix is drawn down a tree over the source groups whose nodes have a bounded number of children: a task that holds a
node's column sums draws those of its children. The work is a draw for each group and shard, at any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.store import free, written

LAW = "rows"
#: Rows of a source group, the unit of the first permutation, at most, and of a bucket of the second one, as expected.
CELL_ROWS = 50_000
#: A node of the tree over the groups has 2 ** BITS children at most.
BITS = 8


def _stirling(n: float) -> float:
    """log(n!) less Stirling's main terms."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * m)) / m) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation where both are close."""
    if abs(x - mean) < 0.1 * (x + mean):
        v = (x - mean) / (x + mean)
        total, term, j = (x - mean) * v, 2 * x * v, 1
        while True:
            term *= v * v
            new = total + term / (2 * j + 1)
            if new == total:
                return total
            total, j = new, j + 1
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """Log of the binomial probability of x of n, by the saddle point (Loader's form), exact to rounding for any size."""
    if x == 0:
        return n * (math.log1p(-p) if p < 0.5 else math.log(q)) if n else 0.0
    if x == n:
        return n * (math.log1p(-q) if q < 0.5 else math.log(p))
    c = _stirling(n) - _stirling(x) - _stirling(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return c + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def log_probability(x: int, good: int, bad: int, draws: int) -> float:
    """Log of the hypergeometric probability of x good ones among some draws of good + bad."""
    if x < max(0, draws - bad) or x > min(good, draws):
        return -math.inf
    n = good + bad
    p, q = draws / n, (n - draws) / n
    return _log_binomial(x, good, p, q) + _log_binomial(draws - x, bad, p, q) - _log_binomial(draws, n, p, q)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact draw at any size, by rejection under an envelope that holds for every log-concave distribution (Devroye)."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    top = log_probability(mode, good, bad, draws)
    p = math.exp(top)
    w = 1 + p / 2
    while True:
        y = rng.random() * w / p if rng.random() <= w / (1 + w) else (w + rng.exponential()) / p
        x = mode + (1 if rng.random() < 0.5 else -1) * int(y + 0.5)
        if rng.random() * min(1.0, math.exp(w - p * y)) <= math.exp(log_probability(x, good, bad, draws) - top):
            return x


def split(rng: np.random.Generator, columns: list[int], rows: list[int]) -> list[list[int]]:
    """A table with the given column and row sums, which are equal in all, drawn as a uniform shuffle deals them."""
    left, out = list(columns), []
    for n in rows[:-1]:
        rest, drawn = sum(left), []
        for c in left:
            x = hypergeometric(rng, c, rest - c, n)
            drawn.append(x)
            rest, n = rest - c, n - x
        out.append(drawn)
        left = [a - b for a, b in zip(left, drawn, strict=True)]
    return [*out, left] if rows else []


def _draw(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, level, columns, kids in zip(*[batch.column(c).to_pylist() for c in ("node", "level", "columns", "kids")], strict=True):
                # Each node has its own seed, so a repeated task draws the same.
                found = split(np.random.default_rng([seed, level, node & 0xFFFFFFFF, node >> 32]), columns, [k["n"] for k in kids])
                yield pa.RecordBatch.from_arrays([pa.array([k["child"] for k in kids], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "columns"])

    return run


def matrix(groups: DataFrame, sizes: list[int], seed: int, last: int) -> DataFrame:
    """(node, columns): how many rows each group sends to each shard. groups: node (0 to last) and n, their sum being that of sizes."""
    spark = groups.sparkSession
    at = spark.createDataFrame([(0, [int(s) for s in sizes])], "node bigint, columns array<bigint>")  # the root: one number for each shard
    for level in reversed(range(max(1, -(-int(last).bit_length() // BITS)))):
        kids = groups.groupBy(F.shiftright("node", BITS * level).alias("child")).agg(F.sum("n").alias("n"))
        kids = kids.groupBy(F.shiftright("child", BITS).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("kids"))  # 2 ** BITS entries at most
        at = at.join(kids, "node").select("node", F.lit(level).alias("level"), "columns", "kids").mapInArrow(_draw(seed), "node bigint, columns array<bigint>")
    return at


def shard(rows: DataFrame, shards: int, seed: int = 0, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """All rows and columns of ``rows`` with shard (0 to shards - 1) and slot (0, 1, ... without gaps inside a shard).

    Shard sizes differ by one at most. Null values, equal rows and equal texts are rows like any other. With fewer rows than
    shards some stay empty; without rows the result is empty. If rows has a column of a new one's name, the new one gets "_" in front.
    Rows are written once to the shared folder with the partition they came from, so that all later steps see the same. Both
    permutations and the exchange move row numbers only; the rows themselves are moved once, to their places.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    names = [free(rows.columns, c) for c in names]
    kept = [f"_{i}" for i in range(len(rows.columns))]
    placed = written(rows.toDF(*kept).withColumn("_at", F.monotonically_increasing_id()), "shard-rows")
    # A group is a part of a partition, by the row's number in there; its own number is made of both.
    inside = F.floor(F.col("_at") % F.lit(1 << 33) / CELL_ROWS).cast("bigint")
    groups = written(placed.groupBy(F.shiftright("_at", 33).alias("p"), inside.alias("i")).agg(F.count("*").alias("n")), "shard-groups")
    total, most_p, most_i = groups.agg(F.sum("n"), F.max("p"), F.max("i")).first()
    if not total:
        return placed.select(*[F.col(k).alias(c) for k, c in zip(kept, rows.columns, strict=True)], F.lit(0).alias(names[0]), F.lit(0).cast("bigint").alias(names[1]))
    groups = groups.select((F.col("p") * (most_i + 1) + F.col("i")).alias("node"), "n")
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    sent = written(matrix(groups, sizes, seed, (most_p + 1) * (most_i + 1) - 1), "shard-matrix")
    # A group's row of the matrix as the ranks at which each shard's share ends: the rank of a row tells its shard.
    ends = F.transform("columns", lambda x, i: F.aggregate(F.slice("columns", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, y: a + y))
    sent = sent.select(F.col("node").alias("_group"), ends.alias("_ends"))
    numbers = placed.select("_at", (F.shiftright("_at", 33) * (most_i + 1) + inside).alias("_group"))
    permuted = numbers.withColumn("_rank", F.row_number().over(W.partitionBy("_group").orderBy(F.xxhash64("_at", F.lit(seed), F.lit("before")), "_at")) - 1)
    dealt = permuted.join(sent, "_group").withColumn("_shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
    # The second permutation is the order of a second hash inside a shard, found in buckets of bounded size.
    buckets = -(-max(sizes) // CELL_ROWS)
    dealt = dealt.withColumn("_key", F.xxhash64("_at", F.lit(seed), F.lit("after")))
    dealt = dealt.withColumn("_bucket", F.floor(F.shiftrightunsigned("_key", 32) * buckets / F.lit(1 << 32)).cast("int"))
    dealt = written(dealt.select("_at", "_shard", "_key", "_bucket"), "shard-dealt")
    counts = dealt.groupBy("_shard", "_bucket").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    begins = counts.select("_shard", "_bucket", F.coalesce(before, F.lit(0)).alias("_begin"))
    spread = dealt.withColumn("_slot", F.row_number().over(W.partitionBy("_shard", "_bucket").orderBy("_key", "_at")) - 1)
    spread = spread.join(begins, ["_shard", "_bucket"]).select("_at", "_shard", (F.col("_begin") + F.col("_slot")).cast("bigint").alias("_slot"))
    out = placed.join(spread, "_at")
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, rows.columns, strict=True)], F.col("_shard").alias(names[0]), F.col("_slot").alias(names[1]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8) and text_crc32 (null for a null text)."""
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
