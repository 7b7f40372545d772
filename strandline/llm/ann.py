"""Approximate nearest neighbours by cross-polytope hashing with multiprobe, and exact reranking.

A polytope's hash turns a unit vector by three rounds of random signs and a fast Hadamard transform and takes the nearest signed
axis. A table's hash is the axes of several polytopes, of which the last may be cut to fewer axes. Their number grows with the
logarithm of the number of vectors, so that a query meets an ever smaller share of them: about SHARE * n ** -FALL. Every vector
stands in one bucket of each table; a query visits the buckets whose axes add up to the largest coordinates.

Only ids and codes are shuffled for the tables. A vector's queries of all tables are made one list, and each vector is joined to
its list once for each group of queries. Equal vectors are searched as one. A query that meets fewer than k others is compared
with all vectors of its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.batches import matrix, sorted_runs
from strandline.llm.store import written

TABLES, ROUNDS = 24, 3
#: The share of n vectors that a query is to meet is SHARE * n ** -FALL; a table has as many buckets as make that about PROBES visits.
SHARE, FALL, PROBES = 1.83, 0.315, 96
#: A bucket is split into blocks of about so many vectors; a query visits all blocks of a bucket, so nothing is left out.
BLOCK_ROWS = 4096
#: Queries of a group, about: their vectors stand in one task's memory.
QUERY_ROWS = 2048
#: Pairs that are scored at once, and ids of queries that are passed on at once.
_PAIRS, _IDS = 8192, 1 << 16


def hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h / np.sqrt(np.float32(n))


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two; orthonormal. Done by the factors of the length."""
    n, d = x.shape
    a = 1 << (d.bit_length() // 2)
    b = d // a
    return (hadamard(a) @ (x.reshape(n, a, b) @ hadamard(b))).reshape(n, d)


def rotated(unit: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """A pseudo-random rotation, padded to a power of two."""
    n, d = unit.shape
    size = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, size), np.float32)
    x[:, :d] = unit
    signs = np.random.default_rng([77, *key]).choice(np.array([-1, 1], np.float32), (ROUNDS, size))
    for s in signs:
        x = transform(x * s)
    return x


def layout(n: int, d: int) -> tuple[list[int], int]:
    """Axes of each polytope of a table, and how many buckets a query visits, for n vectors of d components."""
    whole = 1 + max(0, d - 1).bit_length()  # bits of a whole polytope: signed axes of the padded length
    share = min(0.9, SHARE * max(1, n) ** -FALL)
    bits = max(1, round(math.log2(TABLES * PROBES / share)))
    axes = [1 << whole] * (bits // whole) + [1 << (bits % whole)] * (bits % whole > 0)
    return axes, min(1 << bits, math.ceil((1 << bits) * -math.log1p(-share) / TABLES))


def signed(turned: np.ndarray, axes: int) -> np.ndarray:
    """Coordinates along the first signed axes: axis j and, half of them later, its opposite."""
    return np.concatenate([turned[:, : axes // 2], -turned[:, : axes // 2]], axis=1)


def visits(coordinates: list[np.ndarray], count: int) -> np.ndarray:
    """The ``count`` codes with the largest sums of coordinates, for each row. They are among the best of the first polytopes and any axis of the next."""
    n = len(coordinates[0])
    code, total = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
    for c in coordinates:
        both = (total[:, :, None] + c[:, None, :]).reshape(n, -1)
        codes = (code[:, :, None] * c.shape[1] + np.arange(c.shape[1])).reshape(n, -1)
        keep = min(count, both.shape[1])
        at = np.argpartition(-both, keep - 1, axis=1)[:, :keep]
        code, total = np.take_along_axis(codes, at, 1), np.take_along_axis(both, at, 1)
    return code


def usable(vectors: DataFrame, zero: bool = False) -> DataFrame:
    """vec_id and the vector as doubles, without null vectors, null or non-finite components, empty ones and, unless asked for, zero vectors."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.lit(True) if zero else F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(some, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, vec_id, asks): the bucket of each vector in each table, and for asking vectors the buckets they visit."""
    for whole in batches:
        sizes = np.asarray(whole.column("v").value_lengths())
        for d in np.unique(sizes).tolist():
            batch = whole.filter(pa.array(sizes == d))
            axes, count = layout(batch.column("n")[0].as_py(), d)
            x = matrix(batch.column("v"))
            unit = x / np.abs(x).max(axis=1, keepdims=True)
            unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
            ids = batch.column("vec_id").to_numpy()
            asking = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            for t in range(TABLES):
                along = [signed(rotated(unit, (t, i)), a) for i, a in enumerate(axes)]
                own = np.zeros(len(ids), np.int64)
                for c in along:
                    own = own * c.shape[1] + c.argmax(axis=1)
                codes, rows, asks = [own], [np.arange(len(ids))], [np.zeros(len(ids), bool)]
                for i in range(0, len(asking), 64):
                    part = asking[i : i + 64]
                    near = visits([c[part] for c in along], count)
                    codes.append(near.ravel())
                    rows.append(np.repeat(part, near.shape[1]))
                    asks.append(np.ones(near.size, bool))
                cell = ((d * TABLES + t) << sum(a.bit_length() - 1 for a in axes)) + np.concatenate(codes)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[np.concatenate(rows)]), pa.array(np.concatenate(asks))], ["cell", "vec_id", "asks"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, queries): a row for each vector of a cell that queries visit, with their ids, a bounded number of ids at a time."""
    for t, number in sorted_runs(batches, ["cell", "block"]):
        ids, asks = t.column("vec_id").to_numpy(), t.column("asks").to_numpy()
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        rows, lists, sizes, held = [], [], [], 0

        def packed(rows: list, lists: list, sizes: list) -> pa.RecordBatch:
            ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], ["vec_id", "queries"])

        for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
            q, v = ids[s:e][asks[s:e]], ids[s:e][~asks[s:e]]
            if not len(q) or not len(v):
                continue
            for j in range(0, len(q), _IDS):
                some = q[j : j + _IDS]
                step = max(1, _IDS // len(some))
                for i in range(0, len(v), step):
                    part = v[i : i + step]
                    rows.append(part)
                    lists.append(np.tile(some, len(part)))
                    sizes.append(np.full(len(part), len(some)))
                    held += len(lists[-1])
                    if held >= _IDS:
                        yield packed(rows, lists, sizes)
                        rows, lists, sizes, held = [], [], [], 0
        if rows:
            yield packed(rows, lists, sizes)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component to 1/2 or more: no square overflows or vanishes, and cosines keep their bits."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows of scaled(); the same two vectors give the same bits wherever they stand."""
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def _rerank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best listed vectors of each query of a cell; rows without a list are the queries."""
        for t, number in sorted_runs(batches, ["part", "salt"]):
            ids, asks = t.column("vec_id").to_numpy(), t.column("queries").is_null().to_numpy()
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            found: list[tuple] = []
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                some, own = t.slice(s, e - s), asks[s:e]
                q_ids, v_ids = ids[s:e][own], ids[s:e][~own]
                order = np.argsort(q_ids)
                q_ids = q_ids[order]
                lists = some.column("queries").filter(pa.array(~own)).combine_chunks()
                if not len(q_ids) or not len(v_ids):
                    continue
                sizes = np.asarray(lists.value_lengths())
                at_q = np.searchsorted(q_ids, lists.flatten().to_numpy())
                at_v = np.repeat(np.arange(len(v_ids)), sizes)
                score = np.empty(len(at_q))
                # Vectors of one length only ever meet each other, so each length is a matrix of its own.
                lengths = np.asarray(some.column("v").combine_chunks().value_lengths())
                for d in np.unique(lengths[own]).tolist():
                    q_of, v_of = np.cumsum(lengths[own][order] == d) - 1, np.cumsum(lengths[~own] == d) - 1
                    q = scaled(matrix(some.column("v").filter(pa.array(own)).take(pa.array(order)).filter(pa.array(lengths[own][order] == d))))
                    v = scaled(matrix(some.column("v").filter(pa.array(~own & (lengths == d)))))
                    rows = np.flatnonzero(lengths[~own][at_v] == d)
                    for i in range(0, len(rows), _PAIRS):
                        part = rows[i : i + _PAIRS]
                        score[part] = cosines(q[q_of[at_q[part]]], v[v_of[at_v[part]]])
                best = np.lexsort((v_ids[at_v], -score, at_q))
                begins = np.searchsorted(at_q[best], np.arange(len(q_ids)))
                place = np.arange(len(best)) - begins[at_q[best]]
                best = best[place < k]
                found.append((q_ids[at_q[best]], v_ids[at_v[best]], score[best]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in sorted_runs(batches, ["cell"]):
            asks, ids, x = t.column("query").to_numpy(), t.column("vec_id").to_numpy(), None
            found: list[tuple] = []
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                if not asks[s:e].any() or asks[s:e].all():
                    continue
                x = scaled(matrix(t.column("v").slice(s, e - s)))
                q, v = np.flatnonzero(asks[s:e]), np.flatnonzero(~asks[s:e])
                unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                for at in range(0, len(q), 256):
                    part = q[at : at + 256]
                    rough = unit[part] @ unit[v].T
                    if len(v) > k:
                        least = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] - 1e-9
                    else:
                        least = np.full(len(part), -1.5)
                    for i, row in enumerate(rough):
                        near = v[np.flatnonzero(row >= max(least[i], -1.5))]
                        score = cosines(np.broadcast_to(x[part[i]], (len(near), x.shape[1])), x[near])
                        order = np.lexsort((ids[s + near], -score))[:k]
                        found.append((np.full(len(order), ids[s + part[i]]), ids[s + near[order]], score[order]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties go to the smaller vec_id."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def searched(vectors: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each block of all vectors for each row of asks; both have vec_id and v."""
    sizes = written(vectors.groupBy(F.size("v").alias("d")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "ann-lengths")
    placed = vectors.withColumn("query", F.lit(False)).unionByName(asks.withColumn("query", F.lit(True))).withColumn("d", F.size("v"))
    one = F.array(F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    block = F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(one))
    cells = placed.join(sizes, "d").withColumn("block", block).select(F.xxhash64("d", "block").alias("cell"), "query", "vec_id", "v")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_best(k), "query_id bigint, vec_id bigint, score double")


def candidates(classes: DataFrame) -> DataFrame:
    """(vec_id, queries): for each vector and each bucket it shares with queries, the list of these. classes: vec_id, v, asks."""
    counts = written(classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")), "ann-lengths")
    codes = written(classes.withColumn("d", F.size("v")).join(counts, "d").select("vec_id", "v", "asks", "n").mapInArrow(_codes, "cell bigint, vec_id bigint, asks boolean"), "ann-codes")
    # Buckets without a query or with few vectors need no blocks; the table of the others is written, so Spark sees its size.
    large = written(codes.where("not asks").groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1"), "ann-large")
    one = F.array(F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    block = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(one))
    met = codes.join(large, "cell", "left").withColumn("block", block).select("cell", "block", "vec_id", "asks")
    return met.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_lists, "vec_id bigint, queries array<bigint>")


def reranked(classes: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best distinct pairs of each query; met: candidates()."""
    asking = classes.where("asks").select("vec_id", "v")
    groups = max(1, -(-asking.count() // QUERY_ROWS))
    of = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(groups)).cast("int")
    parted = met.withColumn("part", F.explode(F.array_distinct(F.transform("queries", of))))
    parted = parted.select("vec_id", "part", F.filter("queries", lambda q: of(q) == F.col("part")).alias("queries"))
    lists = written(parted.groupBy("vec_id", "part").agg(F.array_distinct(F.flatten(F.collect_list("queries"))).alias("queries")), "ann-lists")
    salts = written(lists.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("salts")), "ann-parts")
    left = lists.join(salts, "part").withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("salts")).cast("int"))
    left = left.select("part", "salt", "vec_id", "queries").join(classes.select("vec_id", "v"), "vec_id").select("part", "salt", "vec_id", "v", "queries")
    right = asking.withColumn("part", of("vec_id")).join(salts, "part").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = right.select("part", "salt", "vec_id", "v", F.lit(None).cast("array<bigint>").alias("queries"))
    cells = left.unionByName(right).repartition("part", "salt").sortWithinPartitions("part", "salt")
    return cells.mapInArrow(_rerank(k), "query_id bigint, vec_id bigint, score double")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector whose vec_id is divisible by ``every``.

    A query with fewer than k found in its buckets gets its exact nearest, so fewer rows mean that there are no others.

    vectors: vec_id and embedding; other columns are left alone. A query meets all rows but those of its own vec_id. Vectors of
    different lengths never meet. Of equal scores the smaller vec_id stands first. Null, empty and zero vectors and those with
    null or non-finite components take no part; of rows with one vec_id the least vector counts; an empty table gives an empty result.
    """
    fine = written(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-rows")
    asks = F.col("vec_id") % every == 0
    # Equal vectors are one class, named by its smallest vec_id; of its members only the k + 1 smallest can be among k nearest.
    classes = written(fine.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.max(asks).alias("asks")).select("vec_id", "v", "asks"), "ann-classes")
    named = written(fine.join(classes.select("v", F.col("vec_id").alias("class_id")), "v").select("class_id", "vec_id"), "ann-named")
    first = W.partitionBy("class_id").orderBy("vec_id")
    members = named.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    queries = named.where(asks).withColumnRenamed("vec_id", "query_id")

    def expanded(found: DataFrame) -> DataFrame:
        """The k best rows of each query from the best classes of its class."""
        some = top(found, k + 1).select(F.col("query_id").alias("asking"), F.col("vec_id").alias("class_id"), "score").join(members, "class_id")
        rows = queries.join(some, queries["class_id"] == some["asking"]).where(F.col("query_id") != F.col("vec_id"))
        return top(rows.select("query_id", "vec_id", "score"), k)

    found = written(reranked(classes, candidates(classes), k + 1), "ann-found")
    best = written(expanded(found), "ann-best")
    full = best.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, "query_id", "left_anti").select(F.col("class_id").alias("vec_id")).distinct()
    short = written(classes.join(short, "vec_id", "left_semi").select("vec_id", "v"), "ann-short")
    if not short.limit(1).count():
        return best
    whole = searched(classes.select("vec_id", "v"), short, k + 1)
    both = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
    return expanded(both)
