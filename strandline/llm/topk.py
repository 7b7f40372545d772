"""Exact top-k inner products by norm buckets: long vectors first, short ones pruned by length or by coordinates.

A query's threshold comes from the longest vectors of all. A vector is sent to a query block only if its length allows it to
reach some threshold there, and a query to a bucket only if some vector there is long enough. In a bucket of vectors of similar length, a query's local cosine threshold decides: a high one
prunes by its largest coordinates, whose values a vector must then have within a narrow range; a low one prunes by length.
What remains is verified by integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.ann import top, usable
from strandline.llm.batches import matrix, sorted_runs
from strandline.llm.store import written

SCALE = 1024
#: The longest vectors, from which thresholds are taken: a bounded table.
SEED_ROWS = 2048
#: Bytes of the queries of a group, and of the vectors of a block of a bucket, about. Each vector is sent once for a group, each query once for a block.
GROUP_BYTES, BLOCK_BYTES = 32 << 20, 32 << 20
BUCKETS = 64
#: Groups of queries by the length they need; larger groups are split further by a hash.
BANDS = 64
#: Largest coordinates of a query that are tested, and the local cosine threshold from which they are.
FOCUS, SHARP = 4, 0.6
_SLACK = 1e-9
_LIMIT = float(1 << 53)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products of one query with rows, which hold whole numbers; beyond 64 bits the nearest 64-bit number."""
    if not len(v):
        return np.empty(0, np.int64)
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, len(q)) < _LIMIT:
        return (v @ q).astype(np.int64)
    whole = [int(x) for x in q]
    out = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in v]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in out], np.int64)


def best(q: np.ndarray, own: int, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows other than the query's own."""
    score = products(q, v)
    keep = ids != own
    ids, score = ids[keep], score[keep]
    order = np.lexsort((ids, -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score))[:k]
    return ids[order], score[order]


def _reach(threshold: float, length: float) -> float:
    """The length that a vector needs to reach a threshold with a query of some length; 0 if any can."""
    return 0.0 if threshold <= 0 or length == 0 else threshold / length * (1 - _SLACK)


def _needs(every: int, k: int, seeds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_ids, seed_sizes, seed_v = seeds.value
        for batch in batches:
            out = []
            for own, row in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                q = np.array(row)
                at = np.flatnonzero(seed_sizes == len(q))
                _, score = best(q, own, seed_ids[at], np.array([seed_v[i] for i in at]).reshape(len(at), len(q)), k)
                out.append((float(score[k - 1]) if len(score) >= k else -np.inf, float(np.sqrt((q * q).sum()))))
            t = np.array([x for x, _ in out])
            need = np.array([_reach(x, n) for x, n in out])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t), pa.array(need)], [*batch.schema.names, "threshold", "need"])

    return run


def prune(q: np.ndarray, threshold: float, v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows of a bucket that may reach the threshold."""
    size = float(np.sqrt((q * q).sum()))
    if threshold <= 0 or size == 0:
        return np.arange(len(v))
    longest = float(lengths.max(initial=0))
    if longest * size * (1 + _SLACK) < threshold:
        return np.empty(0, int)
    local = min(1.0, threshold / (size * longest) * (1 - _SLACK))
    rows = np.flatnonzero(lengths * size * (1 + _SLACK) >= threshold)
    if local >= SHARP and len(rows):
        unit = q / size
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            spread = np.sqrt((1 - local * local) * max(0.0, 1 - unit[f] * unit[f]))
            x = v[rows, f] / lengths[rows]
            # A lower value is allowed down to the cap's edge; an upper limit holds only while the cap does not hold the axis.
            low = unit[f] * local - spread - 1e-7 if unit[f] > -local else -1.0
            high = unit[f] * local + spread + 1e-7 if unit[f] < local else 1.0
            rows = rows[(x >= low) & (x <= high)]
    return rows


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, number in sorted_runs(batches, ["cell"]):
            asks, ids, limits = t.column("query").to_numpy(), t.column("vec_id").to_numpy(), t.column("threshold").to_numpy()
            found: list[tuple] = []
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                if not asks[s:e].any() or asks[s:e].all():
                    continue
                x = matrix(t.column("v").slice(s, e - s))
                q, rows = np.flatnonzero(asks[s:e]), np.flatnonzero(~asks[s:e])
                v, own = x[rows], ids[s:e][rows]
                lengths = np.sqrt((v * v).sum(axis=1))
                for i in q:
                    some = prune(x[i], limits[s + i], v, lengths)
                    near, score = best(x[i], ids[s + i], own[some], v[some], k)
                    found.append((np.full(len(near), ids[s + i]), near, score))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, the vector of floor(1024 x) and its length."""
    v = F.transform("v", lambda x: F.floor(x * SCALE).cast("double"))
    whole = usable(vectors, zero=True).select("vec_id", v.alias("v"))
    return whole.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def cells(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """(cell, query, vec_id, v, threshold): what meets in each cell, after pruning by length on both sides.

    Queries are grouped by the length that a vector needs to reach their thresholds, so a group of demanding queries is sent the
    long vectors only; and a query is sent only to buckets that hold a vector of the length it needs.
    """
    spark = vectors.sparkSession
    whole = integers(vectors)
    seeds = whole.orderBy(F.col("length").desc(), "vec_id").limit(SEED_ROWS).select("vec_id", "v").collect()  # a bounded number of rows
    sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in seeds], np.int64), np.array([len(r["v"]) for r in seeds]), [np.array(r["v"]) for r in seeds]))
    asking = whole.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.size("v").alias("d"))
    queries = written(asking.mapInArrow(_needs(every, k, sent), "vec_id bigint, v array<double>, d int, threshold double, need double"), "topk-queries")
    cut = lambda c, n: F.percentile_approx(c, [i / n for i in range(1, n)] or [0.5], 1000)
    groups = max(1, -(-8 * (queries.agg(F.sum("d")).first()[0] or 0) // GROUP_BYTES))
    bands = min(BANDS, groups)
    queries = queries.withColumn("band", _place("need", queries.agg(cut("need", bands)).first()[0] if bands > 1 else []))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(-(-groups // bands))) * BANDS + F.col("band"))
    # Least length that some query of a group (and vector size) needs: a number for each group, never a row for each query.
    needs = written(queries.groupBy("d", "group").agg(F.min("need").alias("least")), "topk-needs")
    dealt = whole.withColumns({"d": F.size("v"), "bucket": _place("length", whole.agg(cut("length", BUCKETS)).first()[0] or [])})
    counts = written(dealt.groupBy("d", "bucket").agg(F.ceil(F.count("*") * F.col("d") * 8 / BLOCK_BYTES).cast("int").alias("blocks"), F.max("length").alias("longest")), "topk-buckets")
    rows = dealt.join(counts, ["d", "bucket"]).join(needs, "d").where(F.col("length") >= F.col("least"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int")
    left = rows.select(F.xxhash64("d", "group", "bucket", block.alias("b")).alias("cell"), F.lit(False).alias("query"), "vec_id", "v", F.lit(0.0).alias("threshold"))
    asked = queries.join(counts, "d").where(F.col("longest") >= F.col("need")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return left.unionByName(asked.select(F.xxhash64("d", "group", "bucket", "b").alias("cell"), F.lit(True).alias("query"), "vec_id", "v", "threshold"))


def _place(column: str, cuts: list[float]) -> Column:
    """The number of cuts below a value; there are at most BUCKETS of them."""
    return sum(((F.col(column) > c).cast("int") for c in sorted(set(cuts))), F.lit(0))


def top_products(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every vector whose vec_id is divisible by ``every``.

    vectors: vec_id and embedding; other columns are left alone. A query meets all rows but those of its own vec_id; vectors of
    different lengths never meet. Null and empty vectors and those with null or non-finite components take no part, zero vectors
    do. Equal rows count once for each vec_id. Ties go to the smaller vec_id. An empty table gives an empty result.
    """
    met = cells(vectors, every, k)
    found = met.repartition("cell").sortWithinPartitions("cell").mapInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    return top(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)
